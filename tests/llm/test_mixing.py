"""Mixing: targets, exact quotas of the tree, nearness to targets, and shards that use each draw once."""

import collections
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrill.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    t = mixing.fill(sizes, weights, 1.5, 2.0)
    assert all(x <= 2 * s + 1e-6 for x, s in zip(t, sizes))
    assert abs(sum(t) - 1.5 * sum(sizes)) <= 1e-6 * max(1, sum(sizes))
    free = [(x / w) for x, s, w in zip(t, sizes, weights) if x < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))
    # A source at its bound would get more by weight alone.
    assert not free or all(x / w <= max(free) + 1e-6 for x, w in zip(t, weights))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(1, 9))
def test_tree_uses_each_draw_once(quotas, shards):
    quotas = np.array(quotas)
    used = [set() for _ in quotas]
    for shard in range(shards):
        start, n = mixing.walk(quotas, shards, shard, 3)
        assert abs(n.sum() - quotas.sum() / shards) <= 1
        for i in range(len(quotas)):
            mine = set(range(start[i], start[i] + n[i]))
            assert not mine & used[i]
            used[i] |= mine
    assert [len(u) for u in used] == quotas.tolist()


def rows(n, seed=2):
    rng = random.Random(seed)
    out = [(i, " ".join(["w%d" % rng.randrange(99)] * rng.randrange(0, 60)), "src%d" % (rng.randrange(5) if rng.random() < 0.6 else 0)) for i in range(n)]
    return out + [(n, None, "src1"), (n + 1, "only one", None), (n + 2, "", "empty"), (None, "a b c", "src2"), (7, out[7][1], out[7][2])]


def test_takes(spark):
    df = spark.createDataFrame(rows(400), "doc_id long, text string, source string").repartition(3)
    got = mixing.takes(df).collect()
    assert len(got) == df.count()
    source = {r.doc_id: r.source for r in df.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = (r.source_size, r.target)
    names = sorted((s for s in size if s is not None)) + [None]
    want = mixing.fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, t in zip(names, want):
        assert target[s][0] == size[s] and abs(target[s][1] - t) < 1e-6
        assert abs(taken[s] - t) <= max(3, 0.01 * t)
    again = {(r.doc_id, r.taken, tuple(r.shards)) for r in mixing.takes(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.shards)) for r in got}


def test_mix_returns_the_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    df = spark.createDataFrame([(*r, 1) for r in rows(200)], "doc_id long, text string, source string, shards int")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in mixing.takes(df).collect():
        want[r.doc_id] += len(r.shards)
    assert +copies == +want
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.takes(df.limit(0)).count() == 0


def test_rows_without_words_stay_out_of_edge_groups(spark, monkeypatch):
    """They are all taken as often as their block, but not sent to the one task of an edge block."""
    picks = mixing._edge_picks

    def only_words(pdf):
        assert (pdf["size"] > 0).all()
        return picks(pdf)

    monkeypatch.setattr(mixing, "_edge_picks", only_words)
    rows = [(i, "a b c d e" if i % 5 == 0 else (None if i % 2 else " "), "xyz"[i % 3]) for i in range(300)]
    got = mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 300
    for r in got:
        if r.size == 0:
            assert len(r.shards) == math.ceil(r.target / r.source_size)


def test_nulls_do_not_clash(spark):
    """A null text and a null source are told apart, and rows stay as many as they are."""
    rows = [(1, None, "a"), (1, "a", None), (None, "a", "b"), (None, None, None), (2, "x y z", "a"), (2, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.takes(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size) for r in got) == sorted(
        (i is None, i or 0, len((t or "").split()), {"a": 3, "b": 4, None: 1}[s]) for i, t, s in rows)


def test_running_totals_in_slices(spark, monkeypatch):
    """Two levels of sums give what one window over all blocks of a source gives."""
    monkeypatch.setattr(mixing, "SLICE_BITS", 3)
    rng = random.Random(9)
    rows = [(n, rng.randrange(-2**63, 2**63), b, rng.randrange(50)) for n in range(3) for b in range(200)]
    got = {(r._number, r._block): (r.before, r.rank) for r in mixing._running(spark.createDataFrame(rows, "_number int, order long, _block long, words long")).collect()}
    want = {}
    for n in range(3):
        before = 0
        for rank, (_, _, b, words) in enumerate(sorted((r for r in rows if r[0] == n), key=lambda r: r[1:3])):
            want[n, b] = (before, rank)
            before += words
    assert got == want


def test_many_shards(spark, monkeypatch):
    """With small blocks the tree is several nodes deep; each source still comes near its target."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_DRAWS", 4)
    df = spark.createDataFrame(rows(400), "doc_id long, text string, source string")
    got = mixing.takes(df).collect()
    assert len({s for r in got for s in r.shards}) > 30
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= max(3, 0.01 * t) for s, t in target.items())
    parts = mixing.mix(df).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 8 and max(p["count"] for p in parts) < 3 * min(p["count"] for p in parts)


def test_a_source_for_every_row_is_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    df = spark.range(30).selectExpr("id AS doc_id", "'a b' AS text", "cast(id AS string) AS source")
    with pytest.raises(ValueError, match="sources"):
        mixing.takes(df)
