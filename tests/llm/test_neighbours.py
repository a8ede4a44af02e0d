"""Exact search against a full scan."""

import math
import random

import numpy as np
import pytest

from voxrill.llm import neighbours


def brute(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in fine if i % 5 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(n, dim, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    same = [rng.gauss(0, 1) for _ in range(dim)]
    rows += [(1000 + i, list(same)) for i in range(60)]
    rows += [(2000, None), (2005, [float("nan")] * dim), (2010, [float("inf")] + [0.0] * (dim - 1)), (2015, [None] * dim), (None, list(same)), (2020, []), (2025, same[:2])]
    return rows


@pytest.mark.parametrize("n,dim,shard,block", [(300, 6, 8192, 512), (300, 6, 50, 7), (3, 4, 10, 10)])
def test_full_scan(spark, monkeypatch, n, dim, shard, block):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", block)
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", shard)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    rows = vectors(n, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.top_k(df, lambda i: i % 5 == 0, 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i), -1.0 / (i + 1), float(i * 7919 % 104729)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.top_k(df, lambda i: i % 5 == 0, 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10)


def test_edges(spark):
    df = spark.createDataFrame([(5, [1.0], 1), (5, [1.0], 2), (6, [1.0], 3)], "vec_id long, embedding array<float>, shard int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.top_k(df, lambda i: i % 5 == 0, 10).collect())
    assert got == [(5, 1, 6)]
    assert neighbours.top_k(df.limit(0), lambda i: i % 5 == 0, 10).count() == 0
    assert neighbours.top_k(df.where("vec_id = 6"), lambda i: i % 5 == 0, 10).count() == 0


def test_tree_has_tight_boxes_and_whole_rows():
    rng = np.random.default_rng(2)
    values, ids = rng.integers(-50, 50, (1000, 5)), rng.permutation(1000)
    t = neighbours.Tree.build(ids, values, 16)
    assert sorted(t.ids.tolist()) == list(range(1000)) and (values[np.argsort(ids)] == t.values[np.argsort(t.ids)]).all()
    leaves = [tuple(x[:2]) for x in t.links.tolist() if x[2] < 0]
    assert sorted(leaves)[0][0] == 0 and sum(b - a for a, b in leaves) == 1000 and max(b - a for a, b in leaves) <= 16
    for (a, b, left, right), low, high in zip(t.links.tolist(), t.low, t.high):
        assert (t.values[a:b].min(0) == low).all() and (t.values[a:b].max(0) == high).all()
        assert left < 0 or (t.links[left][0], t.links[left][1], t.links[right][1]) == (a, t.links[right][0], b)


@pytest.mark.parametrize("known", [False, True])
def test_search_opens_few_nodes_and_is_exact(known):
    """On rows in clusters most of the tree stays shut, more so with a kth score from elsewhere."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (40, 3))
    values = centres[rng.integers(0, 40, 8000)] + rng.integers(-9, 9, (8000, 3))
    ids, q = np.arange(8000), values[::400]
    t = neighbours.Tree.build(ids, values, 32)
    scores = q @ values.T
    scores[np.arange(20), np.arange(0, 8000, 400)] = -(10**15)
    want = [sorted(zip(-s, ids))[:10] for s in scores]
    kth = [-w[9][0] if known else neighbours._LEAST for w in want]
    kth_ids = [w[9][1] if known else neighbours._NO_ID for w in want]
    best, found, opened = neighbours.search_block(np.arange(0, 8000, 400), q, kth, kth_ids, t, 10)
    assert [[(-int(s), int(i)) for s, i in zip(a, b)] for a, b in zip(best, found)] == [[(int(s), int(i)) for s, i in w] for w in want]
    assert opened < 0.1 * len(q) * len(t.links)
