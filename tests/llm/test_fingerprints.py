"""Fingerprints: edited texts and neighbours exactly, likeness against true resemblance."""

import hashlib
import random

from pyspark.sql import functions as F

from voxrill.llm import fingerprints


def runs(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def true_likeness(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b)


def wanted(rows):
    """(id, edited text, next text) in descending id, null ids last."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        out.append((i, t, t[:len(t) - k] + after[:k], after))
    return out


def test_edited_and_next(spark):
    rng = random.Random(4)
    rows = [(i * i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 900)))) for i in range(150)]
    rows += [(7, None), (5, ""), (3, "é👍 one\x0btwo"), (None, "no id here at all"), (10**12, "x" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.edited_pairs(df).collect()}
    assert len(got) == len(rows)
    off = []
    for i, text, edited, after in wanted(rows):
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off += [abs(r.near_edited - true_likeness(text, edited)), abs(r.near_next - true_likeness(text, after))]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2


def test_equal_texts_and_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b  c\td e f\n", "y"), (3, "a b c d e f", "z"), (3, "a b c d e f", "z"), (4, None, "n"), (5, " ", "s")], "doc_id long, text string, fingerprint string")
    rows = fingerprints.edited_pairs(df).collect()
    assert len(rows) == 6
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert all(len(r.fingerprint) == fingerprints.BINS * fingerprints.LOW_BITS // 4 for r in rows)
    assert fingerprints.edited_pairs(df.limit(0)).count() == 0
    one = fingerprints.edited_pairs(df.where("doc_id = 1")).collect()
    assert one[0].near_next == 1.0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = fingerprints.edited_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hot_and_null_ids_lie_in_many_ranges(spark):
    rng = random.Random(8)
    rows = [(i, f"own {i}") for i in range(0, 300, 3)] + [(150, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(200)] + [(-4, "low")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    ranges = dealt.withColumn("_range", fingerprints._ranges(dealt, 32))
    share = {r["_id"]: (r["parts"], r["most"]) for r in ranges.groupBy("_id", "_range").count().groupBy("_id").agg(F.count("*").alias("parts"), F.max("count").alias("most")).collect()}
    assert share[150][0] >= 8 and share[None][0] >= 8 and share[150][1] < 60 and share[None][1] < 60
    hashed = dealt.select("_id", "_text", F.xxhash64("_text").alias("h")).collect()
    ordered = sorted(hashed, key=lambda r: (r["_id"] is None, -(r["_id"] or 0), r["h"]))
    want = sorted((a["_id"] if a["_id"] is not None else -1, a["_text"], b["_text"]) for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    got = fingerprints.with_next(df, "doc_id", "text").select(F.coalesce("_id", F.lit(-1)), "_text", "_next").collect()
    assert sorted(map(tuple, got)) == want
