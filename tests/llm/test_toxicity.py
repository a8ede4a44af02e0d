"""The grammar clause by clause, learning on planted stems, and held-out accuracy on a test table."""

import random

import pytest
from pyspark.sql import functions as F

from voxrill.llm import toxicity
from voxrill.llm.catalog import QUERIES

LISTED = {"=" + w: 3.0 for w in toxicity.INSULTS}


@pytest.fixture(scope="module")
def grammar():
    return toxicity.Grammar(dict(LISTED))


@pytest.mark.parametrize("text,total", [
    ("", 0.0), ("nothing to see here", 0.0), ("that idiot", 3.0), ("an IDIOT, a moron", 6.0), ("not an idiot", 0.6), ("not one of those idiot", 3.0),
    ("he said idiot", 3.0 * 1.3 * 0.5), ("you idiot", 3.9), ("you. idiot", 3.0), ("idiot. moron.", 6.0), ("i will kill you", 3.9), ("kill the lights", 0.0),
    ("never kill you", 0.0), ('"idiot" was written', 3.0), ("idiots", 0.0), ("half-idiot", 3.0), ("idiot\nyou", 3.0),
])
def test_clauses(grammar, text, total):
    assert grammar.evidence(text)[0] == pytest.approx(total)


def test_state_table_agrees_with_counting(grammar):
    """The fast path over plain words is the table's own step."""
    after = toxicity.compose()[0]
    for state in range(len(after)):
        assert after[state][toxicity.NOTHING] == (state - 8 if state >= 8 else state)


def planted(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["w" + "".join(rng.choice("aeioubcd") for _ in range(6)) for _ in range(60)]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["grobx", "zutti"]) + rng.choice(["ed", "ing", "s", "a"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs + [(n, None), (n + 1, "")], labels + [(n, 0), (n + 5, None), (None, 1)]


def test_learns_stems(spark):
    docs, labels = planted(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    g = toxicity.train(d, lab, F.lit(True))
    assert {"grobx", "zutti"} <= set(g.stems)
    got = {r._given.doc_id: r._score for r in toxicity.scores(d, g).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    for i, y in labels[:300]:
        assert (got[i] >= 0.7) == bool(y)
    kept = toxicity.reject_toxic(d.withColumn("_score", F.lit(1)), g)
    assert kept.columns == ["doc_id", "text", "_score"] and kept.count() == sum(not y for _, y in labels[:300]) + 2


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "you stupid idiot, you moron, you worthless scum"), (2, "a quiet day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.train(d, none, F.lit(True))
    got = {r._given.doc_id: r._score for r in toxicity.scores(d, g).collect()}
    assert got[1] > 0.7 > got[2]
    assert toxicity.scores(d.limit(0), g).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op2_toxicity"](spark, sf).join(lab, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert right >= 0.98 * len(rows) and sum(caught) >= 0.85 * len(caught)


def test_sample_is_bounded_and_settled(spark):
    """A labelled id shared by thousands of texts stays within the bound; labels that disagree are settled alike on every run."""
    docs = [(7, f"text number {i}") for i in range(3000)] + [(i, "same text") for i in range(10, 15)]
    labels = [(7, 1)] + [(i, int(i < 13)) for i in range(10, 15)] + [(11, 0), (11, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    take = lambda df, n: sorted((bytes(r._body), r._y) for r in toxicity.labelled(df, lab, "toxic", F.lit(True), n, "doc_id", "text").collect())
    few = take(d, 10)
    assert len(few) == 10 and few == take(d.repartition(7), 10)
    assert (b"same text", 0) in take(d, 10_000) and len(take(d, 10_000)) == 3001


def test_ties_repeats_and_long_texts(spark, grammar):
    """Equal rows score alike, a very long text is read to its end, and columns with inner names pass through."""
    long = "quiet words here. " * 60_000 + "you idiot, you moron, you scum"
    d = spark.createDataFrame([(1, "you idiot", 1), (1, "you idiot", 1), (2, None, 2), (3, long, 3)], "doc_id long, text string, _given int")
    rows = toxicity.scores(d, grammar).collect()
    assert len(rows) == 4
    got = sorted((r._given.doc_id, r._score) for r in rows)
    assert got[0] == got[1] and grammar.evidence(long)[0] == pytest.approx(3 * 3.0 * 1.3)
