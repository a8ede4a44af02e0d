"""The additive model on drawn data, its edges, and held-out accuracy on a test table."""

import numpy as np
from pyspark.sql import functions as F

from voxrill.llm import quality
from voxrill.llm.catalog import QUERIES


def test_learns_steps_and_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((6000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.7) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == (y[4000:] > 0.5)).mean() > 0.93
    assert {0, 1} in [set(p) for p in model.pairs]


def test_score_is_the_sum_of_lookups():
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 2] > 0.4).astype(float))
    row = x[7]
    z = model.base + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, row))
    z += sum(t[np.searchsorted(model.pair_cuts[a], row[a], "right"), np.searchsorted(model.pair_cuts[b], row[b], "right")] for (a, b), t in zip(model.pairs, model.pair_tables))
    assert model.score(x[7:8])[0] == 1 / (1 + np.exp(-z))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 50_000, 0), (3, "a", 1), (None, "Some words here.", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.scores(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(docs.limit(0), quality.train(docs.limit(0), labels, F.lit(True))).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op4_quality"](spark, sf).join(lab, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.98 * len(rows)
