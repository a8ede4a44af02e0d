"""Blocked scans and distributed percentiles equal their single-window forms, hot keys included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxrill.operators import ordered as O
from voxrill.operators.quantiles import quantile_long, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 6000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # one key holds 40 % of the rows
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n) / 3.0, "v": rng.normal(0, 50, n), "w": rng.integers(-5, 6, n)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 0.0  # a clamped value that repeats
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != 5, F.col("k")))  # a NULL key
    return df.withColumn("v", F.when(F.col("w") != 3, F.col("v")))


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("width", [10.0, 333.0, 1e9])
def test_scan(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    got = O.scan(
        rows, ["k"], ["t"], F.floor(F.col("t") / width), sums={"s": F.col("w")}, mins={"lo": F.col("w")}, maxes={"hi": F.col("v")},
        fills={"f": F.col("v")}, back_fills={"b": F.col("v")})
    want = (
        rows.withColumn("s", F.sum("w").over(past)).withColumn("lo", F.min("w").over(past)).withColumn("hi", F.max("v").over(past))
        .withColumn("f", F.last("v", True).over(past)).withColumn("b", F.first("v", True).over(future)))
    same(got, want)


def test_neighbours_and_islands(rows):
    w = Window.partitionBy("k").orderBy("t")
    blk = F.floor(F.col("t") / 25)
    got = O.neighbours(rows, ["k"], ["t"], blk, prev={"p": F.col("w")}, next={"n": F.col("v")})
    same(got, rows.withColumn("p", F.lag("w").over(w)).withColumn("n", F.lead("v").over(w)))
    got = O.islands(rows, ["k"], ["t"], blk, {"_p": F.col("w")}, F.col("_p") == F.col("w"), "run")
    new = F.when(F.lag("w").over(w) == F.col("w"), 0).otherwise(1)
    same(got, rows.withColumn("_n", new).withColumn("run", F.sum("_n").over(w)).drop("_n"))


def test_trailing_count(rows):
    r = rows.withColumn("tick", (F.col("t") * 3).cast("long"))
    want = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("tick").rangeBetween(-90, 0)))
    same(O.trailing_count(r, ["k"], "tick", 90, "n"), want)


def naive(values, p, rule):
    s = sorted(values)
    n = len(s)
    if rule == "linear":
        return float(np.quantile(s, p))
    i = round(p * (n - 1)) if rule == "nearest" else int(np.floor(n * p))
    return float(s[max(0, min(n - 1, i))])


@pytest.mark.parametrize("rule", ["linear", "nearest", "floor"])
def test_quantiles(rows, rule):
    probs = {"_a": 0.0, "_b": 0.05, "_c": 0.5, "_d": 0.95, "_e": 1.0}
    got = {r["k"]: r for r in quantiles(rows, ["k"], {"v": F.col("v"), "w": F.col("w")}, probs, rule=rule, counts=True).collect()}
    pdf = rows.toPandas()
    groups = {None if pd.isna(k) else int(k): g for k, g in pdf.groupby("k", dropna=False)}
    assert set(got) == set(groups)
    for k, g in groups.items():
        for m in ("v", "w"):
            vals = g[m].dropna()
            assert got[k][f"{m}_n"] == len(vals)
            for s, p in probs.items():
                assert got[k][f"{m}{s}"] == pytest.approx(naive(vals, p, rule), abs=1e-9)


def test_quantiles_without_keys_and_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-0.0,), (0.0,), (3.0,)], "v double")
    row = quantile_long(df, [], {"v": F.col("v")}, [0.5, 1.0]).collect()[0]
    assert row["n"] == 4 and row["q"] == [0.5, 3.0]


def test_result_does_not_depend_on_partitions(rows):
    a = quantiles(rows.repartition(1), ["k"], {"v": F.col("v")}, {"_m": 0.5})
    same(a, quantiles(rows.repartition(13), ["k"], {"v": F.col("v")}, {"_m": 0.5}))
