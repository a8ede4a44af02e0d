"""Exact percentiles that never gather a whole group in one task.

The built-in ``percentile`` keeps every distinct value of a group in a single
buffer, which fails when one group holds a large share of the table.  Here the
order statistics are selected in two steps instead:

1. values are counted per (group, bucket, value); the bucket is a monotone
   logarithmic function of the value, so a group has a bounded number of
   buckets however many rows it has;
2. a running sum over the bucket counts tells which bucket holds each wanted
   rank; only those buckets are ordered value by value.

Every shuffle is on (group, bucket[, value]) after map-side combining, so a hot
group is spread over the cluster and a hot value collapses before the shuffle.

Where a column bounds the rows of each group (``size``), groups of at most
``GATHER_ROWS`` rows are gathered instead: one row with a list per metric, sorted
in place. Their rows travel once, side by side; only larger groups, and rows whose
bound is unknown, take the two steps above. Many small groups inside one bounded
group (the labels of a recording) come from one gathered row of that group, and
numpy sorts the values of many such rows at once.

Three index rules are offered, because the measurements use all three:

* ``linear``  - position p*(n-1), linear interpolation between neighbours;
* ``nearest`` - index round-half-even(p*(n-1));
* ``floor``   - index floor(p*n).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from voxrill.session import cut_lineage

#: Rows up to which a group may be gathered into one row.
GATHER_ROWS = 1 << 16
#: Rows, on average, of a task of rows laid out by key.
TASK_ROWS = 1 << 18
#: Bytes of gathered rows that reach Python at once, or one row.
BATCH_BYTES = 8 << 20

# Buckets per factor of two; about 1000 splits an octave finely enough to
# spread a group while a double still spans a bounded number of buckets.
_PER_OCTAVE = 1024
_SMALLEST = 1e-6


def _bucket(v: Column) -> Column:
    b = F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v) / _SMALLEST) * _PER_OCTAVE)
    # Never NULL for a known value; saying so keeps the planner from adding
    # IS NOT NULL filters that would make the two readers of a shuffle differ.
    return F.coalesce(b.cast("long"), F.lit(0))


def _positions(rule: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, fraction) of percentile ``p`` among ``n`` values."""
    if rule == "linear":
        pos = F.lit(float(p)) * (n - 1)
        lo = F.floor(pos)
        return lo.cast("long"), F.ceil(pos).cast("long"), pos - lo
    if rule == "nearest":
        at = F.bround(F.lit(float(p)) * (n - 1), 0)
    elif rule == "floor":
        at = F.floor(F.lit(float(p)) * n)
    else:
        raise ValueError(f"unknown percentile rule: {rule}")
    at = F.greatest(F.lit(0), F.least(n - 1, at.cast("long")))
    return at, at, F.lit(0.0)


def _covers(rank: Column, start: Column, size: Column) -> Column:
    return (rank >= start) & (rank < start + size)


def _ranked(
    df: DataFrame, keys: list[str], values: Mapping[str, Column], probs: Sequence[float], rule: str
) -> DataFrame:
    """Distinct values of the buckets that hold a wanted rank, with first rank and count.

    The group travels as one struct ``_g`` (the keys and, for several metrics,
    the metric's number ``_m``): NULL keys compare equal inside a struct, so one
    plain equi join and one hash partitioning serve every key type.
    """
    cols = [c.cast("double") + F.lit(0.0) for c in values.values()]  # + 0.0 folds -0.0 into 0.0
    if len(cols) == 1:
        rows = df.select(F.struct(*keys, F.lit(0).alias("_m")).alias("_g"), cols[0].alias("_v"))
    else:
        rows = df.select(*keys, F.posexplode(F.array(*cols)).alias("_m", "_v")).select(F.struct(*keys, "_m").alias("_g"), "_v")
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    # The hash leads every sort below, so rows are radix-sorted on a long instead
    # of compared field by field; the group itself still decides equality.
    counts = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")).select(
        F.xxhash64("_g").alias("_h"), "*", _bucket(F.col("_v")).alias("_b")
    )
    # One shuffle by bucket feeds both the bucket totals and the value ranking.
    at = ["_h", "_b", "_g"]
    counts = counts.repartition(*at)

    by_bucket = Window.partitionBy("_h", "_g").orderBy("_b")
    buckets = (
        counts.groupBy(*at)
        .agg(
            F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_nd"),
            F.min("_v").alias("_v0"), F.max("_v").alias("_v1"), F.min_by("_c", "_v").alias("_c0"),
        )
        .select(
            "*",
            (F.sum("_bc").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bc")).alias("_off"),
            F.sum("_bc").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
        )
    )
    hit = F.lit(False)
    for p in probs:
        lo, hi, _ = _positions(rule, p, F.col("_n"))
        hit = hit | _covers(lo, F.col("_off"), F.col("_bc")) | _covers(hi, F.col("_off"), F.col("_bc"))
    buckets = buckets.where(hit)

    # A bucket with one or two distinct values is already ranked by its totals;
    # only fuller ones (large groups) need their values ordered.
    two = F.when(F.col("_nd") == 2, F.struct(F.col("_v1").alias("v"), (F.col("_bc") - F.col("_c0")).alias("c"), (F.col("_off") + F.col("_c0")).alias("s")))
    one = F.struct(F.col("_v0").alias("v"), F.col("_c0").alias("c"), F.col("_off").alias("s"))
    simple = buckets.where("_nd <= 2").select("_g", "_n", F.explode(F.array_compact(F.array(one, two))).alias("_x"))
    simple = simple.select("_g", F.col("_x.v").alias("_v"), F.col("_x.c").alias("_c"), "_n", F.col("_x.s").alias("_start"))

    # The bounds and the first count are asked for too (always true) so that this
    # reader has the same columns as the other one and shares its shuffles.
    wanted = buckets.where("_nd > 2 AND _v0 <= _v1 AND _c0 > 0").select(*at, "_off", "_n")
    within = Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    full = counts.join(wanted, at).select(
        "_g", "_v", "_c", "_n", (F.col("_off") + F.sum("_c").over(within) - F.col("_c")).alias("_start")
    )
    return simple.unionByName(full)


def _picks(probs: Sequence[float], rule: str, mine: Column, tag: str) -> tuple[list[Column], list[Column]]:
    """Aggregates fetching the two neighbours of each position, and the value built from them."""
    n = F.col("_n")
    aggs = [F.max(F.when(mine, n)).alias(f"_n{tag}")]
    out = []
    for i, p in enumerate(probs):
        lo, hi, _ = _positions(rule, p, n)
        for rank, side in ((lo, "lo"), (hi, "hi")):
            here = mine & _covers(rank, F.col("_start"), F.col("_c"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{tag}_{i}"))
        low, high = F.col(f"_lo{tag}_{i}"), F.col(f"_hi{tag}_{i}")
        out.append(low + (high - low) * _positions(rule, p, F.col(f"_n{tag}"))[2])
    return aggs, out


def quantile_long(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    probs: Sequence[float],
    rule: str = "linear",
) -> DataFrame:
    """(keys, metric, n, q ARRAY<DOUBLE>) for each metric; NULL and NaN are skipped.

    A (group, metric) without any value has no row.
    """
    names = list(values)
    aggs, out = _picks(probs, rule, F.lit(True), "")
    metric = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_g._m") + 1)
    found = _ranked(df, list(keys), values, probs, rule).groupBy("_g").agg(*aggs)
    return found.select(*[F.col(f"_g.{k}").alias(k) for k in keys], metric.alias("metric"), F.col("_n").alias("n"), F.array(*out).alias("q"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    probs: Mapping[str, float],
    rule: str = "linear",
    counts: bool = False,
    size: str | None = None,
    inside: str | None = None,
) -> DataFrame:
    """Wide form: one column ``<metric><suffix>`` per metric and probability.

    ``probs`` maps the column suffix to the probability; with ``counts`` an
    extra ``<metric>_n`` column gives the number of values used. ``size`` names a
    column that is the same in all rows of a group and no less than their number;
    with ``inside``, one of the keys, the same holds for all rows of that key.
    """
    keys, ps = list(keys), list(probs.values())
    if size is not None and inside is not None:
        small, large = by_size(df, size)
        return _inside(small, inside, keys, values, probs, rule, counts).unionByName(quantiles(large, keys, values, probs, rule, counts))
    if size is not None:
        small, large = by_size(df, size)
        found = small.groupBy(*keys).agg(*lists(values)).where(F.greatest(*[F.size(f"_l_{m}") for m in values], F.lit(0)) > 0)
        return found.select(*keys, *picked(values, probs, rule, counts)).unionByName(quantiles(large, keys, values, probs, rule, counts))
    ranked = _ranked(df, keys, values, ps, rule)
    aggs, cols = [], []
    for i, m in enumerate(values):
        mine = F.col("_g._m") == i if len(values) > 1 else F.lit(True)
        more, out = _picks(ps, rule, mine, f"_{m}")
        aggs += more
        cols += [c.alias(f"{m}{suffix}") for c, suffix in zip(out, probs)]
        if counts:
            cols.append(F.coalesce(F.col(f"_n_{m}"), F.lit(0)).cast("long").alias(f"{m}_n"))
    return ranked.groupBy(*[F.col(f"_g.{k}").alias(k) for k in keys]).agg(*aggs).select(*keys, *cols)


def _picked(v: np.ndarray, n: np.ndarray, p: float, rule: str) -> np.ndarray:
    """Percentile ``p`` of each group, its ``n`` sorted values side by side in ``v``; NaN without any."""
    if rule == "linear":
        pos = p * (n - 1)
        lo, hi = np.floor(pos), np.ceil(pos)
    elif rule in ("nearest", "floor"):
        pos = lo = hi = np.clip(np.rint(p * (n - 1)) if rule == "nearest" else np.floor(p * n), 0, np.maximum(n - 1, 0))
    else:
        raise ValueError(f"unknown percentile rule: {rule}")
    out, some = np.full(len(n), np.nan), n > 0
    start = (np.cumsum(n) - n)[some]
    low, high = v[start + lo[some].astype(int)], v[start + hi[some].astype(int)]
    with np.errstate(invalid="ignore"):
        out[some] = low + (high - low) * (pos - lo)[some]
    return out


def _inside(
    df: DataFrame, outer: str, keys: Sequence[str], values: Mapping[str, Column], probs: Mapping[str, float], rule: str, counts: bool
) -> DataFrame:
    """``quantiles`` where the rows that share ``outer`` may be gathered; the other keys are of plain types."""
    inner = [k for k in keys if k != outer]
    cols = [(c.cast("double") + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(values.values())]
    rows = df.select(outer, F.struct(*inner, *cols).alias("_x")).groupBy(outer).agg(F.collect_list("_x").alias("_x"))
    made = [StructField(f"{m}{suffix}", DoubleType()) for m in values for suffix in probs]
    made += [StructField(f"{m}_n", LongType()) for m in values if counts]
    schema = StructType([*df.select(outer, *inner).schema.fields, *made])
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    some, metrics = list(probs.values()), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            x = b.column(1).values.slice(offsets[0], offsets[-1] - offsets[0])
            if not len(x):
                continue
            fields = x.flatten()
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            group, size = row, len(offsets) - 1
            for f in fields[:len(inner)]:
                code = f.dictionary_encode(null_encoding="encode")
                if size * len(code.dictionary) >= 1 << 62:
                    group, size = np.unique(group, return_inverse=True)[1], len(x)
                group, size = group * len(code.dictionary) + code.indices.to_numpy(), size * len(code.dictionary)
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            found, sizes = [], []
            for f in fields[len(inner):]:
                v = f.to_numpy(zero_copy_only=False)
                known = np.flatnonzero(~np.isnan(v))
                v, g = v[known], group[known]
                v, n = v[np.lexsort((v, g))], np.bincount(g, minlength=len(first))
                found += [pa.array(_picked(v, n, p, rule), mask=n == 0) for p in some]
                sizes.append(n)
            full = np.flatnonzero(np.sum(sizes, axis=0) > 0) if metrics else np.zeros(0, int)
            out = [b.column(0).take(pa.array(row[first])), *[f.take(pa.array(first)) for f in fields[:len(inner)]], *found]
            out += [pa.array(n.astype(np.int64)) for n in sizes if counts]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(full)) for c in out], names=schema.names)

    names = [*keys]
    for m in values:
        names += [f"{m}{suffix}" for suffix in probs] + ([f"{m}_n"] if counts else [])
    return rows.mapInArrow(run, schema).select(*names)


def by_size(df: DataFrame, size: str) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that may be gathered, and all others."""
    few = F.coalesce(F.col(size) <= GATHER_ROWS, F.lit(False))
    return df.where(few), df.where(~few)


def lists(values: Mapping[str, Column]) -> list[Column]:
    """Aggregates that gather the sorted values of each metric; for groups of bounded size."""
    cols = {m: c.cast("double") + F.lit(0.0) for m, c in values.items()}
    return [F.sort_array(F.collect_list(F.when(~F.isnan(c), c))).alias(f"_l_{m}") for m, c in cols.items()]


def picked(names: Iterable[str], probs: Mapping[str, float], rule: str = "linear", counts: bool = False) -> list[Column]:
    """The columns of ``quantiles`` read off the lists."""
    cols = []
    for m in names:
        held = F.col(f"_l_{m}")
        n = F.size(held).cast("long")
        for suffix, p in probs.items():
            lo, hi, part = _positions(rule, p, n)
            low, high = F.get(held, lo.cast("int")), F.get(held, hi.cast("int"))
            cols.append((low + (high - low) * part).alias(f"{m}{suffix}"))
        if counts:
            cols.append(n.alias(f"{m}_n"))
    return cols


def bound(counts: DataFrame, n: str) -> int | None:
    """The largest count in the column ``n`` of a written table of counts; None above ``GATHER_ROWS``.

    As one number it tells the planner that no row needs the way for large groups.
    """
    most = counts.agg(F.max(n)).first()[0] or 0
    return most if most <= GATHER_ROWS else None


def sized(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """``df`` with a bound on the rows that share its keys, laid out by them; null where a key is null."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counts = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)))
    held = counts.agg(F.count_if(~known | (F.col(size) > GATHER_ROWS)).alias("rest"), F.sum(size).alias("rows")).first()
    if not held["rest"]:
        # A number of its own: rows multiplied behind this shuffle would fill tasks that were merged by its bytes.
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(held["rows"] or 0) // TASK_ROWS))
        return df.repartition(parts, *keys).withColumn(size, F.lit(GATHER_ROWS))
    return df.join(counts.where(known), list(keys), "left")


def shared(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread ``df`` by all of ``columns`` so that several aggregates read one shuffle.

    Hashing values as well as keys keeps a hot key spread out.  The readers must
    use the same columns, without a filter of their own, to share the exchange.
    """
    return df.repartition(*[F.col(c) for c in columns])


def medians(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], counts: bool = False, size: str | None = None, inside: str | None = None
) -> DataFrame:
    """Exact medians, column named after the metric."""
    return quantiles(df, keys, values, {"": 0.5}, counts=counts, size=size, inside=inside)
