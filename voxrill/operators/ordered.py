"""Ordered scans over long timelines, one block of the timeline per task.

A plain ``Window.partitionBy(recording)`` sorts a whole recording in one task.
These operators cut every timeline into blocks along its order (a span of time,
a file split, ...), run the window inside each (key, block), and stitch the
blocks together with a second window over one summary row per block.  The
result equals the unblocked window for any block function that is monotone in
the order; only the balance depends on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAST = (Window.unboundedPreceding, -1)
_FUTURE = (1, Window.unboundedFollowing)


def _placed(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Add __key and __at: the timeline, and the timeline with its block, each as one struct.

    Structs with NULL fields are equal under plain equality, so windows and the stitching join use the same
    expression, and the rows that a window has dealt out need no second exchange for the join.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    return df.withColumns({"__key": key, "__blk": block}).withColumn("__at", F.struct("__key", "__blk"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    fills: Mapping[str, Column] | None = None,
    back_fills: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running aggregates, last-known and next-known values along ``order``.

    ``sums`` / ``mins`` / ``maxes``: inclusive running aggregate.  ``fills``:
    last non-NULL value up to and including the row.  ``back_fills``: first
    non-NULL value from the row on.  ``order`` must be unique within ``keys``.
    """
    sums, fills, back_fills = dict(sums or {}), dict(fills or {}), dict(back_fills or {})
    mins, maxes = dict(mins or {}), dict(maxes or {})
    keys, order = list(keys), list(order)
    inputs = {**sums, **mins, **maxes, **fills, **back_fills}
    src = _placed(df, keys, block).select("*", *[c.alias(f"__in_{n}") for n, c in inputs.items()])

    rank = F.struct(*[F.col(o) for o in order])
    running = [(n, F.sum) for n in sums] + [(n, F.min) for n in mins] + [(n, F.max) for n in maxes]
    known = [(n, F.max_by) for n in fills] + [(n, F.min_by) for n in back_fills]
    aggs = [f(f"__in_{n}").alias(f"__s_{n}") for n, f in running]
    aggs += [
        f(F.struct(F.col(f"__in_{n}").alias("v")), F.when(F.col(f"__in_{n}").isNotNull(), rank)).alias(f"__s_{n}")
        for n, f in known
    ]
    w = Window.partitionBy("__at.__key").orderBy("__at.__blk")
    carry = src.groupBy("__at").agg(*aggs)
    picked = [f(f"__s_{n}").over(w.rowsBetween(*_PAST)).alias(f"__c_{n}") for n, f in running]
    picked += [F.last(f"__s_{n}", True).over(w.rowsBetween(*_PAST)).alias(f"__c_{n}") for n in fills]
    picked += [F.first(f"__s_{n}", True).over(w.rowsBetween(*_FUTURE)).alias(f"__c_{n}") for n in back_fills]
    carry = carry.select("__at", *picked)

    inside = Window.partitionBy("__at").orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    local = [f(f"__in_{n}").over(up_to).alias(f"__w_{n}") for n, f in running]
    local += [F.last(f"__in_{n}", True).over(up_to).alias(f"__w_{n}") for n in fills]
    local += [F.first(f"__in_{n}", True).over(onward).alias(f"__w_{n}") for n in back_fills]
    out = src.select("*", *local).join(carry, "__at", "left")

    final = {n: F.coalesce(F.col(f"__w_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.least(F.col(f"__w_{n}"), F.col(f"__c_{n}")) for n in mins}
    final |= {n: F.greatest(F.col(f"__w_{n}"), F.col(f"__c_{n}")) for n in maxes}
    final |= {n: F.coalesce(F.col(f"__w_{n}"), F.col(f"__c_{n}.v")) for n in (*fills, *back_fills)}
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add values of the previous / next row along ``order`` (NULL at the ends)."""
    prev, nxt = dict(prev or {}), dict(next or {})
    keys, order = list(keys), list(order)
    src = _placed(df, keys, block)
    rank = F.struct(*[F.col(o) for o in order])
    aggs = []
    if prev:
        src = src.withColumn("__in_p", F.struct(*[c.alias(n) for n, c in prev.items()]))
        aggs.append(F.max_by("__in_p", rank).alias("__tail"))
    if nxt:
        src = src.withColumn("__in_n", F.struct(*[c.alias(n) for n, c in nxt.items()]))
        aggs.append(F.min_by("__in_n", rank).alias("__head"))
    w = Window.partitionBy("__at.__key").orderBy("__at.__blk")
    edges = src.groupBy("__at").agg(*aggs)
    edge_cols = [F.lag("__tail").over(w).alias("__ptail")] if prev else []
    edge_cols += [F.lead("__head").over(w).alias("__nhead")] if nxt else []
    edges = edges.select("__at", *edge_cols)

    inside = Window.partitionBy("__at").orderBy(*order)
    local = [F.lag("__in_p").over(inside).alias("__wp")] if prev else []
    local += [F.lead("__in_n").over(inside).alias("__wn")] if nxt else []
    out = src.select("*", *local).join(edges, "__at", "left")
    cols = [F.coalesce("__wp", "__ptail")[n].alias(n) for n in prev]
    cols += [F.coalesce("__wn", "__nhead")[n].alias(n) for n in nxt]
    return out.select(*df.columns, *cols)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    same: Mapping[str, Column],
    joined: Column,
    name: str = "island",
) -> DataFrame:
    """Number maximal runs of rows; ``joined`` says a row continues the previous one.

    ``same`` names the previous-row values that ``joined`` may use.  A NULL
    ``joined`` (first row, or an unknown comparison) starts a new run.
    """
    step = neighbours(df, keys, order, block, prev=same)
    step = step.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    out = scan(step, keys, order, block, sums={name: F.col("__new")})
    return out.drop("__new", *same)


def trailing_count(df: DataFrame, keys: Sequence[str], at: str, span: int, out: str) -> DataFrame:
    """Rows of the same key with ``at`` in [row - span, row], counted exactly.

    ``at`` is a whole number of ticks.  Each row is seen by its own span-wide
    slot and, as context, by the next one, so a key's rows spread over its slots
    instead of one sorted task.
    """
    slot = F.floor(F.col(at) / span).cast("long")
    rows = df.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__slot", slot + F.col("__copy"))
    w = Window.partitionBy(*keys, "__slot").orderBy(F.col(at)).rangeBetween(-span, 0)
    return (
        rows.withColumn(out, F.count(F.lit(1)).over(w))
        .where(F.col("__copy") == 0)
        .drop("__copy", "__slot")
    )
