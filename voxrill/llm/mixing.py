"""Mixing sources to target weights by a splitting tree over block quotas.

Targets come from weights by water filling: no source exceeds ``most`` times its size. A source's rows fall
into blocks by a hash. Whole passes over a source draw every block; the rest of a target draws the first
blocks of a seeded permutation, and of the block at the edge as many rows as come nearest to the target. The
block draws of all sources are then divided among output shards exactly, by a tree: each node splits its
quotas between its halves with one multivariate hypergeometric draw, seeded by the node, so that a task can
walk from the root to any shard by itself. A shard takes disjoint stretches of each source's permuted draws
and is shuffled locally.

A null source is a source of its own and sorts last; a null text has size 0, as has a text without words.
Rows of size 0 go where their block goes. Rows that repeat another in id, text and source share its fate,
each counting its own size; a null is told from any value. Other columns are not read, whatever their
names. Empty tables give empty results. A source's totals, one small row for each source, are the only
thing that the driver holds; more than ``MAX_SOURCES`` sources are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

#: Words of a block and block draws of a shard, about.
BLOCK_WORDS = 1 << 17
SHARD_DRAWS = 16
#: A source's permuted blocks are summed up in so many slices, so that no window holds all of them.
SLICE_BITS = 12
#: Sources that the driver lays out, and whose quotas every node of the tree holds.
MAX_SOURCES = 100_000


def fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets: ``share`` of all sizes by weight, none above ``most`` times its size, the excess reshared."""
    total = share * sum(sizes)
    capped = [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        target = [most * s if c else (left * w / weight if weight else 0.0) for s, w, c in zip(sizes, weights, capped)]
        above = [not c and t > most * s for t, s, c in zip(target, sizes, capped)]
        if not any(above):
            return target
        capped = [c or a for c, a in zip(capped, above)]


def walk(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, number of draws) of each source in one shard, walking from the root of the tree.

    The capacities of shards differ by one at most. All shards together use each draw once.
    """
    total = int(quotas.sum())
    low, high = 0, shards
    start = np.zeros(len(quotas), np.int64)
    quotas = quotas.astype(np.int64)
    capacity = lambda a, b: total * b // shards - total * a // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _hypergeometric(rng, quotas, capacity(low, middle))
        if shard < middle:
            quotas, high = left, middle
        else:
            start, quotas, low = start + left, quotas - left, middle
    return start, quotas


def _hypergeometric(rng: np.random.Generator, quotas: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source by source; counts may exceed numpy's limit of 10**9."""
    out, rest = np.zeros(len(quotas), np.int64), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        if not n:
            break
        if not rest:
            out[i] = n
        elif q:
            # Above numpy's limit a normal draw within the possible range; quotas stay exact either way.
            if max(q, rest) < 10**9:
                got = int(rng.hypergeometric(q, rest, n))
            else:
                p = q / (q + rest)
                sd = math.sqrt(max(0.0, n * p * (1 - p) * (q + rest - n) / (q + rest - 1)))
                got = int(round(rng.normal(n * p, sd)))
            out[i] = min(max(got, n - rest, 0), q, n)
        n -= int(out[i])
    return out


def _row(docs: DataFrame, *cols: str) -> Column:
    """A hash of some columns' values that tells a null from every value and from a null elsewhere."""
    return F.xxhash64(*[docs[c] for c in cols], *[docs[c].isNull() for c in cols])


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_row, _id, _source, _size) of every row; the size is its number of words."""
    text = F.coalesce(docs[text_col], F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{common.WHITE}+")))
    return docs.select(
        _row(docs, id_col, text_col, source_col).alias("_row"), docs[id_col].alias("_id"),
        docs[source_col].cast("string").alias("_source"), n.cast("long").alias("_size"),
    )


def _targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> list[tuple]:
    """(source, number, size, target, blocks) of each source, in order of code points, null last."""
    totals = [(r["_source"], r["n"]) for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser column")
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    size = [n for _, n in totals]
    found = fill(size, [weights[i % len(weights)] for i in range(len(size))], share, most)
    return [(s, i, n, t, max(1, -(-n // BLOCK_WORDS))) for i, ((s, n), t) in enumerate(zip(totals, found))]


def _edge_picks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one edge block: the rows that bring it nearest to what is left of the target."""
    pdf = pdf.sort_values(["order", "_row"])
    left, picked = float(pdf["left"].iloc[0]), []
    for row, size in zip(pdf["_row"], pdf["size"]):
        if size <= left:
            picked.append(row)
            left -= size
    # Then single exchanges and additions, while one brings the total nearer.
    inside = pdf["_row"].isin(picked).to_numpy()
    rows, size = pdf["_row"].to_numpy(), pdf["size"].to_numpy().astype(float)
    while left and not inside.all():
        out = np.flatnonzero(~inside)[np.argsort(size[~inside], kind="stable")]
        gone = np.concatenate(([-1], np.flatnonzero(inside)))  # -1: nothing leaves
        wish = left + np.where(gone < 0, 0.0, size[gone])
        near = np.searchsorted(size[out], wish)
        tries = [(abs(wish[g] - size[out[j]]), g, j) for g in range(len(gone)) for j in {max(0, near[g] - 1), min(len(out) - 1, near[g])}]
        off, g, j = min(tries)
        if off >= abs(left):
            break
        if gone[g] >= 0:
            inside[gone[g]] = False
        inside[out[j]] = True
        left = wish[g] - size[out[j]]
    picked = rows[inside]
    return pd.DataFrame({"_row": pd.Series(picked, dtype="int64"), "_number": pdf["_number"].iloc[0]})


def _numbered(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the number of their source and its totals; a null source is one as well."""
    of = sources.withColumnRenamed("_source", "_of")
    return rows.join(of, rows["_source"].eqNullSafe(of["_of"])).drop("_of")


def _running(blocks: DataFrame) -> DataFrame:
    """``blocks`` (_number, order, _block, words) with the words and the number of blocks before each of its source.

    Slices of the permuted order are summed first, so a source's blocks meet slice by slice, never all at once.
    """
    sliced = blocks.withColumn("_slice", F.shiftright("order", 64 - SLICE_BITS))
    past = Window.partitionBy("_number").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("_number", "_slice").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n")).select(
        "_number", "_slice", F.coalesce(F.sum("w").over(past), F.lit(0)).alias("_w"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n")
    )
    inside = Window.partitionBy("_number", "_slice").orderBy("order", "_block").rowsBetween(Window.unboundedPreceding, 0)
    return sliced.withColumns({"_in": F.sum("words").over(inside), "_at": F.count(F.lit(1)).over(inside)}).join(carried, ["_number", "_slice"]).select(
        *blocks.columns, (F.col("_w") + F.col("_in") - F.col("words")).alias("before"), (F.col("_n") + F.col("_at") - 1).alias("rank")
    )


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(drawn, sources, shards): for each distinct row the shards its copies go to, and the sources' totals."""
    spark = rows.sparkSession
    listed = _targets(rows, weights, share, most)
    sources = spark.createDataFrame(listed, "_source string, _number int, source_size long, target double, _blocks long")
    # One row for each source, in order of magnitude far below a block's rows.
    units = _numbered(rows.groupBy("_row", "_source").agg(F.sum("_size").alias("size")), sources).select(
        "_row", "_number", "size", F.pmod(F.xxhash64("_row", F.lit(seed)), "_blocks").alias("_block")
    )
    blocks = units.groupBy("_number", "_block").agg(F.sum("size").alias("words")).withColumn("order", F.xxhash64(F.lit(seed), "_number", "_block"))
    totals = sources.select("_number", "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    laid = _running(blocks).join(totals, "_number").withColumn("passes", passes).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )
    # Sums only grow along the order: first the blocks that fit as a whole, then one at the edge, then none.
    whole = F.col("before") + F.col("words") <= F.col("rest")
    edge = ~whole & (F.col("before") < F.col("rest"))
    laid = cut_lineage(laid.select(
        "_number", "_block", "rank", "passes", whole.alias("whole"), edge.alias("edge"), (F.col("rest") - F.col("before")).alias("left"),
    ))
    again = F.col("whole") | F.col("edge")
    counted = {r["_number"]: (r["blocks"], r["draws"]) for r in laid.groupBy("_number").agg(
        F.count(F.lit(1)).alias("blocks"), (F.sum("passes") + F.count_if(again)).alias("draws")
    ).collect()}
    # Draws: every block once for each pass, and once more for the rest; numbered in permuted order, pass after pass.
    per_pass = spark.createDataFrame([(i, n) for i, (n, _) in counted.items()], "_number int, _all long")
    draws = laid.join(per_pass, "_number").select(
        "_number", "_block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("turn"), "rank", "_all", "passes", again.alias("again"), "edge",
    ).where((F.col("turn") < F.col("passes")) | F.col("again")).select(
        "_number", "_block", (F.col("turn") * F.col("_all") + F.col("rank")).alias("at"), (F.col("edge") & (F.col("turn") == F.col("passes"))).alias("partial"),
    )
    quotas = np.array([counted.get(i, (0, 0))[1] for i in range(len(listed))], np.int64)
    shards = max(1, -(-int(quotas.sum()) // SHARD_DRAWS))

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                start, n = walk(quotas, shards, int(shard), seed)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"_number": at.astype("int32"), "shard": np.int32(shard), "first": start[at], "n": n[at]})

    tree = spark.range(shards).mapInPandas(walks, "_number int, shard int, first long, n long")
    placed = tree.select("_number", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    dealt = draws.join(placed, ["_number", "at"]).groupBy("_number", "_block").agg(
        F.array_sort(F.collect_list(F.when(~F.col("partial"), F.col("shard")))).alias("full"), F.max(F.when(F.col("partial"), F.col("shard"))).alias("part"),
    )
    edges = laid.where("edge").select("_number", "_block", "left")
    # Rows without words always fit, in whatever number they come, and are picked without a look at the others.
    picks = units.where("size > 0").join(edges, ["_number", "_block"]).withColumn("order", F.xxhash64(F.lit(seed + 1), "_row")).groupBy("_number", "_block").applyInPandas(
        _edge_picks, "_row long, _number int"
    ).withColumn("picked", F.lit(True))
    drawn = units.join(dealt, ["_number", "_block"], "left").join(picks, ["_row", "_number"], "left").select(
        "_row", "_number",
        F.concat(F.coalesce("full", F.array().cast("array<int>")), F.when((F.col("picked") | (F.col("size") == 0)) & F.col("part").isNotNull(), F.array("part")).otherwise(F.array().cast("array<int>"))).alias("shards"),
    )
    return drawn, sources, shards


def takes(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: id, size, source_size, target, taken (words over all copies) and the shards of its copies."""
    rows = cut_lineage(sizes(docs, id_col, text_col, source_col))
    drawn, sources, _ = plan(rows, weights, share, most, seed)
    return _numbered(rows, sources).join(drawn, ["_row", "_number"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("shards")).alias("taken"), "shards"
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed rows of ``docs``, repeats included: one partition holds whole shards, each in a local random order."""
    rows = cut_lineage(sizes(docs, id_col, text_col, source_col))
    drawn, sources, shards = plan(rows, weights, share, most, seed)
    given = _numbered(docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_given"), _row(docs, id_col, text_col, source_col).alias("_row"),
        docs[source_col].cast("string").alias("_source"),
    ), sources.select("_source", "_number"))
    copies = given.join(drawn.where(F.size("shards") > 0), ["_row", "_number"]).select("_given", "_row", F.posexplode("shards").alias("_copy", "_shard"))
    n = min(shards, common.partitions(docs.sparkSession))
    # Neighbouring shards in one partition, evenly: a shard goes where its number says, not where a hash does.
    local = copies.repartitionById(n, F.floor(F.col("_shard").cast("long") * n / shards).cast("int")).sortWithinPartitions(
        "_shard", F.xxhash64(F.lit(seed), "_row", "_copy", "_shard")
    )
    return local.select(*common.given(docs.columns))


@query("op5_mixing")
def op5_mixing(spark, d):
    """What a mix by weights 5, 2, 1 to 150 % of all words takes of every document."""
    return takes(common.table(spark, d, "documents"))
