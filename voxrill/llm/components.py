"""Connected components of a link table by alternating star steps.

A hot node is aggregated before its rows move, and the table of least neighbours is dealt anew after
aggregation: a join whose sides both come from an exchange can be split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")).hint("rebalance")
    return (
        both.join(low, "a").where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest of them. Needs a > b."""
    low = links.groupBy("a").agg(F.min("b").alias("least")).hint("rebalance")
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(low.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the smallest node it reaches.

    Links may repeat, run either way or be loops; an empty table gives an empty result. Each round is
    written to the shared folder, so a lost executor costs one round. Nodes without links do not appear.
    """
    now = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
