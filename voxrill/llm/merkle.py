"""Merkle manifest of a table: sixteen-ary trees per source, proofs and folding by cogrouped superblocks.

A row's leaf is a hash of its columns. Leaves of a source ascend by id; runs of sixteen consecutive nodes
become one node, level by level, until one is left, the source's subroot; subroots in order of the sources
make the root in the same way.

Positions come from one range exchange of (source, id, leaf): texts are hashed where they are read and do
not move. Leaves are cut into superblocks of ``FANOUT ** DEPTH`` consecutive ones. Going up, each superblock
becomes one node, and the nodes of all superblocks are the leaves of the next round, until every source has
one node; the subroots go on as one more group. Going down, the nodes of a superblock and the outer nodes
that complete its proofs are cogrouped in ``applyInPandas``: one call finishes the local levels, joins the
inner siblings to the outer ones and, in the last round, folds each leaf up to the root. A group holds at
most one superblock and one row of outer nodes, whatever the size of a source.

Null values have a leaf text of their own (``-``); a null source is a source and comes first, as do null
ids within a source. Rows with equal ids are leaves of their own, ordered by leaf. A single row's leaf is
its subroot and the root. An empty table gives an empty result. Very long texts are hashed whole. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

FANOUT = 16
#: Levels inside a superblock: 4 096 leaves.
DEPTH = 3


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """H of the values: each ``-`` if null, else its length in UTF-8 bytes, a colon and the value as text."""
    told = []
    for v in values:
        text = v.cast("string")
        told.append(F.when(v.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(b":"), text.cast("binary"))))
    return F.sha2(F.concat(*told), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


# --- one superblock --------------------------------------------------------------------


def levels_of(nodes: list[str], alone: bool, depth: int) -> list[list[str]]:
    """The levels of a superblock, leaves first. Alone in its group it is reduced to one node, else by ``depth`` levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        low = levels[-1]
        levels.append([digest(low[i:i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[int], list[str]]:
    """(place in its run, the run's other nodes, joined) of a node on each level below the top one."""
    places, others = [], []
    for low in levels[:-1]:
        first = at - at % FANOUT
        run = low[first:first + FANOUT]
        places.append(at - first)
        others.append("".join(run[:at - first] + run[at - first + 1:]))
        at //= FANOUT
    return places, others


def fold(leaf: str, places: list[int], others: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for place, rest in zip(places, others):
        cut = place * len(leaf)
        leaf = digest([rest[:cut], leaf, rest[cut:]])
    return leaf


# --- positions ---------------------------------------------------------------------------


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_at``, the place in the group along ``order``, and ``_count``, the size of the group.

    One range exchange; a group may span any number of partitions. Places follow from the number of rows of
    the group in earlier partitions, one small row for each partition and group.
    """
    names = rows.columns
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(common.partitions(rows.sparkSession), group, *order, "_tie")
    laid = cut_lineage(laid.select(*names, F.spark_partition_id().alias("_part")))
    inside = Window.partitionBy("_part", group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    past = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    counts = laid.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", group, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_count")
    )
    return laid.withColumn("_in", F.row_number().over(inside) - 1).join(counts, ["_part", group]).select(
        *names, (F.col("_before") + F.col("_in")).alias("_at"), "_count"
    )


# --- rounds ------------------------------------------------------------------------------

_NODE = "_group string, _at long, _count long, _digest string"
#: What completes the proofs of a superblock, and its source's subroot.
_OUTER = "_group string, _block long, _places array<int>, _others array<string>, _subroot string"


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_at") / FANOUT**depth))


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """The next round's nodes: one for each superblock. A group of one node stays as it is."""
    size = FANOUT**depth

    def reduce_(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_count"].iloc[0])
        top = levels_of(pdf.sort_values("_at")["_digest"].tolist(), n <= size, depth)[-1]
        return pd.DataFrame({"_group": [key[0]], "_at": [key[1]], "_count": [-(-n // size)], "_digest": top})

    return _blocks(nodes, depth).groupBy("_group", "_block").applyInPandas(reduce_, _NODE)


def _ascent(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The rounds of nodes from ``nodes`` up, the last one with a single node for each group."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("_count")).first()[0] or 1) > 1:
        rounds.append(cut_lineage(_up(rounds[-1], depth)))
    return rounds


def _exchange(nodes: DataFrame, outer: DataFrame, finish: Callable[..., pd.DataFrame], schema: str, depth: int) -> DataFrame:
    """``finish(rows, levels, outer places, outer others, subroot)`` of every superblock cogrouped with its outer nodes."""
    size = FANOUT**depth

    def join(key: tuple, mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("_at", ignore_index=True)
        levels = levels_of(mine["_digest"].tolist(), int(mine["_count"].iloc[0]) <= size, depth)
        return finish(mine, levels, list(given["_places"].iloc[0]), list(given["_others"].iloc[0]), given["_subroot"].iloc[0])

    return _blocks(nodes, depth).groupBy("_group", "_block").cogroup(outer.groupBy("_group", "_block")).applyInPandas(join, schema)


def _outer_of(group: pd.Series, block: pd.Series, subroot: pd.Series, levels: list[list[str]], outer_places: list[int], outer_others: list[str]) -> pd.DataFrame:
    """The outer nodes of everything that the nodes of a superblock stand for."""
    found = [siblings(levels, i) for i in range(len(levels[0]))]
    return pd.DataFrame({
        "_group": group, "_block": block, "_places": [p + outer_places for p, _ in found], "_others": [o + outer_others for _, o in found], "_subroot": subroot,
    })


def _descent(rounds: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """Outer nodes of the superblocks of the lowest round, from those of the highest."""

    def pass_down(mine: pd.DataFrame, *nodes) -> pd.DataFrame:
        *nodes, subroot = nodes
        return _outer_of(mine["_group"], mine["_at"], pd.Series(subroot, index=mine.index), *nodes)

    for nodes in reversed(rounds[1:]):
        outer = _exchange(nodes, outer, pass_down, _OUTER, depth)
    return outer


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, when: Column | None = None,
    id_col: str = "doc_id", source_col: str = "source", depth: int = DEPTH,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``tampered``: columns as someone has altered them, in the rows where ``when`` holds; the leaf over them
    is what folding starts from there. Without it every row folds from its own leaf.
    """
    tampered = tampered or {}
    altered = leaf_of(*[tampered.get(c, docs[c]) for c in columns]) if tampered else F.lit(None).cast("string")
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("_id"), F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("_group"), leaf_of(*[docs[c] for c in columns]).alias("_digest"),
        F.when(F.lit(True) if when is None else when, altered).alias("_altered"),
    )
    # Hashed once: the range exchange reads its rows twice, once to find the ranges.
    leaves = cut_lineage(numbered(cut_lineage(rows), "_group", ["_id", "_digest"]))
    if leaves.isEmpty():
        return leaves.select(F.col("_id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in _RESULT])
    ascent = _ascent(leaves, depth)
    # The subroots are one group of nodes, in order of their sources.
    tops = ascent[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_source"), "_digest")
    roots = cut_lineage(numbered(tops, "_group", ["_source"]))
    summit = _ascent(roots.select("_group", "_at", "_count", "_digest"), depth)
    root = summit[-1].first()["_digest"]
    spark = docs.sparkSession
    start = spark.createDataFrame([("", 0, [], [], "")], _OUTER)

    def below(mine: pd.DataFrame, *nodes) -> pd.DataFrame:
        return _outer_of(mine["_source"], pd.Series(0, index=mine.index), mine["_digest"], *nodes[:-1])

    # From the root to the superblocks of subroots, from those to the sources, from those to the superblocks of leaves.
    outer = _descent(ascent, _exchange(roots, _descent(summit, start, depth), below, _OUTER, depth), depth)
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(mine: pd.DataFrame, levels: list[list[str]], outer_places: list[int], outer_others: list[str], subroot: str) -> pd.DataFrame:
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(mine["_digest"], mine["_altered"])):
            at, others = siblings(levels, i)
            at, others = at + outer_places, others + outer_others
            proofs.append(digest(others))
            folded.append(fold(leaf if other is None else other, at, others))
        return pd.DataFrame({"_id": mine["_id"], "leaf": mine["_digest"], "subroot": subroot, "proof_sha256": proofs, "folded_root": folded})

    done = _exchange(leaves, outer, finish, f"_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string", depth)
    return done.select(
        F.col("_id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


_RESULT = (("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean"))


_SQL_LEAF = "sha256(" + " || ".join(
    f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
_MANIFEST_SQL = f"""
WITH RECURSIVE crcs AS (
    SELECT doc_id, xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents)
), leaves AS (
    SELECT doc_id, coalesce('+' || source, '') AS g, {_SQL_LEAF.format(text="text")} AS leaf,
        CASE WHEN crc % 5 = 0 THEN {_SQL_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
    FROM documents JOIN crcs USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), up AS (
    SELECT g, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT g, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 16
), subroots AS (
    SELECT g, level AS height, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
    SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16
), runs AS (
    SELECT g, level, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT '^', level, pos // 16, list(digest ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL
), root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
walk AS (
    SELECT row_number() OVER () AS i, p.g, p.pos, s.pos AS above, s.height, 0 AS level, coalesce(altered, leaf) AS node, '' AS others FROM placed p JOIN subroots s USING (g)
    UNION ALL
    SELECT w.i, w.g, w.pos, w.above, w.height, w.level + 1,
        sha256(array_to_string(nodes[:place_in], '') || node || array_to_string(nodes[place_in + 2:], '')), others || array_to_string(nodes[:place_in] || nodes[place_in + 2:], '')
    FROM (
        SELECT *, CASE WHEN level < height THEN g ELSE '^' END AS of, CASE WHEN level < height THEN level ELSE level - height END AS step,
            CASE WHEN level < height THEN pos // CAST(pow(16, level) AS BIGINT) ELSE above // CAST(pow(16, level - height) AS BIGINT) END AS place,
            place % 16 AS place_in FROM walk
    ) w JOIN runs r ON r.g = w.of AND r.level = w.step AND r.run = w.place // 16
), ends AS (SELECT g, pos, node, sha256(others) AS proof FROM walk, root WHERE level = walk.height + root.height)
SELECT p.doc_id, p.leaf, s.subroot, r.root, e.proof AS proof_sha256, e.node AS folded_root, e.node = r.root AS verified
FROM placed p JOIN subroots s USING (g) JOIN ends e ON e.g = p.g AND e.pos = p.pos, root r
"""


@query("op12_merkle", _MANIFEST_SQL)
def op12_merkle(spark, d):
    """Leaf, subroot, root and proof of every document, and what a fifth of them fold to after tampering."""
    docs = common.table(spark, d, "documents")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return manifest(docs, tampered={"text": lower_ascii(docs["text"])}, when=hit)
