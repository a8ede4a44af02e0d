"""Exact top-k inner-product search over KD-trees.

Rows are dealt to shards of bounded size. Each shard becomes a KD-tree by median splits of its widest
side, down to small leaves, written once with the tight bounding box of every node. Queries are packed in
blocks; a task searches one block in one shard. The box of a node bounds the product of a query with
anything inside; each query keeps the nodes it may still visit in a priority queue, opens the one with the
best bound, and is done when that is below its kth score. A first search in one shard gives each query a
kth score, which the searches in all other shards start from. A shard moves once for each block of
queries, and a block once for each shard; both are large, to make that few times.

Components become integers, floor(scale * x) with x as double, and products are exact: in double precision
where no sum can pass 2**53, with unbounded integers otherwise. Vectors that are null, or hold null or
non-finite components, and rows with a null id take no part. Vectors shorter than the longest count as
filled with zeros. Rows that repeat an id are candidates each by itself, but never for a query of that id;
a repeated query gets one list. Ties go to the smaller id. Empty tables give empty results, and other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

#: At most so many rows in a shard and queries in a block; small tables are dealt to all partitions.
SHARD_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 13
LEAST_SHARD_ROWS = 1024
LEAF_ROWS = 128

_TREE_SQL = "shard int, ids binary, values binary, links binary, low binary, high binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "query_id long, vec_id long, score long"
_LEAST = -(2**63)
_NO_ID = 2**63 - 1


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, values: array<long>) of the rows that take part."""
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        "vec_id", F.transform(x, lambda v: F.floor(v * F.lit(scale))).alias("values")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, short ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten()).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


@dataclass
class Tree:
    """A KD-tree. Rows stand in order of the leaves; ``links`` has (first row, end, left node, right node), -1 without."""

    ids: np.ndarray
    values: np.ndarray
    links: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        """Halves at the median of the widest side, until a node is small enough to be a leaf."""
        order = np.lexsort((ids,))
        links, waiting = [], [(0, len(ids), -1, 0)]
        while waiting:
            start, end, above, side = waiting.pop()
            node = len(links)
            links.append([start, end, -1, -1])
            if above >= 0:
                links[above][side] = node
            if end - start <= leaf_rows:
                continue
            rows = order[start:end]
            part = values[rows]
            width = part.max(0) - part.min(0)
            wide, half = int(width.argmax()), (end - start) // 2
            if width[wide]:  # of equal vectors no side is wide; they are halved by id
                order[start:end] = rows[np.argpartition(part[:, wide], half)]
            waiting += [(start, start + half, node, 2), (start + half, end, node, 3)]
        values = values[order]
        low, high = (np.stack([f(values[a:b], axis=0) for a, b, _, _ in links]) for f in (np.min, np.max))
        return cls(ids[order], values, np.array(links, np.int64), low, high)

    @classmethod
    def of(cls, row: dict, width: int) -> Tree:
        boxes = [_ints(row[c]).reshape(-1, width) for c in ("values", "low", "high")]
        return cls(_ints(row["ids"]), boxes[0], _ints(row["links"]).reshape(-1, 4), boxes[1], boxes[2])


def _tree(width: int, leaf_rows: int):
    def build(table: pa.Table) -> pa.Table:
        t = Tree.build(np.asarray(table.column("vec_id")), _matrix(table.column("values"), width), leaf_rows)
        cells = {"shard": pa.array([table.column("shard")[0].as_py()], pa.int32())}
        cells |= {c: pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for c, x in (
            ("ids", t.ids), ("values", t.values), ("links", t.links), ("low", t.low), ("high", t.high))}
        return pa.table(cells)

    return build


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def _number_type(queries: np.ndarray, values: np.ndarray, width: int):
    """Doubles where every sum of products is an exact double, unbounded integers otherwise."""
    return np.float64 if _largest(queries) * _largest(values) * max(1, width) < 2**53 else object


def search_block(q_ids, queries, kth, kth_ids, tree: Tree, k: int):
    """The best k of a tree for each query: (scores, ids, nodes opened), unused places at the least score.

    ``kth``, ``kth_ids``: what a result has to beat or equal. Queries that open the same node do so together.
    """
    kind = _number_type(queries, np.stack([tree.low, tree.high]), queries.shape[1])
    q, held, low, high = (x.astype(kind) for x in (queries, tree.values, tree.low, tree.high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least_id = [int(tree.ids[a:b].min()) for a, b, _, _ in tree.links]
    best = np.full((len(q), k), _LEAST, object if kind is object else np.float64)
    best_ids = np.full((len(q), k), _NO_ID, np.int64)
    floor, floor_ids = list(kth), list(kth_ids)
    waiting = [[(-b, 0)] for b in (up @ high[0] + down @ low[0]).tolist()]
    active, opened = list(range(len(q))), 0
    while active:
        at, still = defaultdict(list), []
        for i in active:
            if not waiting[i]:
                continue
            bound, node = heappop(waiting[i])
            if -bound < floor[i]:
                continue  # and so is everything that still waits
            still.append(i)
            if -bound > floor[i] or least_id[node] <= floor_ids[i]:
                at[node].append(i)
        for node, who in at.items():
            opened += len(who)
            start, end, *children = tree.links[node].tolist()
            if children[0] >= 0:
                for child in children:
                    for i, b in zip(who, (up[who] @ high[child] + down[who] @ low[child]).tolist()):
                        if b >= floor[i]:
                            heappush(waiting[i], (-b, child))
                continue
            ids = tree.ids[start:end]
            scores = q[who] @ held[start:end].T
            own = ids == q_ids[who][:, None]
            scores[own] = _LEAST
            all_scores = np.concatenate([best[who], scores], axis=1)
            all_ids = np.concatenate([best_ids[who], np.where(own, _NO_ID, ids)], axis=1)
            if kind is object:
                top = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(all_scores, all_ids)])
            else:
                top = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
            for i, score, last in zip(who, best[who, k - 1].tolist(), best_ids[who, k - 1].tolist()):
                if score > floor[i] or score == floor[i] and last < floor_ids[i]:
                    floor[i], floor_ids[i] = score, last
        active = still
    return best, best_ids, opened


def _search(width: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [r for r in rows if r["links"] is None]
        trees = [r for r in rows if r["links"] is not None]
        if not asked or not trees:
            return _FOUND.empty_table()
        q_ids = np.concatenate([_ints(r["ids"]) for r in asked])
        queries = np.concatenate([_ints(r["values"]).reshape(-1, width) for r in asked])
        kth = [x for r in asked for x in r["kth"]]
        kth_ids = [x for r in asked for x in r["kth_ids"]]
        best, ids, _ = search_block(q_ids, queries, kth, kth_ids, Tree.of(trees[0], width), k)
        real = ids != _NO_ID
        return pa.Table.from_arrays(
            [pa.array(np.repeat(q_ids, k).reshape(-1, k)[real]), pa.array(ids[real]), pa.array([int(s) for s in best[real]], pa.int64())], schema=_FOUND
        )

    return run


def _blocks(width: int):
    def pack(table: pa.Table) -> pa.Table:
        values = _matrix(table.column("values"), width)
        kth = [_LEAST if x is None else x for x in table.column("kth").to_pylist()]
        kth_ids = [_NO_ID if x is None else x for x in table.column("kth_id").to_pylist()]
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([np.asarray(table.column("vec_id")).tobytes()], pa.binary()),
            "values": pa.array([values.tobytes()], pa.binary()), "kth": pa.array([kth], pa.list_(pa.int64())), "kth_ids": pa.array([kth_ids], pa.list_(pa.int64())),
        })

    return pack


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the best k other rows of each query.

    ``is_query`` makes a condition from the id column.
    """
    rows = cut_lineage(usable(vectors, scale, id_col, vec_col))
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id"))), F.max(F.size("values"))).first()
    parts = common.partitions(vectors.sparkSession)
    shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, -(-n // parts)))
    shards, blocks, width = max(1, -(-n // shard_rows)), max(1, -(-n_queries // BLOCK_QUERIES)), max(1, width or 0)
    # A row's place in its file takes part, so that a repeated id does not fill one shard.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    trees = cut_lineage(dealt.groupBy("shard").applyInArrow(_tree(width, LEAF_ROWS), _TREE_SQL))
    asked = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    )

    def packed(queries: DataFrame) -> DataFrame:
        sql = "block int, ids binary, values binary, kth array<bigint>, kth_ids array<bigint>"
        return queries.select("block", "vec_id", "values", "kth", "kth_id").groupBy("block").applyInArrow(_blocks(width), sql)

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        """Search each block in its home shard, or in all the others."""
        every = F.sequence(F.lit(0), F.lit(shards - 1))
        mine = F.col("block") % F.lit(shards)
        q = packed(queries).select(
            "block", F.explode(F.array(mine) if home else F.filter(every, lambda s: s != mine)).alias("shard"),
            "ids", "values", *[F.lit(None).cast("binary").alias(c) for c in ("links", "low", "high")], "kth", "kth_ids",
        )
        all_blocks = F.sequence(F.lit(0), F.lit(blocks - 1))
        at_home = F.filter(all_blocks, lambda b: (b % F.lit(shards) == F.col("shard")) == F.lit(home))
        none = F.lit(None).cast("array<bigint>")
        x = trees.select(F.explode(at_home).alias("block"), "shard", "ids", "values", "links", "low", "high", none.alias("kth"), none.alias("kth_ids"))
        return q.unionByName(x).groupBy("block", "shard").applyInArrow(_search(width, k), _FOUND_SQL)

    fresh = asked.withColumns({"kth": F.lit(None).cast("long"), "kth_id": F.lit(None).cast("long")})
    first = cut_lineage(searched(fresh, True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    known = asked.join(kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id")), "vec_id", "left")
    found = first.unionByName(searched(known, False)) if shards > 1 else first
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op10_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs)
WHERE rank <= 10
""")
def op10_topk_search(spark, d):
    """The ten largest integer inner products of every hundredth vector."""
    return top_k(common.table(spark, d, "embeddings"), lambda i: i % 100 == 0)
