"""Dropping lines that many documents share.

Two Bloom filters, for keys seen once and keys seen at least twice, cover every line of the corpus.
Only lines whose key the second filter knows leave their task, as a 128-bit digest; counting those
digests decides exactly which keys are frequent, and in which document a key occurs first.

A null text is one empty line, as is an empty text. Keys shorter than ``min_chars`` never go. Each row
is one document: a repeated row counts twice and is treated twice alike. An empty table gives an empty
result. Other columns pass through; the names added on the way are not visible.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.llm import bloom, common
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

STRIP = b" \t\n\r\x0b\x0c"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(STRIP).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    """The digests of the distinct keys of one text."""
    keys = {line_key(line) for line in text.split(b"\n")}
    return {xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars)}


def _as_hashes(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(_row, drop, own): for rows with frequent keys, the digests whose lines go, and of those the
    digests that the row may show once because it is the first with them (``keep="first"``)."""
    spark = docs.sparkSession
    text = docs.select(common.row_key(docs, id_col, text_col).alias("_row"), docs[id_col].alias("_id"), common.body(docs, text_col).alias("_body"))
    lines = bloom.expected_units(docs, 1 + F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))))
    bits = bloom.filter_bits(lines)

    def hashes(batch: pa.RecordBatch):
        found = [d for raw in batch.column(0) for d in _digests(raw.as_py(), min_chars)]
        return bloom.pack(_as_hashes(found), bits) if found else None

    pair = bloom.build(text.select("_body").mapInArrow(common.by_batch(hashes), bloom.PACKED), bits)

    def suspects(batch: pa.RecordBatch):
        rows, digests = [], []
        for k, raw in enumerate(batch.column(2)):
            found = list(_digests(raw.as_py(), min_chars))
            digests += found
            rows += [k] * len(found)
        if not digests:
            return None
        hit = np.flatnonzero(pair.value.repeated(_as_hashes(digests)))
        if not len(hit):
            return None
        at = pa.array(np.asarray(rows)[hit])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array([digests[i] for i in hit], pa.binary())], names=["_row", "_id", "digest"]
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    found = cut_lineage(text.mapInArrow(common.by_batch(suspects), f"_row long, _id {id_type}, digest binary"))
    first = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    counted = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first")).where(F.col("n") >= min_docs)
    counted = counted.hint("rebalance")  # dealt anew, so that the join can split a hot line
    mine = F.lit(keep == "first") & (F.col("first.row") == F.col("_row"))
    return (
        found.join(counted.select("digest", "first"), "digest")
        .groupBy("_row").agg(F.collect_set("digest").alias("drop"), F.collect_set(F.when(mine, F.col("digest"))).alias("own"))
    )


def _kept_lines(text: bytes, drop: set[bytes], own: set[bytes], min_chars: int) -> tuple[int, list[bytes]]:
    lines = text.split(b"\n")
    if not drop:
        return len(lines), lines
    kept = []
    for line in lines:
        key = line_key(line)
        if _long_enough(key, min_chars):
            digest = xxhash.xxh3_128_digest(key)
            if digest in own:
                own.discard(digest)
            elif digest in drop:
                continue
        kept.append(line)
    return len(lines), kept


def _with_drops(docs, min_docs, min_chars, keep, id_col, text_col) -> DataFrame:
    drops = frequent_lines(docs, min_docs, min_chars, keep, id_col, text_col)
    return common.wrap(docs, id_col, text_col).join(drops, "_row", "left")


def _parts(batch: pa.RecordBatch, min_chars: int):
    """(lines before, kept lines) of each row of a batch that ends with body, drop and own."""
    n = batch.num_columns
    for raw, drop, own in zip(batch.column(n - 3), batch.column(n - 2), batch.column(n - 1)):
        yield _kept_lines(raw.as_py() or b"", set(drop.as_py() or ()), set(own.as_py() or ()), min_chars)


def drop_lines(
    docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the lines whose key occurs in at least ``min_docs`` documents.

    ``keep="first"`` leaves one such line where it occurs first (smallest id, null ids last, then the
    row's own hash); ``keep="none"`` leaves none. A text from which nothing goes stays as it is.
    """
    joined = _with_drops(docs, min_docs, min_chars, keep, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        texts = [b"\n".join(kept) if len(kept) < n else None for n, kept in _parts(batch, min_chars)]
        columns[at] = pa.array([old.as_py() if new is None else new.decode("utf-8", "replace") for old, new in zip(columns[at], texts)], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*common.given(names, True), "_body", "drop", "own").mapInArrow(common.by_batch(apply), docs.schema)


def line_digests(docs: DataFrame, min_docs: int, min_chars: int, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_dropped and the SHA-256 of what ``drop_lines`` leaves of the text."""
    joined = _with_drops(docs, min_docs, min_chars, keep, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(_parts(batch, min_chars))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([n for n, _ in parts], pa.int64()), pa.array([n - len(k) for n, k in parts], pa.int64()),
                pa.array([hashlib.sha256(b"\n".join(k)).hexdigest() for _, k in parts]),
            ],
            names=[id_col, "n_lines", "n_dropped", "kept_sha256"],
        )

    return joined.select(F.col("_id").alias(id_col), "_body", "drop", "own").mapInArrow(common.by_batch(apply), f"`{id_col}` {id_type}, n_lines long, n_dropped long, kept_sha256 string")


@query("op7_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(frequent.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE frequent.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (k) GROUP BY doc_id
""")
def op7_line_dedup(spark, d):
    """Lines whose key at least ten documents share lose every occurrence."""
    return line_digests(common.table(spark, d, "documents"), min_docs=10, min_chars=1, keep="none")
