"""Removing word sequences that occur earlier in the corpus.

Non-overlapping blocks of half a window, at fixed places of every text, are the index: any window
covers at least one of them whole. Every rolling window of block size probes it. A place where a probe
meets a block that stands elsewhere is an anchor, and so is the block it meets. Anchors are extended to
all windows that cover them; these, and no others, are compared by a 128-bit digest of their words, and
runs of repeated windows make up the maximal repeats that go.

Index and anchors are held as a pair of Bloom filters of bounded size. A filter can only add windows to
compare, never lose one, so the result is exact for any size. A task compares its own windows first: of
equal ones only the earliest travels, so a passage that a third of the corpus shares crosses the network
once per batch of rows, not once per occurrence.

A null or empty text has no words. Texts with fewer words than a window stay as they are. Documents are
ordered by id (null ids last), rows with equal ids by a hash of the row; a row that repeats another in id
and text is judged like it, and neither counts as earlier. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.llm import bloom, common
from voxrill.llm.registry import query

#: Windows that one bucket compares, about; it bounds the memory of a comparing task.
BUCKET = 1 << 19

_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORTH, _BACKWARD = _powers(_STEP, _CHUNK), _powers(_BACK, _CHUNK)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for texts of up to ``n`` bytes; the usual length is kept, longer ones are made anew."""
    return (_FORTH, _BACKWARD) if n <= _CHUNK else (_powers(_STEP, n), _powers(_BACK, n))


class Words:
    """One text as words joined by single spaces, with the hash of any run of words in constant time."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        self.joined = b" ".join(words)
        raw = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate(([0], gaps + 1))[: self.n]
        self.ends = np.concatenate((gaps, [len(raw)]))[: self.n]
        self._raw = raw

    def hashes(self, size: int) -> np.ndarray:
        """The 64-bit hash of every run of ``size`` words."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        forth, back = _grown(len(self._raw) + 1)
        sums = np.zeros(len(self._raw) + 1, np.uint64)
        np.cumsum(_TABLE[self._raw] * forth[: len(self._raw)], out=sums[1:])
        lo, hi = self.starts[: self.n - size + 1], self.ends[size - 1:]
        return common.mix64((sums[hi] - sums[lo]) * back[lo])

    def digests(self, at: np.ndarray, size: int) -> bytes:
        """The 128-bit digests of the runs of ``size`` words that begin at the given words."""
        d, text = xxhash.xxh3_128_digest, self.joined
        return b"".join([d(text[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist())])


def _crossings(h: np.ndarray, pair: bloom.Pair, block: int) -> np.ndarray:
    """Where a probe meets a block that stands elsewhere; a block meets itself once."""
    hit = pair.seen(h)
    hit[::block] = pair.repeated(h[::block])
    return hit


def _covering(anchors: np.ndarray, block: int, n_windows: int) -> np.ndarray:
    """The windows that begin at an anchor or fewer than ``block`` words before one."""
    seen = np.concatenate(([0], np.cumsum(anchors)))
    at = np.arange(n_windows)
    return np.flatnonzero(seen[np.minimum(at + block, len(anchors))] > seen[at])


_SHIPPED = pa.schema([
    ("bucket", pa.int32()), ("digests", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary()),
    ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
])
_SHIPPED_SQL = "bucket int, digests binary, counts binary, steps binary, rows array<long>, ids array<long>"
_REMOVED = pa.schema([("_row", pa.int64()), ("runs", pa.binary())])


def _earliest(hi: np.ndarray, lo: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest, then place; and which, in that order, share the first place of their digest.

    ``place`` numbers windows in the order of the corpus; rows that repeat each other share numbers.
    """
    by = np.lexsort((place, hi))
    new = np.ones(len(by), bool)
    new[1:] = hi[by][1:] != hi[by][:-1]
    same = ~new[1:] & (lo[by][1:] != lo[by][:-1])
    if same.any():  # two digests share their first half: sort by both
        by = np.lexsort((place, lo, hi))
        new[1:] = (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])
    group = np.cumsum(new) - 1
    return by, place[by][np.flatnonzero(new)[group]] == place[by]


def _runs(rows: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """Merge windows of one row into runs of words: pairs of first word and word after the last."""
    if not len(rows):
        return
    by = np.lexsort((at, rows))
    rows, at = rows[by], at[by]
    edges = np.flatnonzero(np.diff(rows)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(rows)]):
        p = at[lo:hi]
        cut = np.flatnonzero(np.diff(p) > size) + 1
        first, last = p[np.concatenate(([0], cut))], p[np.concatenate((cut - 1, [len(p) - 1]))] + size
        yield int(rows[lo]), np.stack([first, last], 1).astype("<i4").tobytes()


def _places(ids: np.ndarray, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers that order rows by id, null ids last, then by the row's hash."""
    by = np.lexsort((rows, ids, ~known))
    new = np.ones(len(by), bool)
    new[1:] = (rows[by][1:] != rows[by][:-1]) | (ids[by][1:] != ids[by][:-1]) | (known[by][1:] != known[by][:-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _doc_ids(column) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)).astype(np.int64), known


def repeated_runs(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, list of packed runs) for rows with words that a window found earlier covers. Ids are integers."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    text = docs.select(
        common.row_key(docs, id_col, text_col).alias("_row"), docs[id_col].cast("long").alias("_id"), common.body(docs, text_col).alias("_body")
    )
    words = bloom.expected_units(docs, F.octet_length(text_col) / 6)
    bits = bloom.filter_bits(words // block)

    def blocks(batch: pa.RecordBatch):
        found = [Words(raw.as_py()).hashes(block)[::block] for raw in batch.column(0)]
        return bloom.pack(np.concatenate(found), bits) if found else None

    index = bloom.build(text.select("_body").mapInArrow(common.by_batch(blocks), bloom.PACKED), bits)

    def probes(batch: pa.RecordBatch):
        found = []
        for raw in batch.column(0):
            h = Words(raw.as_py()).hashes(block)
            found.append(h[_crossings(h, index.value, block)])
        return bloom.pack(np.unique(np.concatenate(found)), bits) if found else None

    met = bloom.build(text.select("_body").mapInArrow(common.by_batch(probes), bloom.PACKED), bits, twice=False)
    n_buckets = max(1, common.partitions(spark), words // BUCKET)

    def windows(batch: pa.RecordBatch):
        row_hash = np.asarray(batch.column(0))
        ids, known = _doc_ids(batch.column(1))
        order = _places(ids, known, row_hash)
        doc, at, digests, least = [], [], [], []
        for k in np.argsort(order, kind="stable").tolist():
            w = Words(batch.column(2)[k].as_py())
            if w.n < window:
                continue
            h = w.hashes(block)
            anchors = _crossings(h, index.value, block)
            anchors[::block] |= met.value.seen(h[::block])
            found = _covering(anchors, block, w.n - window + 1)
            if len(found):
                doc.append(np.full(len(found), k, np.int64))
                at.append(found)
                digests.append(w.digests(found, window))
                # The least block hash of a window picks its bucket: neighbours mostly share it, equal windows always.
                least.append(np.lib.stride_tricks.sliding_window_view(h, window - block + 1)[found].min(1))
        if not doc:
            return
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        hi, lo, doc, at, least = both[:, 0], both[:, 1], np.concatenate(doc), np.concatenate(at), np.concatenate(least)
        place = order[doc] << 32 | at
        by, first = _earliest(hi, lo, place)
        out: tuple[list, ...] = tuple([] for _ in _SHIPPED)

        def ship(*values):
            for x, v in zip(out, values):
                x.append(v)

        # Windows that come later than one of this batch are decided; they travel with their row only.
        later = by[~first]
        for row, packed in _runs(row_hash[doc[later]], at[later], window):
            ship(row % n_buckets, packed, b"", b"", [row], None)
        # Of rows that repeat each other one speaks for all, since runs are kept by the hash of the row.
        stay = np.zeros(len(doc), bool)
        stay[by[first]] = True
        kept = np.flatnonzero(stay)
        kept = kept[np.concatenate(([True], place[kept][1:] != place[kept][:-1]))]
        where = (common.mix64(least[kept]) % np.uint64(n_buckets)).astype(np.int64)
        kept, where = kept[np.argsort(where, kind="stable")], np.sort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where)) + 1
        for lo_at, hi_at in zip([0, *edges], [*edges, len(where)]):
            part = kept[lo_at:hi_at]
            if not len(part):
                continue
            # In the order of documents and words, so that all but the digests packs well.
            turn = np.concatenate(([0], np.flatnonzero(np.diff(doc[part])) + 1))
            used = doc[part[turn]]
            ship(
                int(where[lo_at]), both[part].tobytes(), np.diff(np.append(turn, len(part))).astype("<i4").tobytes(),
                np.diff(at[part], prepend=0).astype("<i4").tobytes(), row_hash[used].tolist(), [int(i) if k else None for i, k in zip(ids[used], known[used])],
            )
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SHIPPED)], schema=_SHIPPED)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compare the windows of one bucket after the other."""
        bucket, held, n_docs = None, [], 0

        def removed(pairs) -> pa.RecordBatch:
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], schema=_REMOVED)

        def settle():
            digests, doc, at, rows, ids, known = (np.concatenate(x) for x in zip(*held))
            by, first = _earliest(digests[:, 0], digests[:, 1], _places(ids, known, rows)[doc] << 32 | at)
            later = by[~first]
            return removed(_runs(rows[doc[later]], at[later], window))

        for batch in batches:
            passed = []
            for b, digests, counts, steps, rows, ids in zip(*batch.columns):
                if not ids.is_valid:
                    passed.append((rows.values[0].as_py(), digests.as_py()))
                    continue
                if b.as_py() != bucket:
                    if held:
                        yield settle()
                    bucket, held, n_docs = b.as_py(), [], 0
                row_hash = np.asarray(rows.values)
                doc = np.repeat(np.arange(len(row_hash)) + n_docs, np.frombuffer(counts.as_py(), "<i4"))
                at = np.cumsum(np.frombuffer(steps.as_py(), "<i4"), dtype=np.int64)
                held.append((np.frombuffer(digests.as_py(), "<u8").reshape(-1, 2), doc, at, row_hash, *_doc_ids(ids.values)))
                n_docs += len(row_hash)
            if passed:
                yield removed(passed)
        if held:
            yield settle()

    shipped = text.mapInArrow(common.by_batch(windows), _SHIPPED_SQL)
    found = shipped.repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(decide, "_row long, runs binary")
    return found.groupBy("_row").agg(F.collect_list("runs").alias("runs"))


def _stay(n: int, runs) -> np.ndarray:
    """The mask of words that no run covers."""
    edges = np.zeros(n + 1, np.int32)
    for packed in runs:
        pairs = np.frombuffer(packed, "<i4").reshape(-1, 2)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(words before, kept words) of each row of a batch that ends with body and runs."""
    n = batch.num_columns
    for raw, runs in zip(batch.column(n - 2), batch.column(n - 1)):
        words = (raw.as_py() or b"").split()
        if runs.is_valid:
            stay = _stay(len(words), runs.as_py())
            yield len(words), [words[i] for i in np.flatnonzero(stay).tolist()]
        else:
            yield len(words), words


def _with_runs(docs, window, id_col, text_col) -> DataFrame:
    return common.wrap(docs, id_col, text_col).join(repeated_runs(docs, window, id_col, text_col), "_row", "left")


def drop_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that an earlier equal window covers; texts that lose none stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        texts = [b" ".join(kept).decode("utf-8", "replace") if len(kept) < n else None for n, kept in _kept(batch)]
        columns[at] = pa.array([old.as_py() if new is None else new for old, new in zip(columns[at], texts)], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    joined = _with_runs(docs, window, id_col, text_col)
    return joined.select(*common.given(names, True), "_body", "runs").mapInArrow(common.by_batch(apply), docs.schema)


def repeat_digests(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(_kept(batch))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([n for n, _ in parts], pa.int64()), pa.array([n - len(k) for n, k in parts], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in parts]),
            ],
            names=[id_col, "n_words", "n_removed", "kept_sha256"],
        )

    joined = _with_runs(docs, window, id_col, text_col)
    return joined.select(F.col("_id").alias(id_col), "_body", "runs").mapInArrow(
        common.by_batch(apply), f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string"
    )


@query("op9_substring_dedup", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM t)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS body, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t) x
  LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT t.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""")
def op9_substring_dedup(spark, d):
    """Words covered by a window of 20 that starts earlier in the corpus go."""
    return repeat_digests(common.table(spark, d, "documents"), window=20)
