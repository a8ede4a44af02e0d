"""Fill-in-the-middle by a learned rank index over line boundaries.

The boundaries of a text's lines are the sorted keys of a learned index: a greedy fit lays line segments
through (rank, offset) so that no offset is further than ``ERROR`` bytes from its segment, and the rest,
offset less prediction, is stored in one signed byte for each boundary. A cut after a number of lines is
predicted by the segment that covers its rank and corrected exactly by the stored rest, so neither the
text nor a list of whole offsets is searched. The index of a document is a struct column that can be
kept and used for any number of cuts (``rank_index``, ``cut_at``).

``transform`` cuts each text after two numbers of lines that a hash of seed and id picks, and puts prefix,
suffix and middle in one of two orders between marks; ``restore`` rebuilds the text from output and form.

A null text is empty. Empty texts, texts that hold a mark and a share of the others, set by ``rate``, stay
plain. A null id hashes as no digits. Rows with equal ids and texts have equal results. Very long texts are
indexed whole. An empty table gives an empty result; other columns pass through inside ``_given``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query

# The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far, in bytes, a boundary may be from its segment; its rest then fits a signed byte.
ERROR = 126
#: Boundaries that a segment is tried on at once, doubled while they fit.
_STRIDE = 32


def boundaries(text: bytes) -> np.ndarray:
    """The offset after 0, 1, ... lines; a last line without a line feed counts."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    tail = [] if not text or text.endswith(b"\n") else [len(text)]
    return np.concatenate(([0], ends, tail)).astype(np.int64)


class RankIndex:
    """Error-bounded segments over sorted offsets, and what each prediction is off by.

    Segment k covers ranks from ``first[k]``, starts at ``base[k]`` and rises by ``slope[k]`` a rank.
    """

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, rest: np.ndarray):
        self.first, self.base, self.slope, self.rest = first, base, slope, rest

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Each segment starts at an offset and takes in what a cone of slopes through that point still reaches."""
        first, slope, n, i = [], [], len(offsets), 0
        while i < n:
            low, high, j, stride = 0.0, np.inf, i + 1, _STRIDE
            while j < n:
                dx = np.arange(j - i, min(n, j + stride) - i)
                dy = offsets[i + dx] - offsets[i]
                lows = np.maximum.accumulate(np.maximum((dy - error) / dx, low))
                highs = np.minimum.accumulate(np.minimum((dy + error) / dx, high))
                fits = int(np.searchsorted(lows - highs, 0.0, side="right"))  # lows - highs only grows
                if fits:
                    low, high = float(lows[fits - 1]), float(highs[fits - 1])
                j += fits
                if fits < len(dx):
                    break
                stride *= 2
            first.append(i)
            slope.append((low + high) / 2 if np.isfinite(high) else 0.0)
            i = j
        first_ = np.array(first, np.int64)
        index = cls(first_, offsets[first_], np.array(slope), np.zeros(n, np.int8))
        rest = offsets - index.predict(np.arange(n))
        index.rest = rest.astype(np.int8)
        if (index.rest != rest).any():
            raise ValueError("a boundary is further from its segment than the bound allows")
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[k] + np.rint((ranks - self.first[k]) * self.slope[k]).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offset after so many lines."""
        return self.predict(ranks) + self.rest[ranks]


INDEX = "struct<lines:bigint,first:array<bigint>,base:array<bigint>,slope:array<double>,rest:binary>"


def rank_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_given, index): every row with the index of its text."""

    def build(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            found = [RankIndex.fit(boundaries(raw.as_py())) for raw in t]
            yield pa.array(
                [{"lines": len(x.rest) - 1, "first": x.first, "base": x.base, "slope": x.slope, "rest": x.rest.tobytes()} for x in found],
                pa.struct([("lines", pa.int64()), ("first", pa.list_(pa.int64())), ("base", pa.list_(pa.int64())), ("slope", pa.list_(pa.float64())), ("rest", pa.binary())]),
            )

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_given"), common.body(docs, text_col).alias("_body"))
    return rows.select("_given", F.arrow_udf(build, INDEX)("_body").alias("index"))


def cut_at(index: Column, rank: Column) -> Column:
    """The offset in bytes after ``rank`` lines, from an index column: predicted by a segment, then corrected."""
    before = F.size(F.filter(index["first"], lambda f: f <= rank)) - 1
    predicted = F.get(index["base"], before) + F.rint((rank - F.get(index["first"], before)) * F.get(index["slope"], before)).cast("long")
    byte = F.conv(F.hex(F.substring(index["rest"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return predicted + F.when(byte > 127, byte - 256).otherwise(byte)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the hash of a seed and an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def arrange(text: bytes, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, characters of prefix and middle, output) of one text."""
    index = RankIndex.fit(boundaries(text))
    n = len(index.rest) - 1
    if not text or h[2] % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = index.at(np.sort(np.array([h[0] % (n + 1), h[1] % (n + 1)]))).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, out = ("spm", s + suffix + p + prefix) if h[3] % 100 < spm else ("psm", p + prefix + s + suffix)
    return n, form, _chars(prefix), _chars(middle), out + m + middle


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_given, n, form, prefix_chars, middle_chars, output): every row with its text as a training example.

    Of 100 texts that can be cut about ``rate`` are, and of 100 of those ``spm`` have their suffix first.
    """
    kind = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            rows = [arrange(t.as_py(), draws(seed, i.as_py()), rate, spm) for i, t in zip(ids, texts)]
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            # The output is valid UTF-8 wherever the text was: cuts lie between lines.
            arrays.append(pa.array(columns[4], pa.binary()).cast(pa.string()))
            yield pa.StructArray.from_arrays(arrays, names=["n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_given"), docs[id_col].cast("long").alias("_id"), common.body(docs, text_col).alias("_body"))
    return rows.select("_given", F.arrow_udf(apply, kind)("_id", "_body").alias("_made")).select("_given", "_made.*")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut text holds no mark, so the marks split its output exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


_MIDDLES_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, least(x, y) AS a, greatest(x, y) AS b,
        CASE WHEN coalesce(text, '') = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(lines[:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix
    FROM documents
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


@query("op13_middles", _MIDDLES_SQL)
def op13_middles(spark, d):
    """Every document cut into prefix, middle and suffix, rearranged and rebuilt."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(common.table(spark, d, "documents")).select(
        F.col("_given.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
