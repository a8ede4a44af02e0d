"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each run of five words is hashed once. The leading bits of a hash name its bin, and a bin keeps its
smallest hash. An empty bin borrows from a full one, chosen by a fixed sequence of bins that belongs to
it (optimal densification): two texts that fill the same bins borrow alike. Of each bin's value the low
bits are stored. Two unrelated values agree in b bits with probability 2**-b, which the estimate of the
likeness takes out again.

A null text is empty. Fewer than five words are one run, no words the empty run, so every text has a
fingerprint and equal texts have equal ones. Repeated rows are rows of their own; their order among each
other is that of their text's hash. Rows with a null id come last. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query

BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
SHINGLE = 5
#: Places of the borrowing sequence that are looked up one by one; the rare rest searches all full bins.
TRIES = 12
_REST = 63 - BIN_BITS
_NONE = (1 << _REST) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_hashes(text: Column) -> Column:
    """The hashes of a text's words, white space at the ends not counting."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), f"{common.WHITE}+")
    return F.transform(words, lambda w: F.xxhash64(w))


def _run_hashes(words: Column) -> Column:
    """A non-negative hash for every run of SHINGLE words, or for all words if they are fewer."""

    def run(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]), 1)

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), run)


def _bin(v: Column) -> Column:
    return F.shiftrightunsigned(v, _REST).cast("int")


def _smallest(hashes: Column) -> Column:
    """BINS values in order of the bins: the smallest hash, or the bin's largest possible value if empty."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.shiftleft(i.cast("long"), _REST) + F.lit(_NONE))
    return _let(
        F.sort_array(F.concat(hashes, ends)),
        lambda s: F.filter(s, lambda v, i: (i == 0) | (_bin(v) != _bin(F.get(s, i - 1)))),
    )


def _empty(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_NONE)) == F.lit(_NONE)


def _borrowed(bins: Column, i: Column) -> Column:
    """The value of the first full bin in the sequence of bin ``i``; empty bins are null."""
    tried = [F.get(bins, F.xxhash64(i, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for t in range(TRIES)]
    # After many misses: the full bin that a hash of (bin, value) puts first. Nothing is looked up before it is needed.
    best = F.array_min(F.transform(F.array_compact(bins), lambda v: F.struct(F.xxhash64(i, F.lit(-1), _bin(v)), v.alias("v")))).getField("v")
    return F.coalesce(*tried, best)


def low_values(text: Column) -> Column:
    """The fingerprint as an array of BINS small integers."""
    return _let(
        _word_hashes(text),
        lambda words: _let(
            F.transform(_smallest(_run_hashes(words)), lambda v: F.when(~_empty(v), v)),
            lambda bins: F.transform(
                bins, lambda v, i: F.coalesce(v, _borrowed(bins, i)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("short")
            ),
        ),
    )


def packed(values: Column) -> Column:
    """The low bits of all bins, packed, as lowercase hex digits."""
    digits = F.lit([f"{v:0{LOW_BITS // 4}x}" for v in range(1 << LOW_BITS)])
    return F.array_join(F.transform(values, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bins, corrected for chance, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns fingerprint and fingerprint_values."""
    return docs.withColumn("fingerprint_values", low_values(F.coalesce(docs[text_col], F.lit("")))).withColumn(
        "fingerprint", packed(F.col("fingerprint_values"))
    )


def _ranges(rows: DataFrame, n: int) -> Column:
    """The number of a row's range, of about ``n``, along descending ``_id`` (null last) and ascending hash of ``_text``."""
    found = rows.select(
        F.percentile_approx("_id", F.lit([k / n for k in range(1, n)]), F.lit(10 * n)).alias("edges"), F.count("*").alias("rows"),
        F.count_if(F.col("_id").isNull()).alias("nulls"),
    ).first()
    times = Counter(found["edges"] or [])
    cuts = F.array(*[F.lit(e) for e in sorted(times)]).cast("array<bigint>")
    # An id that is the limit of several ranges has the rows of as many; it gets a range of its own, in so many parts.
    hot = {e: k for e, k in times.items() if k > 1}
    parts = F.when(F.col("_id").isNull(), F.lit(1 + n * found["nulls"] // max(found["rows"], 1)))
    own = F.lit(0)
    if hot:
        shares = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
        own = F.when(F.map_contains_key(shares, F.coalesce("_id", F.lit(min(hot) - 1))), 1).otherwise(0)
        parts = F.coalesce(parts, F.element_at(shares, F.coalesce("_id", F.lit(min(hot) - 1))))
    parts = F.coalesce(parts, F.lit(1).cast("long"))
    by_id = F.when(F.col("_id").isNull(), F.lit(2 * n)).otherwise(2 * F.size(F.filter(cuts, lambda e: e > F.col("_id"))) + own)
    part = F.floor((F.xxhash64("_text") / F.lit(2.0**64) + 0.5) * parts)
    return (by_id * (n + 2) + F.least(part, parts - 1)).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _values, _next, _next_values): each row with the row that follows it in descending id.

    The rows are dealt to ranges of the id; an id with the rows of more than one range, and the rows without an id,
    are cut further by the hash of the text, which comes next in the order. The first row of each range is also
    sent, as a guest, to the end of the range before it (that of the first to the last), so one exchange of the
    rows is enough.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    order = [F.desc_nulls_last("_id"), F.xxhash64("_text"), F.col("_text")]
    dealt = rows.withColumn("_range", _ranges(rows, 4 * common.partitions(spark)))
    # The first row of each range: by id alone first, then of the rows with that id.
    first_ids = dealt.groupBy("_range").agg(F.max("_id").alias("_first"))
    used = [r["_range"] for r in first_ids.select("_range").orderBy("_range").collect()]
    before = F.create_map(*[F.lit(x) for pair in zip(used, [*used[-1:], *used[:-1]]) for x in pair]) if used else F.create_map()
    heads = (
        dealt.join(F.broadcast(first_ids), "_range").where(F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_range").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"), F.first("_id").alias("_id"))
    )
    guests = heads.select("_id", "_text", F.element_at(before, F.col("_range")).alias("_range") if used else F.col("_range"), F.lit(1).alias("_guest"))
    every = dealt.withColumn("_guest", F.lit(0)).unionByName(guests).withColumn("_values", low_values(F.col("_text")))
    window = Window.partitionBy("_range").orderBy("_guest", *order)
    follows = every.withColumns({"_next": F.lead("_text").over(window), "_next_values": F.lead("_values").over(window)})
    return follows.where("_guest = 0").select("_id", "_text", "_values", "_next", "_next_values")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends with the start of the next document."""
    n = F.char_length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.col("_next"), F.lit(1), third))
    rows = with_next(docs, id_col, text_col).withColumns({"_n": n.cast("long"), "_edited": edited}).withColumn("_edited_values", low_values(F.col("_edited")))
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("_values")).alias("fingerprint"), packed(F.col("_edited_values")).alias("edited_fingerprint"),
        likeness(F.col("_values"), F.col("_edited_values")).alias("near_edited"), likeness(F.col("_values"), F.col("_next_values")).alias("near_next"),
    )


@query("op3_fingerprints")
def op3_fingerprints(spark, d):
    """Fingerprints and likeness of every document, its edited text and the next document."""
    return edited_pairs(common.table(spark, d, "documents"))
