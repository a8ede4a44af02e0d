"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class; everything else belongs to a word.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(df: DataFrame, name: str = "text") -> Column:
    """The text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(df[name].cast("binary"), F.lit(b""))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of id and text. Equal rows share it, and every decision taken by it holds for equal rows alike."""
    return F.xxhash64(df[id_col], df[text_col])


def wrap(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_given, _row, _id, _body): the whole row as one struct, so that no name of its columns can clash."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_given"), row_key(docs, id_col, text_col).alias("_row"),
        docs[id_col].alias("_id"), body(docs, text_col).alias("_body"),
    )


def given(names: list[str], as_input: bool = False) -> list[Column]:
    """The columns of a wrapped row; as the input of a Python function under neutral names."""
    return [F.col("_given").getField(c).alias(f"_c{i}" if as_input else c) for i, c in enumerate(names)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]):
    """A function for ``mapInArrow`` that treats each record batch by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            yield from ([out] if isinstance(out, pa.RecordBatch) else out)

    return run


def record_batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sample_by_hash(df: DataFrame, rows: int, key: str, seed: int = 7) -> DataFrame:
    """At most ``rows`` rows, those with the smallest seeded hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(rows)
