"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written to the shared folder and read again as the next one's input.

Every stage takes null ids, sources and texts, empty and very long texts, repeated rows and empty tables, and
passes columns on that are named like its own. What they give stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.llm import common, linededup, mixing, pieces, simhash, toxicity
from voxrill.session import configure, cut_lineage

#: Bytes of text that a Python worker gets at a time. Workers live on from stage to stage, so their peaks add up
#: with what the JVM holds; small batches keep both low.
BATCH_BYTES = "8m"
#: Documents with this toxicity score or more go.
TOXIC = 0.7
#: Lines in at least so many documents stay only where they occur first: the operator's own default.
LINE_DOCS = 2


def _small_batches(spark: SparkSession) -> None:
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score below the threshold; learned from the labels of these documents.

    Null and empty texts have the score of a text without evidence. Equal texts have equal scores and share their
    fate. An empty table stays empty.
    """
    _small_batches(spark)
    return toxicity.reject_toxic(docs, toxicity.train_for(spark, docs, sf_dir), TOXIC)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document has as well stay in the first of them; lengths follow the texts.

    A null or empty text is one empty line, which never goes. Each row counts as a document, a repeated one as well.
    An empty table stays empty.
    """
    _small_batches(spark)
    kept = linededup.drop_lines(docs, min_docs=LINE_DOCS, min_chars=1, keep="first")
    return kept.withColumn("n_chars", F.char_length("text").cast(kept.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more.

    The row of the smallest id stays, rows without an id coming last, and of rows equal in id and text one. Null and
    empty texts and texts without words are one group. An empty table stays empty.
    """
    _small_batches(spark)
    return simhash.keep_one(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, repeats included, in shards that are shuffled locally.

    A null source is a source of its own. Null texts and texts without words have size 0. Rows that repeat another
    in id, text and source share its fate. An empty table stays empty.
    """
    _small_batches(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to.

    A null text counts as empty and has the end id alone. Every row gives a row, repeated ones as well; an empty
    table gives none.
    """
    _small_batches(spark)
    return pieces.digests(docs, pieces.default_model(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic), ("line dedup", drop_shared_lines), ("near-dedup", keep_one_of_near_copies), ("mixing", mix_sources), ("encoding", encode),
]

#: SQL can express neither the classifier nor the coder; tests check each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = common.table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
