"""Statistics that grow with a stream: mergeable moments in a table of versions.

A trigger adds the moments of its own rows to the last version and writes the sum as a version of its own,
named by the trigger. Work and state so follow the new rows and the number of groups, not what was seen
before. A trigger that is run again, after a failure, starts from the version before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxrill.operators.phones import FORMANTS

_MOMENTS = ["n", "mean", "m2", "max", "min"]


def moments_of(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, formant, n, mean, m2, max, min) of wide rows; ``m2`` is the sum of squared deviations. Formants without values have no row."""
    cells = []
    for i, f in enumerate(FORMANTS):
        c = F.col(f)
        cells.append(F.struct(
            F.lit(i).alias("formant"), F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"), F.max(c).alias("max"), F.min(c).alias("min"),
        ))
    wide = observations.groupBy(*keys).agg(F.array(*cells).alias("_cells"))
    return wide.select(*keys, F.explode("_cells").alias("_c")).select(*keys, "_c.*").where("n > 0")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of two sets of rows put together, group by group, without a large difference of squares."""
    on = [*keys, "formant"]
    a = old.select(F.struct(*on).alias("_key"), F.struct(*_MOMENTS).alias("_a"))
    b = new.select(F.struct(*on).alias("_key"), F.struct(*_MOMENTS).alias("_b"))
    both = a.join(b, "_key", "full_outer")
    x, y = F.col("_a"), F.col("_b")
    n = x["n"] + y["n"]
    apart = y["mean"] - x["mean"]
    joined = F.struct(
        n.alias("n"), (x["mean"] + apart * y["n"] / n).alias("mean"), (x["m2"] + y["m2"] + apart * apart * x["n"] * y["n"] / n).alias("m2"),
        F.greatest(x["max"], y["max"]).alias("max"), F.least(x["min"], y["min"]).alias("min"),
    )
    return both.select("_key.*", F.when(y.isNull(), x).when(x.isNull(), y).otherwise(joined).alias("_m")).select(*on, "_m.*")


def latest_version(store: DataFrame, before: int | None = None) -> DataFrame:
    """The newest version in a table of versions, or the newest one before a number."""
    older = store if before is None else store.where(F.col("version") < before)
    last = older.agg(F.max("version")).first()[0]
    return older.where(F.col("version") == (-1 if last is None else last)).drop("version")


def statistics(store: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and range per group in the newest version."""
    return latest_version(store).withColumn("stdev", F.sqrt(F.col("m2") / (F.col("n") - 1))).drop("m2")


class MomentStore:
    """A table of versions under ``path``."""

    def __init__(self, spark, path: str, keys: dict[str, str]):
        self.spark, self.path, self.keys = spark, path, keys
        kinds = [*(f"`{k}` {t}" for k, t in keys.items()), "formant int, n long, mean double, m2 double, max double, min double"]
        self.schema = ", ".join(kinds)
        # Version -1 holds nothing, so that there always is a version before a trigger's.
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/version=-1")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, version long").parquet(self.path)

    def add(self, batch: DataFrame, epoch: int) -> None:
        """The sink of a stream: what the trigger ``epoch`` adds, on top of the version before it."""
        keys = list(self.keys)
        new = merge(latest_version(self.read(), epoch), moments_of(batch, keys), keys)
        # One row for each group and formant: a single file.
        new.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={epoch}")


def ingest_moments(observations: DataFrame, store: MomentStore, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Start a stream that adds each observation once to a store of moments; resumes from its checkpoint.

    Observations: (audio_path, seq, ts, keys, f0 to f3); a repeated file or retry inside the watermark is dropped.
    """
    once = observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["audio_path", "seq"])
    return once.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
