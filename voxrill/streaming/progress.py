"""Task progress events: replay, current state, rate limits and queue waits as tables; starting and draining streams.

State that a stream keeps per task is in ``state.py``, statistics that grow with a stream in ``ingest.py``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxrill.operators.ordered import scan
from voxrill.schemas import PROGRESS
from voxrill.session import shared_folder

# --- fixed values: event retention --------------------------------------------------
EVENTS_TTL_S = 600
EVENTS_KEPT = 100

STATE_OF_TYPE = {"queue": "PENDING", "progress": "STARTED", "result": "SUCCESS", "error": "FAILURE"}


def read_progress(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Progress events arriving as JSON-lines files."""
    r = spark.readStream.schema(PROGRESS)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def replay(events: DataFrame, now: Column, keep: int = EVENTS_KEPT, ttl_s: int = EVENTS_TTL_S) -> DataFrame:
    """The newest ``keep`` events of every task whose last event is at most ``ttl_s`` old.

    Events: (task_id, ts, event_id, ...).  The per-task limit is applied on each
    map task before the shuffle.
    """
    w = Window.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    live = events.groupBy("task_id").agg(F.max("ts").alias("_last")).where(F.timestamp_diff("SECOND", F.col("_last"), now) <= ttl_s)
    return kept.join(live.select("task_id"), "task_id", "left_semi").drop("_rn")


def event_state(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATE_OF_TYPE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def task_states(events: DataFrame) -> DataFrame:
    """Current state per task: a final state once reached, else the latest one."""
    s = event_state(F.col("type"))
    at, final = F.unix_micros(F.col("ts")), s.isin("SUCCESS", "FAILURE")
    # Of equal times: the first final state by name, the last other state by name.
    first = F.min(F.when(final, F.struct(at.alias("at"), s.alias("s"))))
    latest = F.max(F.when(~final, F.struct(at.alias("at"), s.alias("s"))))
    best = F.coalesce(first.getField("s"), latest.getField("s"))
    return events.groupBy("task_id").agg(best.alias("state"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def rate_windows(events: DataFrame, span: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests per task in sliding windows."""
    w = F.window("ts", span, slide)
    return events.withWatermark("ts", late).groupBy("task_id", w).agg(F.count(F.lit(1)).alias("n")).select(
        "task_id", F.col("window.start").alias("start"), "n")


def queue_waits(events: DataFrame, limit: str = "1 hour", block: str = "1 day") -> DataFrame:
    """(task_id, t0, wait_us): of every enqueue (type queue) the time to its first dequeue (type result), within the limit.

    Enqueues and dequeues are merged in order of time, and each enqueue looks ahead to the next dequeue, so
    there is one row for an enqueue and no pair with a later one. A task's timeline is scanned block by block.
    """
    e = events.where(F.col("type").isin("queue", "result")).select(
        "task_id", F.unix_micros("ts").alias("_us"), (F.col("type") == "result").cast("int").alias("_end"), "event_id"
    )
    span = int(pd.Timedelta(block).total_seconds() * 1e6)
    # At equal times an enqueue comes first, so that it finds the dequeue.
    ahead = scan(e, ["task_id"], ["_us", "_end", "event_id"], F.floor(F.col("_us") / span), back_fills={"_next": F.when(F.col("_end") == 1, F.col("_us"))})
    wait = F.col("_next") - F.col("_us")
    most = int(pd.Timedelta(limit).total_seconds() * 1e6)
    return ahead.where((F.col("_end") == 0) & (wait <= most)).select("task_id", F.timestamp_micros("_us").alias("t0"), wait.alias("wait_us"))


def ingest_observations(observations: DataFrame, store: str, checkpoint: str, late: str = "1 day"):
    """Start a stream that adds each observation once to a Parquet store; resumes from its checkpoint.

    Observations: (audio_path, seq, ts, ...); a repeated file or retry inside the
    watermark is dropped.
    """
    once = observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["audio_path", "seq"])
    return once.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_events(events: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends events to a Parquet store by date, the source of replays."""
    dated = events.withColumn("date", F.to_date("ts"))
    return dated.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is available now and return what it wrote, with the number of the trigger as ``epoch``.

    With a ``folder`` of its own a stream goes on from its checkpoint there, and the result holds earlier runs too.
    """
    folder = folder or shared_folder(stream.sparkSession, name)
    out = f"{folder}/out"

    def save(batch: DataFrame, epoch: int) -> None:
        # Overwriting the epoch's own folder keeps a retried batch from doubling.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    written = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    return stream.sparkSession.read.schema(written).option("basePath", out).parquet(f"{out}/epoch=*")
