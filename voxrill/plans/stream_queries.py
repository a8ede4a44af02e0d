"""Queries over task progress events, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrill.functions import scalar as S
from voxrill.plans.registry import query, view
from voxrill.streaming import ingest as I
from voxrill.streaming import progress as G
from voxrill.streaming import state as ST

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
KIND = {"view": "queue", "click": "progress", "purchase": "progress", "error": "error", "signup": "result"}


def _shape(ev):
    return ev.select(
        F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), S.pick(KIND, F.col("event_type")).alias("type"),
        "event_id", "value", F.col("props").alias("msg_params"))


def progress(spark, d):
    return _shape(spark.read.schema(EVENTS).parquet(f"{d}/events.parquet"))


def progress_stream(spark, d):
    return _shape(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d))


view("progress_v", "SELECT user_id AS task_id, ts, event_id, value, CASE event_type WHEN 'view' THEN 'queue' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'result' ELSE 'progress' END AS type FROM events")


_REPLAY = """
SELECT task_id, event_id, type FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn, max(ts) OVER (PARTITION BY task_id) AS last FROM progress_v)
WHERE rn <= 40 AND date_diff('second', last, TIMESTAMP '2024-01-30 23:00:00') <= 36000
"""
NOW = "2024-01-30 23:00:00"


@query("event_replay", "R1", ("progress_v",), _REPLAY)
def event_replay(spark, d):
    return G.replay(progress(spark, d), F.lit(NOW).cast("timestamp"), keep=40, ttl_s=36000).select("task_id", "event_id", "type")


@query("stream_event_replay", "R1", ("progress_v",), _REPLAY)
def stream_event_replay(spark, d):
    """The same replay from list state of a stream, bounded per task and with a time to live."""
    # The table runs past the time of the replay; so late a watermark lets no task go before it.
    out = G.drain(ST.replay(progress_stream(spark, d), late="2 hours", keep=40, ttl_s=36000), "replay", "update")
    return ST.latest_replay(out, F.lit(NOW).cast("timestamp"), ttl_s=36000).select("task_id", "event_id", "type")


view("states_v", """
SELECT task_id, coalesce(arg_min(CASE type WHEN 'result' THEN 'SUCCESS' ELSE 'FAILURE' END, ts) FILTER (type IN ('result', 'error')),
    arg_max(CASE type WHEN 'queue' THEN 'PENDING' ELSE 'STARTED' END, ts)) AS state, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS events FROM progress_v GROUP BY task_id
""", ("progress_v",))


@query("task_states", "R2", ("states_v",), "SELECT task_id, state, events FROM states_v")
def task_states(spark, d):
    return G.task_states(progress(spark, d)).select("task_id", "state", "events")


@query("stream_task_states", "R2", ("states_v",), "SELECT task_id, state, last_ms, events FROM states_v")
def stream_task_states(spark, d):
    """The same states from a file stream with stored state and timers; of several triggers the last one counts."""
    out = G.drain(ST.task_states(progress_stream(spark, d).select("task_id", "ts", "type"), ttl_s=40 * 86_400), "states", "update")
    last = F.max_by(F.struct("state", "last_ms", "events"), "epoch").alias("_l")
    return out.where("NOT expired").groupBy("task_id").agg(last).select("task_id", "_l.*")


_RATE = """
SELECT task_id, epoch_us(ts) // 600000000 * 600 - o * 600 AS start_s, count(*) AS n FROM progress_v, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS o) GROUP BY ALL
"""


def _rate_out(w):
    return w.select("task_id", F.unix_seconds("start").alias("start_s"), "n")


@query("rate_windows", "R3", ("progress_v",), _RATE)
def rate_windows(spark, d):
    return _rate_out(G.rate_windows(progress(spark, d), "3600 seconds", "600 seconds"))


@query("stream_rate_windows", "R3", ("progress_v",), _RATE)
def stream_rate_windows(spark, d):
    """The same counts from a file stream in update mode, last value per window."""
    w = G.drain(_rate_out(G.rate_windows(progress_stream(spark, d), "3600 seconds", "600 seconds")), "rate", "update")
    return w.groupBy("task_id", "start_s").agg(F.max("n").alias("n"))


_WAITS = """
SELECT e.task_id, date_diff('microsecond', e.ts, (SELECT min(d.ts) FROM progress_v d WHERE d.task_id = e.task_id AND d.type = 'result' AND d.ts >= e.ts)) AS wait_us
FROM progress_v e WHERE e.type = 'queue'
  AND (SELECT min(d.ts) FROM progress_v d WHERE d.task_id = e.task_id AND d.type = 'result' AND d.ts >= e.ts) <= e.ts + INTERVAL 6 HOUR
"""


@query("queue_waits", "R4", ("progress_v",), _WAITS)
def queue_waits(spark, d):
    return G.queue_waits(progress(spark, d), "6 hours").select("task_id", "wait_us")


@query("stream_queue_waits", "R4", ("progress_v",), _WAITS)
def stream_queue_waits(spark, d):
    """The same waits from open enqueues and dequeues that a stream keeps per task."""
    return ST.smallest_waits(G.drain(ST.queue_waits(progress_stream(spark, d), "6 hours"), "waits", "update")).select("task_id", "wait_us")


@query("stream_ingest_stats", "R5 A1", ("progress_v",), """
SELECT type AS phoneme, 1 AS formant, count(value) AS n, round(avg(value), 2) AS mean, round(stddev_samp(value), 4) AS stdev FROM progress_v GROUP BY type
""")
def stream_ingest_stats(spark, d):
    """Observations taken in once through a stream that adds each trigger's moments to the version before."""
    none = F.lit(None).cast("double")
    s = progress_stream(spark, d).select(
        F.col("event_id").cast("string").alias("audio_path"), F.lit(0).alias("seq"), "ts", F.col("type").alias("phoneme"),
        none.alias("f0"), F.col("value").alias("f1"), none.alias("f2"), none.alias("f3"),
    )
    folder = G.shared_folder(spark, "ingest")
    store = I.MomentStore(spark, f"{folder}/store", {"phoneme": "string"})
    I.ingest_moments(s, store, f"{folder}/ckpt").awaitTermination()
    return I.statistics(store.read()).select("phoneme", "formant", "n", F.round("mean", 2).alias("mean"), F.round("stdev", 4).alias("stdev"))
