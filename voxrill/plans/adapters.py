"""Domain views over the star-schema test tables.

The tables carry no voice data, so phone rows, timelines, segments, clips,
sessions and progress events are derived from them by fixed expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.functions import scalar as S
from voxrill.plans.registry import view

# 25 labels, one per brand number.
LABELS = [
    "a", "aj", "e", "i˥", "i", "u", "y", "o", "ə", "ɛ", "ɔ", "ɛ̃", "IY1",
    "AH0", "AA1", "EH2", "ER0", "m", "n", "s", "t", "l", "ɐ", "iː", "ʌ",
]
REGION_TAG = {"ASIA": "zh-CN", "AMERICA": "en-US", "EUROPE": "fr-FR", "MIDDLE EAST": "ko-KR", "AFRICA": "sw-KE"}
CHARS = ["ba", "ma", "", "possibility", "ni", "hao"]
SEGMENT_LABEL = {"click": "female", "purchase": "male", "error": "noise", "signup": "music", "view": "noEnergy"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def _sql_case(col: str, mapping: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _with_language(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows with a supplier's columns and its speaker's (speaker_id, sex, language, lang).

    Nation and region are joined to the rows one by one: planners take a join for as large as the product of
    its sides, so a table joined from all three would never be broadcast.
    """
    n, r = (table(spark, d, t) for t in ("nation", "region"))
    tags = r.select("r_regionkey", lookup(REGION_TAG, F.col("r_name")).alias("language")).withColumn("lang", S.normalize_lang(F.col("language")))
    sex = F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("M")
    return (
        rows.join(n, F.col("s_nationkey") == n.n_nationkey)
        .join(tags, n.n_regionkey == tags.r_regionkey)
        .withColumns({"speaker_id": F.col("s_suppkey"), "sex": sex})
    )


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier: (speaker_id, sex, language, lang)."""
    return _with_language(table(spark, d, "supplier"), spark, d).select("speaker_id", "sex", "language", "lang")


def phones(spark: SparkSession, d: str) -> DataFrame:
    """Phone rows with formants: one recording per (supplier, line number)."""
    li, p, s = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    labels = F.array(*[F.lit(x) for x in LABELS])
    brand = F.substring("p_brand", 7, 10).cast("int")
    want = F.when(F.col("l_partkey") % 10 == 0, brand % 25 + 1).otherwise(brand)
    female = F.when(F.col("sex") == "F", 1.0).otherwise(0.0)
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return (
        _with_language(rows, spark, d)
        .select(
            (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("recording_id"),
            "speaker_id", "sex", "language", "lang",
            F.element_at(labels, brand).alias("phoneme"),
            F.element_at(labels, want).alias("expected"),
            F.when(F.col("l_returnflag") != "R", 80 + 2 * F.col("l_quantity") + 70 * female).alias("f0"),
            (300 + F.col("l_extendedprice") / 200 + 60 * female).alias("f1"),
            F.when(F.col("l_discount") != 0, 1200 + 10000 * F.col("l_discount") + 3 * F.col("l_quantity") + 150 * female).alias("f2"),
            (2500 + 10000 * F.col("l_tax") + F.col("l_extendedprice") / 1000).alias("f3"),
            F.col("l_linestatus").alias("batch"),
        )
    )


view("speakers_v", f"""
SELECT s_suppkey AS speaker_id, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  {_sql_case('r_name', REGION_TAG)} AS language,
  CASE r_name WHEN 'AMERICA' THEN 'en' WHEN 'EUROPE' THEN 'fr' WHEN 'MIDDLE EAST' THEN 'ko' ELSE 'zh' END AS lang
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
view("phones_v", f"""
SELECT l_suppkey * 10 + l_linenumber AS recording_id, speaker_id, sex, language, lang,
  {_LIST}[b] AS phoneme,
  {_LIST}[CASE WHEN l_partkey % 10 = 0 THEN b % 25 + 1 ELSE b END] AS expected,
  CASE WHEN l_returnflag <> 'R' THEN 80 + 2 * l_quantity + 70 * fe END AS f0,
  300 + l_extendedprice / 200 + 60 * fe AS f1,
  CASE WHEN l_discount <> 0 THEN 1200 + 10000 * l_discount + 3 * l_quantity + 150 * fe END AS f2,
  2500 + 10000 * l_tax + l_extendedprice / 1000 AS f3,
  l_linestatus AS batch
FROM (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS b, CASE WHEN sex = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fe
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN speakers_v ON l_suppkey = speaker_id)
""", ("speakers_v",))


# Timelines: one recording per user, 30 days compressed to 2592 seconds.
TIMELINE_BLOCK_S = 120.0


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Timed items per recording: (recording_id, t, tick, kind, phone, char, value, k, is_word, ref)."""
    ev = table(spark, d, "events")
    tick = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("int")
    chars = F.array(*[F.lit(c) for c in CHARS])
    labels = F.array(*[F.lit(x) for x in LABELS])
    return ev.select(
        F.col("user_id").alias("recording_id"),
        tick.alias("tick"),
        (tick / F.lit(1e9)).alias("t"),
        F.col("event_type").alias("kind"),
        F.element_at(chars, k % 6 + 1).alias("char"),
        F.element_at(labels, k % 25 + 1).alias("phone"),
        "value",
        k.alias("k"),
        F.col("event_id").alias("ref"),
    )


def time_block(col: str = "t") -> Column:
    return F.floor(F.col(col) / TIMELINE_BLOCK_S)


view("timeline_v", f"""
SELECT user_id AS recording_id, tick, tick / 1e9::DOUBLE AS t, event_type AS kind,
  {"[" + ", ".join(f"'{c}'" for c in CHARS) + "]"}[k % 6 + 1] AS char, {_LIST}[k % 25 + 1] AS phone, value, k, event_id AS ref
FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS tick,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
""")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Label segments per session: (session_id, start_s, end_s, label, confidence)."""
    t = timeline(spark, d)
    return t.select(
        F.col("recording_id").alias("session_id"),
        F.col("t").alias("start_s"),
        (F.col("t") + F.col("value") / 20).alias("end_s"),
        lookup(SEGMENT_LABEL, F.col("kind")).alias("label"),
        F.when(F.col("k") % 10 != 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"),
    )


view("segments_v", f"""
SELECT recording_id AS session_id, t AS start_s, t + value / 20 AS end_s, {_sql_case('kind', SEGMENT_LABEL)} AS label,
  CASE WHEN k % 10 <> 0 THEN least(value / 100, 1.0::DOUBLE) END AS confidence
FROM timeline_v
""", ("timeline_v",))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips of the corpus: (speaker_id, clip_id, path, gender, duration_ms, lang)."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_custkey").alias("speaker_id"),
            F.col("o_orderkey").alias("clip_id"),
            F.concat(F.lit("clip_"), F.col("o_orderkey").cast("string")).alias("path"),
            F.when(F.col("o_custkey") % 3 == 0, "male").otherwise("female").alias("gender"),
            F.floor(F.col("o_totalprice") / 25).cast("long").alias("duration_ms"),
            F.element_at(F.array(*[F.lit(x) for x in ("zh", "en", "fr", "ko")]), F.col("n_nationkey") % 4 + 1).alias("lang"),
        )
    )


view("clips_v", """
SELECT o_custkey AS speaker_id, o_orderkey AS clip_id, 'clip_' || o_orderkey AS path,
  CASE WHEN o_custkey % 3 = 0 THEN 'male' ELSE 'female' END AS gender,
  CAST(floor(o_totalprice / 25) AS BIGINT) AS duration_ms,
  ['zh', 'en', 'fr', 'ko'][n_nationkey % 4 + 1] AS lang
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
