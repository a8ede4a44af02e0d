"""Queries over label segments, pitch frames, signals and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators import phones as P
from voxrill.operators import sessions as SE
from voxrill.operators.quantiles import sized
from voxrill.plans import adapters as A
from voxrill.plans import phone_queries as PQ
from voxrill.plans.phone_queries import PITCH_ZONE_SQL, r6, zone_sql
from voxrill.plans.registry import query, view
from voxrill.session import cut_lineage

SESSION = ["session_id"]

view("seg_v", """
SELECT session_id, round(start_s, 2) AS start_s, round(end_s, 2) AS end_s, label, round(confidence, 4) AS confidence, duration_s
FROM (SELECT *, round(end_s - start_s, 2) AS duration_s FROM segments_v) WHERE label IN ('female', 'male') OR duration_s >= 0.5
""", ("segments_v",))


def segs(spark, d):
    return SE.shape_segments(A.segments(spark, d))


@query("segment_shaping", "P16", ("seg_v",), "SELECT * FROM seg_v")
def segment_shaping(spark, d):
    return segs(spark, d)


@query("voiced_gate", "P17", ("seg_v",), """
SELECT session_id, round(sum(duration_s) FILTER (label IN ('female', 'male')), 4) AS voiced_s FROM seg_v GROUP BY ALL
HAVING sum(duration_s) FILTER (label IN ('female', 'male')) >= 60
""")
def voiced_gate(spark, d):
    return SE.voiced_gate(segs(spark, d), SESSION, 60.0).withColumn("voiced_s", F.round("voiced_s", 4))


view("session_v", """
SELECT session_id, coalesce(sum(duration_s) FILTER (label = 'female'), 0) AS female_s, coalesce(sum(duration_s) FILTER (label = 'male'), 0) AS male_s,
  sum(duration_s) AS total_s,
  coalesce(sum(confidence * duration_s) FILTER (label IN ('female', 'male')) / nullif(sum(duration_s) FILTER (label IN ('female', 'male') AND confidence IS NOT NULL), 0), 0) AS c_all,
  coalesce(sum(confidence * duration_s) FILTER (label = 'female') / nullif(sum(duration_s) FILTER (label = 'female' AND confidence IS NOT NULL), 0), 0) AS c_f,
  coalesce(sum(confidence * duration_s) FILTER (label = 'male') / nullif(sum(duration_s) FILTER (label = 'male' AND confidence IS NOT NULL), 0), 0) AS c_m,
  100 * coalesce(sum(CASE label WHEN 'female' THEN confidence ELSE 1 - confidence END * duration_s) FILTER (label IN ('female', 'male'))
    / nullif(sum(duration_s) FILTER (label IN ('female', 'male') AND confidence IS NOT NULL), 0), 0) AS score
FROM seg_v GROUP BY session_id
""", ("seg_v",))
view("dominant_v", """
SELECT *, CASE WHEN female_s + male_s > 0 THEN female_s / (female_s + male_s) ELSE 0 END AS ratio,
  CASE WHEN female_s + male_s > 0 THEN CASE WHEN female_s / (female_s + male_s) >= 0.5 THEN 'female' ELSE 'male' END END AS dominant_label
FROM session_v
""", ("session_v",))


@query("session_summary", "A12 A11", ("dominant_v",), """
SELECT session_id, round(female_s, 4) AS female_s, round(male_s, 4) AS male_s, round(total_s, 4) AS total_s, round(ratio, 4) AS female_ratio,
  dominant_label, round(c_all, 4) AS overall_confidence,
  round(CASE dominant_label WHEN 'female' THEN c_f WHEN 'male' THEN c_m ELSE 0 END, 4) AS dominant_confidence, round(score, 1) AS femininity_score
FROM dominant_v
""")
def session_summary(spark, d):
    s = SE.session_summary(segs(spark, d), SESSION)
    return s.select("session_id", *[F.round(c, 4).alias(c) for c in ("female_s", "male_s", "total_s")], "female_ratio", "dominant_label", "overall_confidence", "dominant_confidence", "femininity_score")


@query("weighted_confidence", "A10", ("session_v",), """
SELECT session_id, round(c_all, 4) AS voiced, round(c_f, 4) AS female, round(c_m, 4) AS male FROM session_v
""")
def weighted_confidence(spark, d):
    c, w, label = F.col("confidence"), F.col("duration_s"), F.col("label")
    return segs(spark, d).groupBy("session_id").agg(
        F.round(SE.weighted(c, w, label.isin("female", "male")), 4).alias("voiced"),
        F.round(SE.weighted(c, w, label == "female"), 4).alias("female"),
        F.round(SE.weighted(c, w, label == "male"), 4).alias("male"),
    )


@query("label_ratio", "A14", ("seg_v",), """
SELECT session_id, round(f, 4) AS female_ratio, round(m, 4) AS male_ratio, round(greatest(0, 1 - f - m), 4) AS other_ratio FROM (
  SELECT session_id, coalesce(sum(duration_s) FILTER (label = 'female'), 0) / sum(duration_s) AS f,
    coalesce(sum(duration_s) FILTER (label = 'male'), 0) / sum(duration_s) AS m FROM seg_v GROUP BY session_id)
""")
def label_ratio(spark, d):
    return SE.label_ratio(segs(spark, d), SESSION, F.sum("duration_s"))


@query("confidence_distribution", "A13", ("seg_v",), """
SELECT session_id, count(*) AS n, round(avg(confidence), 3) AS mean, round(stddev_pop(confidence), 6) AS std,
  count(*) FILTER (confidence > 0.9) AS high, count(*) FILTER (confidence < 0.1) AS low,
  round(quantile_cont(confidence, 0.1), 6) AS c_p10, round(quantile_cont(confidence, 0.5), 6) AS c_p50, round(quantile_cont(confidence, 0.9), 6) AS c_p90
FROM seg_v WHERE label IN ('female', 'male') AND confidence IS NOT NULL GROUP BY session_id
""")
def confidence_distribution(spark, d):
    return SE.confidence_distribution(segs(spark, d), SESSION).select("session_id", "n", "high", "low", F.round("mean", 3).alias("mean"), *r6("std", "c_p10", "c_p50", "c_p90"))


# --- pitch frames --------------------------------------------------------------------


def frames(spark, d):
    return A.timeline(spark, d).select(
        F.col("recording_id").alias("session_id"), (60 + F.col("value")).alias("f0"), (F.col("kind") != "view").alias("voiced"),
        (5 + F.col("recording_id") % 10).cast("double").alias("recording_s"),
    )


view("panel_v", f"""
SELECT session_id, CASE WHEN v >= 1 THEN round(q[2], 1) END AS median_hz, CASE WHEN v >= 1 THEN round(q[1], 1) END AS p25_hz,
  CASE WHEN v >= 1 THEN round(q[3], 1) END AS p75_hz, round(v, 2) AS voiced_s,
  CASE WHEN v >= 1 THEN {PITCH_ZONE_SQL.format(v='q[2]')} END AS range_zone,
  CASE WHEN v >= 1 THEN 'ok' WHEN recording_s < 10 THEN 'short_recording' ELSE 'insufficient_voiced' END AS reliability
FROM (SELECT recording_id AS session_id, 5 + recording_id % 10 AS recording_s, count(*) FILTER (kind <> 'view') * (512 / 22050.0::DOUBLE) AS v,
        quantile_cont(60 + value, [0.25, 0.5, 0.75]) FILTER (kind <> 'view') AS q FROM timeline_v GROUP BY ALL)
""", ("timeline_v",))


@query("frame_track_panel", "A15", ("panel_v",), "SELECT * FROM panel_v")
def frame_track_panel(spark, d):
    return SE.frame_panel(frames(spark, d), SESSION)


@query("preferred_median", "P23", ("panel_v", "summary_v"), f"""
SELECT session_id, CASE WHEN median_pitch > 0 THEN round(median_pitch, 1) ELSE median_hz END AS median_hz, p25_hz, p75_hz, voiced_s,
  CASE WHEN median_pitch > 0 THEN {PITCH_ZONE_SQL.format(v='median_pitch')} ELSE range_zone END AS range_zone, reliability,
  CASE WHEN median_pitch > 0 THEN 'recording' END AS median_source
FROM panel_v LEFT JOIN summary_v ON session_id = recording_id
""")
def preferred_median(spark, d):
    rec = PQ.summaries(spark, d).select(F.col("recording_id").alias("session_id"), "median_pitch")
    return SE.prefer_recording_median(SE.frame_panel(frames(spark, d), SESSION), rec, SESSION, "median_pitch")


# --- signal gate -------------------------------------------------------------------------

view("signal_v", """
SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN label % 4 = 3 THEN 0.0::DOUBLE
  WHEN vec_id % 7 = 0 THEN 0.001::DOUBLE * x::DOUBLE WHEN label % 4 = 1 THEN 8 * x::DOUBLE ELSE 2 * x::DOUBLE END) AS x FROM embeddings
""")
view("levels_v", """
SELECT *, list_sum([CASE WHEN 20 * log10(greatest(1e-5, r) / greatest(1e-5, list_max(fr))) > -30
    THEN least(i * 4, 64) - least((i - 1) * 4, 64) ELSE 0 END for r, i in fr]) / 64.0::DOUBLE AS act FROM (
  SELECT vec_id, x, len(list_filter(x, lambda v: abs(v) >= 0.99)) / len(x) AS clip,
    sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms,
    list_transform(range(0, 17), lambda f: sqrt(coalesce(list_sum(list_transform(x[greatest(f * 4 - 8, 0) + 1 : least(f * 4 + 8, 64)], lambda v: v * v)), 0) / 16)) AS fr
  FROM signal_v)
""", ("signal_v",))


def signals(spark, d):
    e = A.table(spark, d, "embeddings")
    gain = F.when(F.col("label") % 4 == 3, 0.0).when(F.col("vec_id") % 7 == 0, 0.001).when(F.col("label") % 4 == 1, 8.0).otherwise(2.0)
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * gain).alias("x"))


@query("signal_gate", "A16 M3", ("levels_v",), """
SELECT vec_id, round(clip, 6) AS clipping_ratio, round(CASE WHEN rms > 0 THEN 20 * log10(rms) END, 4) + 0.0 AS rms_dbfs,
  round(CASE WHEN rms > 0 THEN act ELSE 0 END, 6) AS voiced_ratio,
  concat_ws(',', CASE WHEN clip > 0.005 THEN 'clipping' END, CASE WHEN rms = 0 OR 20 * log10(rms) < -55 THEN 'too_quiet' END,
    CASE WHEN (CASE WHEN rms > 0 THEN act ELSE 0 END) < 0.10 THEN 'insufficient_voicing' END) AS codes
FROM levels_v
""")
def signal_gate(spark, d):
    g = SE.signal_gate(signals(spark, d), "x", frame=16, hop=4)
    return g.select(
        "vec_id", F.round("clipping_ratio", 6).alias("clipping_ratio"), (F.round("rms_dbfs", 4) + 0.0).alias("rms_dbfs"),
        F.round("voiced_ratio", 6).alias("voiced_ratio"), F.array_join(F.transform("violations", lambda v: v["code"]), ",").alias("codes"),
    )


@query("gate_messages", "M4", ("timeline_v",), """
SELECT ref, CASE WHEN k % 4 = 3 THEN 'plain ' || k WHEN k % 4 = 2 THEN '{bad' ELSE 'm' || k END AS msg,
  CASE WHEN k % 4 < 2 THEN 'audioGate.x' END AS msg_key,
  round(CASE WHEN k % 4 = 0 THEN value::DOUBLE * 100 END, 1) AS pct, round(CASE WHEN k % 4 = 1 THEN value END, 1) AS db FROM timeline_v
""")
def gate_messages(spark, d):
    body = lambda m: F.concat(
        F.lit('{"error_code":"audio_quality_rejected","message":"m'), F.col("k").cast("string"),
        F.lit(f'","violations":[{{"metric":"{m}","i18n_key":"audioGate.x","value":'), F.col("value").cast("string"), F.lit("}]}"),
    )
    k = F.col("k") % 4
    text = (
        F.when(k == 3, F.concat(F.lit("plain "), F.col("k").cast("string"))).when(k == 2, "{bad")
        .when(k == 0, body("clipping_ratio")).otherwise(body("rms_dbfs"))
    )
    return A.timeline(spark, d).select("ref", SE.gate_message(text).alias("g")).select("ref", "g.*")


# --- alignment, panels, advice ---------------------------------------------------------------

view("align_v", """
SELECT t.recording_id, lang, tok, n, first_s, last_s, total_s FROM
  (SELECT recording_id, count(*) AS n, min(t) AS first_s, max(t) + 0.1 AS last_s FROM timeline_v WHERE kind <> 'signup' GROUP BY ALL) t
  JOIN (SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' ELSE 'zh' END AS lang,
    CASE WHEN lang IN ('en', 'fr') THEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) ELSE len(regexp_extract_all(text, '[一-鿿]')) END AS tok
    FROM documents) ON doc_id = t.recording_id JOIN session_v ON session_id = t.recording_id
""", ("timeline_v", "session_v"))
view("quality_v", """
SELECT recording_id, ratio, cover, coalesce(ratio < CASE WHEN lang = 'zh' THEN 0.8 ELSE 1.5 END, false) OR coalesce(cover < 0.3, false) AS low_quality
FROM (SELECT *, CASE WHEN tok > 0 THEN n / tok END AS ratio, least(1.0::DOUBLE, greatest(0.0::DOUBLE, last_s - first_s) / (total_s * 20)) AS cover FROM align_v)
""", ("align_v",))


@query("alignment_quality", "A9 F9", ("quality_v",), """
SELECT recording_id, round(ratio, 3) AS phone_ratio, round(cover, 3) AS coverage, low_quality FROM quality_v
""")
def alignment_quality(spark, d):
    span = A.timeline(spark, d).where("kind <> 'signup'").groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_s"), (F.max("t") + 0.1).alias("last_s"))
    doc = A.table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), S.normalize_lang(F.col("lang")).alias("lang"), "text")
    total = SE.session_summary(segs(spark, d), SESSION).select(F.col("session_id").alias("recording_id"), "total_s")
    j = span.join(doc, "recording_id").join(total, "recording_id")
    q = SE.alignment_quality(F.col("lang"), S.token_count(F.col("lang"), F.col("text")), F.col("n"), F.col("first_s"), F.col("last_s"), F.col("total_s") * 20)
    return j.select("recording_id", q.alias("q")).select("recording_id", "q.*")


@query("weakness_vowels", "T2 P15", ("vowel_v",), """
SELECT recording_id, vowel, n, resonance_med, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY resonance_med, n DESC, vowel) AS rank FROM vowel_v
  WHERE n >= 2 AND is_vowel AND resonance_med < 0.40) WHERE rank <= 3
""")
def weakness_vowels(spark, d):
    return SE.weakness_vowels(PQ.vowels(spark, d), ["recording_id"]).select("recording_id", "vowel", "n", "resonance_med", "rank")


@query("vowel_levels", "T3 P15", ("vowel_v",), """
SELECT recording_id, string_agg(lvl || ':' || vowel, ' ' ORDER BY CASE lvl WHEN 'weak' THEN 0 WHEN 'low' THEN 1 ELSE 2 END, resonance_med, n DESC, vowel) AS levels
FROM (SELECT *, CASE WHEN resonance_med >= 0.65 THEN 'good' WHEN resonance_med >= 0.4 THEN 'low' ELSE 'weak' END AS lvl FROM vowel_v) GROUP BY recording_id
""")
def vowel_levels(spark, d):
    v = SE.vowel_levels(PQ.vowels(spark, d), ["recording_id"])
    return v.select("recording_id", F.array_join(F.transform("per_vowel", lambda x: F.concat(x["level_key"], F.lit(":"), x["vowel"])), " ").alias("levels"))


view("rpanel_v", f"""
SELECT *, {zone_sql('panel_score', 'lang')} AS zone_key FROM (
  SELECT s.recording_id, s.lang, any_value(median_pitch) AS median_pitch, count(v.n) FILTER (v.n >= 2) AS k, any_value(n_phones) AS n_phones,
    coalesce(quantile_cont(CASE WHEN n >= 2 THEN resonance_med END, 0.5), any_value(median_resonance)) AS panel_score
  FROM summary_v s LEFT JOIN vowel_v v ON s.recording_id = v.recording_id GROUP BY s.recording_id, s.lang)
""", ("summary_v", "vowel_v"))


@query("resonance_panel", "P20 A8", ("rpanel_v",), """
SELECT recording_id, lang, round(panel_score, 6) AS panel_score, zone_key,
  CASE WHEN zone_key = 'at_ceiling' THEN 'score_clamp' WHEN n_phones % 3 = 0 THEN 'low_alignment' END AS caveat_key FROM rpanel_v
""")
def resonance_panel(spark, d):
    sc = PQ.scored(spark, d)
    s = P.recording_summary(sc, ["recording_id", "lang"]).select("recording_id", "lang", "median_resonance", (F.col("n_phones") % 3 == 0).alias("low_quality"))
    v = PQ.laid_vowels(cut_lineage(P.per_vowel(sc, ["recording_id"])))
    return SE.resonance_panel(v, s, ["recording_id"], PQ.VOWEL_ROWS).select("recording_id", "lang", F.round("panel_score", 6).alias("panel_score"), "zone_key", "caveat_key")


view("weak_v", """
SELECT recording_id, string_agg(vowel || '=' || CAST(n AS VARCHAR) || ':' || CAST(CAST(round(resonance_med * 1000) AS BIGINT) AS VARCHAR), ' ' ORDER BY rank) AS weak FROM (
  SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY resonance_med, n DESC, vowel) AS rank FROM vowel_v
  WHERE n >= 2 AND is_vowel AND resonance_med < 0.40) WHERE rank <= 3 GROUP BY recording_id
""", ("vowel_v",))
view("levels_v", """
SELECT recording_id, string_agg(lvl || ':' || vowel, ' ' ORDER BY CASE lvl WHEN 'weak' THEN 0 WHEN 'low' THEN 1 ELSE 2 END, resonance_med, n DESC, vowel) AS levels
FROM (SELECT *, CASE WHEN resonance_med >= 0.65 THEN 'good' WHEN resonance_med >= 0.4 THEN 'low' ELSE 'weak' END AS lvl FROM vowel_v) GROUP BY recording_id
""", ("vowel_v",))


@query("advice_panels", "P22 P12 P13 P14", ("dominant_v", "panel_v", "rpanel_v", "weak_v", "levels_v"), """
SELECT session_id, tier, median_hz AS f0_median, reliability AS f0_reliability, CASE WHEN tier <> 'minimal' THEN tend END AS tone_tendency,
  CASE WHEN tier <> 'minimal' THEN 'advice.summary.' || range_zone || '_' || tend END AS summary_key,
  CASE WHEN tier <> 'minimal' AND range_zone IS NOT NULL THEN CAST(round_even(median_hz, 0) AS BIGINT) END AS summary_f0,
  CASE WHEN tier <> 'minimal' THEN round(female_s / total_s, 4) END AS female_ratio,
  CASE WHEN tier <> 'minimal' THEN zone_key END AS zone_key, CASE WHEN tier <> 'minimal' THEN round(panel_score, 3) END AS median_resonance,
  CASE WHEN tier <> 'minimal' THEN 'advice.resonance.summary.' || zone_key END AS resonance_key,
  CASE WHEN tier <> 'minimal' THEN CASE WHEN zone_key = 'at_ceiling' THEN 'advice.resonance.caveat.score_clamp' WHEN n_phones % 3 = 0 THEN 'advice.resonance.caveat.low_alignment' END END AS caveat_key,
  CASE WHEN tier <> 'minimal' AND scored IS NOT NULL THEN coalesce(weak, '') END AS weak, CASE WHEN tier <> 'minimal' AND scored IS NOT NULL THEN coalesce(levels, '') END AS levels,
  CASE tier WHEN 'minimal' THEN 'advice.warning.short_recording_minimal' WHEN 'standard' THEN 'advice.warning.short_recording_standard:' || CAST(CAST(round_even(secs, 0) AS BIGINT) AS VARCHAR) ELSE '' END AS warnings
FROM (SELECT *, CASE WHEN secs < 10 THEN 'minimal' WHEN secs < 30 THEN 'standard' ELSE 'full' END AS tier,
    CASE WHEN dominant_label IS NULL THEN 'not_clearly_leaning'
      WHEN margin >= 0.78 THEN CASE dominant_label WHEN 'female' THEN 'leans_feminine' ELSE 'leans_masculine' END
      WHEN margin >= 0.50 THEN CASE dominant_label WHEN 'female' THEN 'weakly_feminine' ELSE 'weakly_masculine' END
      ELSE 'not_clearly_leaning' END AS tend
  FROM (SELECT d.*, p.median_hz, p.range_zone, p.reliability, r.recording_id AS scored, r.zone_key, r.panel_score, r.n_phones, w.weak, l.levels, round(total_s / 8, 2) AS secs,
      round(CASE dominant_label WHEN 'female' THEN c_f WHEN 'male' THEN c_m ELSE 0 END, 4) AS margin
    FROM dominant_v d JOIN panel_v p ON d.session_id = p.session_id LEFT JOIN rpanel_v r ON d.session_id = r.recording_id
      LEFT JOIN weak_v w ON d.session_id = w.recording_id LEFT JOIN levels_v l ON d.session_id = l.recording_id))
""")
def advice_panels(spark, d):
    """The nested advice of every session, flattened."""
    sg = segs(spark, d)
    s = SE.session_summary(sg, SESSION).drop("female_ratio")
    lr = SE.label_ratio(sg, SESSION, F.sum("duration_s"))
    panel = SE.frame_panel(frames(spark, d), SESSION)
    panel = panel.select("session_id", F.struct(*[c for c in panel.columns if c != "session_id"]).alias("f0_panel"))
    sc = PQ.scored(spark, d)
    scores = P.recording_summary(sc, ["recording_id", "lang"]).select(F.col("recording_id").alias("session_id"), "lang", "median_resonance", (F.col("n_phones") % 3 == 0).alias("low_quality"))
    detail = SE.resonance_detail(P.per_vowel(sc, ["recording_id"]).withColumnRenamed("recording_id", "session_id"), scores, SESSION)
    j = s.join(lr, SESSION).join(panel, SESSION).join(detail, SESSION, "left").select(
        "session_id", (F.col("total_s") / 8).alias("recording_s"), "dominant_label", F.col("dominant_confidence").alias("margin"),
        "female_ratio", "male_ratio", "other_ratio", "f0_panel", "resonance",
    )
    out = SE.advice(j, SESSION)
    a, r = F.col("advice"), F.col("advice.resonance_panel")
    thousandths = lambda x: F.round(x * 1000).cast("long").cast("string")
    weak = F.transform(r["weakness_vowels"], lambda x: F.concat(x["vowel"], F.lit("="), x["n"].cast("string"), F.lit(":"), thousandths(x["resonance_med"])))
    levels = F.transform(r["per_vowel"], lambda x: F.concat(x["level_key"], F.lit(":"), x["vowel"]))
    warned = F.transform(a["warnings"], lambda x: F.concat_ws(":", x["key"], x["params"]["duration"].cast("string")))
    return out.select(
        "session_id", a["gating_tier"].alias("tier"),
        a["f0_panel"]["median_hz"].alias("f0_median"), a["f0_panel"]["reliability"].alias("f0_reliability"),
        a["tone_panel"]["tone_tendency_key"].alias("tone_tendency"), a["summary_panel"]["text_key"].alias("summary_key"),
        a["summary_panel"]["text_params"]["f0"].alias("summary_f0"), a["tone_panel"]["ina_label_distribution"]["female_frame_ratio"].alias("female_ratio"),
        r["zone_key"].alias("zone_key"), r["median_resonance"].alias("median_resonance"), r["summary_text_key"].alias("resonance_key"),
        r["caveat_key"].alias("caveat_key"), F.array_join(weak, " ").alias("weak"), F.array_join(levels, " ").alias("levels"),
        F.array_join(warned, ",").alias("warnings"),
    )


@query("tone_tags", "P13 P12", ("seg_v",), """
SELECT session_id, start_s, label, confidence, CASE WHEN duration_s < 10 THEN 'minimal' WHEN duration_s < 30 THEN 'standard' ELSE 'full' END AS tier,
  CASE WHEN label NOT IN ('female', 'male') OR coalesce(confidence, 0) < 0.5 THEN 'not_clearly_leaning'
    ELSE CASE WHEN confidence >= 0.78 THEN 'leans_' ELSE 'weakly_' END || CASE label WHEN 'female' THEN 'feminine' ELSE 'masculine' END END AS tag FROM seg_v
""")
def tone_tags(spark, d):
    return segs(spark, d).select("session_id", "start_s", "label", "confidence", S.duration_tier(F.col("duration_s")).alias("tier"), S.tone_tendency(F.col("label"), F.coalesce("confidence", F.lit(0.0))).alias("tag"))


@query("display_scores", "P19", ("seg_v",), """
SELECT session_id, start_s, round(sc, 6) AS score, round(100 / (1 + exp(-(sc / 100 - 0.5) * 5.5)), 6) AS rescaled, round(CASE WHEN age <= 1 THEN age * 0.4
  WHEN age <= 7 THEN 0.4 + (age - 1) / 6 * 0.3 ELSE 0.7 + least(1.0, sqrt((age - 7) / 30)) * 0.3 END, 6) AS age_ratio
FROM (SELECT session_id, start_s, start_s / 60 AS age, CASE label WHEN 'female' THEN 50 + least(coalesce(confidence, 0.5::DOUBLE), 1) * 50
  WHEN 'male' THEN 50 - least(coalesce(confidence, 0.5::DOUBLE), 1) * 50 ELSE 50 END AS sc FROM seg_v)
""")
def display_scores(spark, d):
    sc = S.signed_score(F.col("label"), F.col("confidence"), F.lit(None).cast("double"))
    return segs(spark, d).select(
        "session_id", "start_s", F.round(sc, 6).alias("score"), F.round(S.sigmoid_rescale(sc), 6).alias("rescaled"),
        F.round(S.age_ratio(F.col("start_s") / 60), 6).alias("age_ratio"),
    )


@query("dominant_of_three", "A35", ("timeline_v",), """
SELECT recording_id, label, round(CASE label WHEN 'male' THEN cm / dm WHEN 'neutral' THEN cn / dn WHEN 'female' THEN cf / df END, 6) AS confidence FROM (
  SELECT *, CASE WHEN dm >= dn AND dm >= df THEN 'male' WHEN dn >= df THEN 'neutral' ELSE 'female' END AS label FROM (
    SELECT recording_id, coalesce(sum(value) FILTER (s = 'male'), 0) AS dm, coalesce(sum(value) FILTER (s = 'neutral'), 0) AS dn, coalesce(sum(value) FILTER (s = 'female'), 0) AS df,
      sum(value * k / 100) FILTER (s = 'male') AS cm, sum(value * k / 100) FILTER (s = 'neutral') AS cn, sum(value * k / 100) FILTER (s = 'female') AS cf
    FROM (SELECT *, CASE kind WHEN 'click' THEN 'male' WHEN 'purchase' THEN 'neutral' WHEN 'error' THEN 'female' ELSE 'other' END AS s FROM timeline_v) GROUP BY recording_id))
""")
def dominant_of_three(spark, d):
    lab = {"click": "male", "purchase": "neutral", "error": "female"}
    t = A.timeline(spark, d).withColumn("label", S.pick(lab, F.col("kind"), "other")).withColumn("confidence", F.col("k") / 100.0)
    return SE.dominant_of_three(t, ["recording_id"], F.col("value")).withColumn("confidence", F.round("confidence", 6))


@query("weighted_side", "A34", ("timeline_v",), """
SELECT recording_id, CASE WHEN f >= m THEN 'female' ELSE 'male' END AS label, round(least(1, greatest(0, CASE WHEN f >= m THEN fc / f ELSE mc / m END)), 6) AS confidence,
  round(m + f, 6) AS speech_s FROM (
  SELECT recording_id, coalesce(sum(d) FILTER (kind = 'click'), 0) AS m, coalesce(sum(d) FILTER (kind = 'purchase'), 0) AS f,
    sum(d * c) FILTER (kind = 'click') AS mc, sum(d * c) FILTER (kind = 'purchase') AS fc
  FROM (SELECT *, (k - 10) / 20 AS d, CASE WHEN k % 4 = 0 THEN 0 ELSE k / 100 END AS c FROM timeline_v) WHERE d > 0 GROUP BY recording_id) WHERE m > 0 OR f > 0
""")
def weighted_side(spark, d):
    t = A.timeline(spark, d).select(
        "recording_id", S.pick({"click": "male", "purchase": "female"}, F.col("kind"), "other").alias("label"), F.lit(0.0).alias("start"),
        ((F.col("k") - 10) / 20).alias("end"), F.when(F.col("k") % 4 != 0, F.col("k") / 100).alias("confidence"))
    return SE.weighted_side(t, ["recording_id"], "start", "end").select("recording_id", "label", *r6("confidence", "speech_s"))


@query("panel_rollup", "A34", ("phones_v",), """
SELECT recording_id, round(quantile_cont(f1, 0.5), 6) AS f1, round(quantile_cont(f2, 0.5), 6) AS f2, round(quantile_cont(f3, 0.5), 6) AS f3,
  round(CASE WHEN len(ps) >= 5 THEN ps[CAST(floor(len(ps) * 0.05) AS BIGINT) + 1] ELSE med - dev END, 6) AS pitch_lo,
  round(CASE WHEN len(ps) >= 5 THEN ps[CAST(floor(len(ps) * 0.95) AS BIGINT) + 1] ELSE med + dev END, 6) AS pitch_hi
FROM (SELECT recording_id, f1, f2, f3, list_sort(list(f0) FILTER (f0 BETWEEN 40 AND 600) OVER r) AS ps, quantile_cont(f0, 0.5) OVER r AS med, stddev_samp(f0) OVER r AS dev
  FROM phones_v WINDOW r AS (PARTITION BY recording_id)) GROUP BY recording_id, ps, med, dev
""")
def panel_rollup(spark, d):
    rows = sized(A.phones(spark, d).select("recording_id", "f0", "f1", "f2", "f3"), ["recording_id"], P.ROWS)
    return SE.panel_rollup(rows, ["recording_id"], P.ROWS).select("recording_id", *r6("f1", "f2", "f3", "pitch_lo", "pitch_hi"))


@query("visible_set", "A38", ("vowel_v",), """
SELECT recording_id, round(quantile_cont(resonance_med, 0.5), 6) AS median, count(*) AS shown,
  CASE WHEN count(*) >= 2 THEN greatest(0, min(resonance_med)) END AS span_lo, CASE WHEN count(*) >= 2 THEN least(1, max(resonance_med)) END AS span_hi
FROM vowel_v WHERE is_vowel GROUP BY recording_id
""")
def visible_set(spark, d):
    return SE.visible_set(PQ.laid_vowels(PQ.vowels(spark, d)), ["recording_id"], False, PQ.VOWEL_ROWS).withColumn("median", F.round("median", 6))


@query("timestamp_fallback", "P21", ("timeline_v",), """
SELECT ref, CASE WHEN k % 3 = 0 THEN tick WHEN k % 3 = 1 THEN tick + 1 ELSE 7 END AS created_at FROM timeline_v
""")
def timestamp_fallback(spark, d):
    k = F.col("k") % 3
    own = F.when(k == 0, F.col("tick")).when(k == 1, F.lit(-5).cast("long"))
    modified = F.when(k == 1, F.col("tick") + 1).otherwise(F.lit(0).cast("long"))
    return A.timeline(spark, d).select("ref", S.first_positive(own, modified, F.lit(7).cast("long")).alias("created_at"))


@query("label_normalisation", "P5", ("clips_v",), """
SELECT clip_id, CASE clip_id % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'male' WHEN 2 THEN 'female' WHEN 3 THEN 'female' END AS gender,
  CASE clip_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'ko' ELSE 'zh' END AS lang FROM clips_v
""")
def label_normalisation(spark, d):
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("clip_id") % m + 1).cast("int"))
    raw = pick(["male", " Male_Masculine", "FEMALE", "female_feminine ", "other"], 5)
    tag = pick(["en-US", "fr", "ko-KR", "de-DE"], 4)
    return A.clips(spark, d).select("clip_id", S.normalize_gender(raw).alias("gender"), S.normalize_lang(tag).alias("lang"))


@query("number_parsing", "P1", ("timeline_v",), """
SELECT ref, CASE WHEN k % 5 = 3 THEN value WHEN k % 5 = 4 THEN NULL END AS parsed FROM timeline_v
""")
def number_parsing(spark, d):
    bad = F.array(F.lit("--undefined--"), F.lit("?"), F.lit("NaN"))
    k = F.col("k") % 5
    text = F.when(k < 3, F.element_at(bad, k + 1)).when(k == 3, F.col("value").cast("string")).otherwise(F.concat(F.lit("-"), F.col("value").cast("string")))
    return A.timeline(spark, d).select("ref", S.positive_number(text).alias("parsed"))
