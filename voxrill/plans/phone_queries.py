"""Queries over phone observations, reference statistics and formant ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators import phones as P
from voxrill.operators import stats as ST
from voxrill.operators.quantiles import quantiles, sized
from voxrill.plans import adapters as A
from voxrill.plans.registry import query, view
from voxrill.session import cut_lineage

# Fewest observations for a label to be scored in the demonstration data.
SCORE_MIN_OBS = 30


def r6(*cols: str):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def r3(*cols: str):
    """Means of short decimals: few enough digits that a mean rarely falls on a rounding boundary."""
    return [F.round(F.col(c), 3).alias(c) for c in cols]


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Phones with the label replaced by its statistics key."""
    p = A.phones(spark, d)
    return p.withColumn("phoneme", S.phone_key(F.col("lang"), F.col("phoneme")))


def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return ST.moments(keyed(spark, d), ["lang", "phoneme"], SCORE_MIN_OBS)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return P.score_phones(A.phones(spark, d), score_stats(spark, d))


def scorable(spark: SparkSession, d: str) -> DataFrame:
    """Scored phones for roll-ups by recording; phones without F1 or F2 have no score in any language and stay behind."""
    return P.score_phones(A.phones(spark, d), score_stats(spark, d), together=True).where("f1 IS NOT NULL AND f2 IS NOT NULL")


RECORDING = ["recording_id", "speaker_id", "sex", "language", "lang"]

view("key_v", """
SELECT *, CASE WHEN lang = 'zh' THEN regexp_replace(phoneme, '[˥˦˧˨˩]+', '', 'g') ELSE phoneme END AS pkey,
  CASE WHEN lang = 'zh' THEN regexp_replace(expected, '[˥˦˧˨˩]+', '', 'g') ELSE expected END AS ekey
FROM phones_v
""", ("phones_v",))
view("cells_v", """
SELECT lang, pkey AS phoneme, batch, unnest([0, 1, 2, 3]) AS formant, unnest([f0, f1, f2, f3]) AS value FROM key_v
""", ("key_v",))


def _stats_view(name: str, min_obs: int) -> None:
    view(name, f"""
    SELECT s.lang, s.phoneme, s.formant, coalesce(c.n, 0) AS n, coalesce(c.mean, 0.0) AS mean, coalesce(c.stdev, 1.0) AS stdev,
      coalesce(c.median, 0.0) AS median, coalesce(c.max, 0.0) AS max, coalesce(c.min, 0.0) AS min
    FROM (SELECT lang, phoneme, unnest([0, 1, 2, 3]) AS formant FROM {name}_c GROUP BY lang, phoneme
          HAVING count(*) FILTER (WHERE formant IN (1, 2)) = 2) s
    LEFT JOIN {name}_c c ON s.lang = c.lang AND s.phoneme = c.phoneme AND s.formant = c.formant
    """, (f"{name}_c",))


for _name, _n in (("train_v", 200), ("stats_v", SCORE_MIN_OBS)):
    view(f"{_name}_c", f"""
    SELECT lang, phoneme, formant, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS stdev,
      quantile_cont(value, 0.5) AS median, max(value) AS max, min(value) AS min
    FROM cells_v WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= {_n}
    """, ("cells_v",))
    _stats_view(_name, _n)

view("outlier_v", """
SELECT * EXCLUDE (f0, f1, f2, f3, o0, o1, o2, o3), coalesce(o0, false) OR coalesce(o1, false) OR coalesce(o2, false) OR coalesce(o3, false) AS outlier,
  CASE WHEN NOT coalesce(o0, false) THEN f0 END AS f0, CASE WHEN NOT coalesce(o1, false) THEN f1 END AS f1,
  CASE WHEN NOT coalesce(o2, false) THEN f2 END AS f2, CASE WHEN NOT coalesce(o3, false) THEN f3 END AS f3
FROM (SELECT *,
  abs(f0 - avg(f0) OVER r) / nullif(stddev_samp(f0) OVER r, 0) > 2 AS o0,
  abs(f1 - avg(f1) OVER r) / nullif(stddev_samp(f1) OVER r, 0) > 2 AS o1,
  abs(f2 - avg(f2) OVER r) / nullif(stddev_samp(f2) OVER r, 0) > 2 AS o2,
  abs(f3 - avg(f3) OVER r) / nullif(stddev_samp(f3) OVER r, 0) > 2 AS o3
  FROM key_v WINDOW r AS (PARTITION BY recording_id))
""", ("key_v",))
view("ref_v", """
SELECT lang, phoneme, max(mean) FILTER (formant = 0) AS m0, max(stdev) FILTER (formant = 0) AS s0,
  max(mean) FILTER (formant = 1) AS m1, max(stdev) FILTER (formant = 1) AS s1,
  max(mean) FILTER (formant = 2) AS m2, max(stdev) FILTER (formant = 2) AS s2,
  max(mean) FILTER (formant = 3) AS m3, max(stdev) FILTER (formant = 3) AS s3
FROM stats_v GROUP BY lang, phoneme
""", ("stats_v",))
view("z_v", """
SELECT o.*, CASE WHEN a.phoneme IS NOT NULL THEN (f0 - b.m0) / nullif(b.s0, 0) END AS z_f0,
  CASE WHEN a.phoneme IS NOT NULL THEN (f1 - b.m1) / nullif(b.s1, 0) END AS z_f1,
  CASE WHEN a.phoneme IS NOT NULL THEN (f2 - b.m2) / nullif(b.s2, 0) END AS z_f2,
  CASE WHEN a.phoneme IS NOT NULL THEN (f3 - b.m3) / nullif(b.s3, 0) END AS z_f3
FROM outlier_v o LEFT JOIN ref_v a ON o.lang = a.lang AND o.pkey = a.phoneme
  LEFT JOIN ref_v b ON o.lang = b.lang AND o.ekey = b.phoneme
""", ("outlier_v", "ref_v"))
view("scored_v", """
SELECT *, CASE
  WHEN lang = 'en' THEN CASE WHEN z_f1 IS NOT NULL AND z_f2 IS NOT NULL
    THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7321428571428571::DOUBLE * z_f1 + 0.26785714285714285::DOUBLE * z_f2 + 0.5)) END
  ELSE CASE WHEN z_f1 IS NOT NULL AND z_f2 IS NOT NULL AND z_f3 IS NOT NULL
    THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.762::DOUBLE * z_f1 + 0.236::DOUBLE * z_f2 + 0.002::DOUBLE * z_f3 + 0.5)) END
  END AS resonance,
  CASE WHEN lang = 'zh' THEN pkey WHEN lang = 'en' THEN regexp_replace(phoneme, '[012]$', '') ELSE phoneme END AS vowel
FROM z_v
""", ("z_v",))


def _set(labels) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


_IS_VOWEL = "CASE lang " + " ".join(f"WHEN '{k}' THEN vowel IN {_set(v)}" for k, v in D.VOWELS.items()) + " END"
_BY_LETTER = (
    "CASE lang " + " ".join(f"WHEN '{k}' THEN pkey IN {_set(D.VOWELS[k])}" for k in ("zh", "fr", "ko"))
    + " ELSE regexp_matches(phoneme, '[AEIOUY]') END"
)


def zone_sql(v: str, lang: str) -> str:
    def one(code):
        return "CASE " + " ".join(f"WHEN {v} < {u} THEN '{n}'" for n, u in D.SCORE_ZONES[code]) + " ELSE 'at_ceiling' END"

    return (
        f"CASE WHEN {v} IS NULL OR isnan({v}) THEN NULL WHEN {lang} = 'fr' THEN {one('fr')} "
        f"WHEN {lang} = 'en' THEN {one('en')} WHEN {lang} = 'ko' THEN {one('ko')} ELSE {one('zh')} END"
    )


PITCH_ZONE_SQL = "CASE WHEN {v} IS NULL THEN NULL " + " ".join(f"WHEN {{v}} < {u} THEN '{n}'" for n, u in D.PITCH_ZONES) + " ELSE 'high' END"


@query("train_stats", "A1", ("train_v",), """
SELECT lang, phoneme, formant, CAST(n AS BIGINT) AS n, round(mean, 3) AS mean, round(stdev, 3) AS stdev,
  round(median, 6) AS median, round(max, 6) AS max, round(min, 6) AS min FROM train_v
""")
def train_stats(spark, d):
    s = ST.train(keyed(spark, d), ["lang", "phoneme"])
    return s.select("lang", "phoneme", "formant", "n", *r3("mean", "stdev"), *r6("median", "max", "min"))


@query("complete_case_stats", "A2 P6", ("key_v",), """
SELECT lang, phoneme, formant, count(*) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS stdev,
  round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max, round(min(v), 6) AS min
FROM (SELECT lang, pkey AS phoneme, unnest([0, 1, 2, 3]) AS formant, unnest([f0, f1, f2, f3]) AS v FROM key_v
      WHERE f0 <> 0 AND f1 <> 0 AND f2 <> 0 AND f3 <> 0) GROUP BY ALL HAVING count(*) >= 2
""")
def complete_case_stats(spark, d):
    s = ST.train_complete(keyed(spark, d), ["lang", "phoneme"])
    return s.select("lang", "phoneme", "formant", "n", *r3("mean", "stdev"), *r6("median", "max", "min"))


@query("outlier_flags", "A3", ("outlier_v",), """
SELECT recording_id, phoneme, expected, outlier, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3 FROM outlier_v
""")
def outlier_flags(spark, d):
    return P.flag_outliers(A.phones(spark, d)).select("recording_id", "phoneme", "expected", "outlier", *r6(*P.FORMANTS))


@query("zscore_scores", "P7 P8 J5", ("scored_v",), """
SELECT recording_id, phoneme, expected, round(f1, 6) AS f1, round(z_f0, 6) AS z_f0, round(z_f1, 6) AS z_f1, round(z_f2, 6) AS z_f2,
  round(z_f3, 6) AS z_f3, round(resonance, 6) AS resonance FROM scored_v
""")
def zscore_scores(spark, d):
    return scored(spark, d).select("recording_id", "phoneme", "expected", *r6("f1", "z_f0", "z_f1", "z_f2", "z_f3", "resonance"))


def summaries(spark, d):
    """One row per recording, written once: small next to the phones and read several times."""
    return cut_lineage(P.recording_summary(scored(spark, d), RECORDING))


view("summary_v", """
SELECT recording_id, speaker_id, sex, language, lang, count(*) AS n_phones, count(p) AS n_pitch, count(r) AS n_score, avg(p) AS mean_pitch,
  stddev_samp(p) AS stdev_pitch, quantile_cont(p, 0.5) AS median_pitch, avg(r) AS mean_resonance,
  stddev_samp(r) AS stdev_resonance, quantile_cont(r, 0.5) AS median_resonance
FROM (SELECT *, CASE WHEN NOT outlier AND f0 <> 0 THEN f0 END AS p, CASE WHEN NOT outlier AND resonance <> 0 THEN resonance END AS r
      FROM scored_v) GROUP BY ALL
""", ("scored_v",))


@query("recording_summary", "A4", ("summary_v",), """
SELECT recording_id, n_phones, n_pitch, n_score, round(mean_pitch, 6) AS mean_pitch, round(stdev_pitch, 6) AS stdev_pitch,
  round(median_pitch, 6) AS median_pitch, round(mean_resonance, 6) AS mean_resonance, round(stdev_resonance, 6) AS stdev_resonance,
  round(median_resonance, 6) AS median_resonance,
  CASE WHEN n_pitch < 2 THEN 'too few pitched phones' WHEN n_score < 2 THEN 'too few scored phones' END AS reason
FROM summary_v
""")
def recording_summary(spark, d):
    s = P.recording_summary(scored(spark, d), RECORDING)
    return s.select(
        "recording_id", "n_phones", "n_pitch", "n_score",
        *r6("mean_pitch", "stdev_pitch", "median_pitch", "mean_resonance", "stdev_resonance", "median_resonance"), "reason",
    )


view("vowel_v", f"""
SELECT recording_id, speaker_id, sex, language, lang, vowel, coalesce({_IS_VOWEL}, false) AS is_vowel, count(*) AS n,
  round(quantile_cont(resonance, 0.5), 3) AS resonance_med, round(quantile_cont(z_f1, 0.5), 3) AS z_f1_med,
  round(quantile_cont(z_f2, 0.5), 3) AS z_f2_med, round(quantile_cont(z_f3, 0.5), 3) AS z_f3_med,
  round(quantile_cont(f1, 0.5), 0) AS f1_med_hz, round(quantile_cont(f2, 0.5), 0) AS f2_med_hz, round(quantile_cont(f3, 0.5), 0) AS f3_med_hz
FROM scored_v WHERE resonance IS NOT NULL GROUP BY ALL HAVING count(*) >= 2
""", ("scored_v",))


def vowels(spark, d):
    """Per-vowel rows of every recording, written once: they are few and read several times."""
    return cut_lineage(P.per_vowel(scorable(spark, d), RECORDING))


#: A bound on the per-vowel rows of a recording, as ``laid_vowels`` gives it.
VOWEL_ROWS = "vowel_rows"


def laid_vowels(vowels: DataFrame) -> DataFrame:
    """Written per-vowel rows laid out by recording: medians over the vowels of a recording are read off one list."""
    return sized(vowels, ["recording_id"], VOWEL_ROWS)


@query("per_vowel", "A7 T8", ("vowel_v",), """
SELECT recording_id, vowel, is_vowel, n, resonance_med, z_f1_med, z_f2_med, z_f3_med, f1_med_hz, f2_med_hz, f3_med_hz FROM vowel_v
""")
def per_vowel(spark, d):
    return P.per_vowel(scorable(spark, d), ["recording_id"]).orderBy("recording_id", F.desc("n"), "vowel")


@query("median_of_medians", "A8", ("vowel_v", "summary_v"), f"""
SELECT s.recording_id, count(CASE WHEN n >= 5 THEN 1 END) AS n_vowels,
  round(coalesce(quantile_cont(CASE WHEN n >= 5 THEN resonance_med END, 0.5), any_value(median_resonance)), 6) AS zone_median,
  round(quantile_cont(CASE WHEN n >= 2 THEN resonance_med END, 0.5), 6) AS panel_median
FROM summary_v s LEFT JOIN vowel_v v ON s.recording_id = v.recording_id GROUP BY s.recording_id
""")
def median_of_medians(spark, d):
    sc = scored(spark, d)
    v = laid_vowels(cut_lineage(P.per_vowel(sc, RECORDING)))
    flat = P.recording_summary(sc, ["recording_id"]).select("recording_id", "median_resonance")
    zone = quantiles(
        v, ["recording_id"],
        {"zone": F.when(F.col("n") >= D.ZONE_MIN_TOKENS, F.col("resonance_med")), "panel": F.when(F.col("n") >= D.PANEL_MIN_TOKENS, F.col("resonance_med"))},
        {"": 0.5}, counts=True, size=VOWEL_ROWS,
    )
    return flat.join(zone, "recording_id", "left").select(
        "recording_id", F.coalesce("zone_n", F.lit(0)).cast("long").alias("n_vowels"),
        F.round(F.coalesce("zone", "median_resonance"), 6).alias("zone_median"),
        F.round("panel", 6).alias("panel_median"),
    )


@query("zone_bands", "P9 P10 P11 P5", ("scored_v",), f"""
SELECT recording_id, phoneme, lang, round(resonance, 6) AS resonance, {zone_sql('resonance', 'lang')} AS zone, {PITCH_ZONE_SQL.format(v='f0')} AS pitch_zone,
  CASE WHEN f0 IS NULL OR f0 <= 0 THEN NULL WHEN f0 < 145 THEN 'male' WHEN f0 > 185 THEN 'female' ELSE 'neutral' END AS pitch_side,
  round(CASE WHEN f0 IS NULL OR f0 <= 0 THEN 0.0 WHEN f0 < 145 THEN least(1.0, greatest(0.0, (145 - f0) / 65))
    WHEN f0 > 185 THEN least(1.0, greatest(0.0, (f0 - 185) / 65)) ELSE greatest(0.0, 1 - abs(f0 - 165) / 20) END, 6) AS pitch_confidence,
  CASE WHEN resonance IS NULL THEN NULL WHEN resonance < lo THEN 'male' WHEN resonance > hi THEN 'female' ELSE 'neutral' END AS score_side,
  round(CASE WHEN resonance IS NULL THEN 0.0 WHEN resonance < lo THEN least(1.0, greatest(0.0, (lo - resonance) / lo))
    WHEN resonance > hi THEN least(1.0, greatest(0.0, (resonance - hi) / (1 - hi)))
    ELSE greatest(0.0, 1 - abs(resonance - (lo + hi) / 2) / ((hi - lo) / 2)) END, 6) AS score_confidence
FROM (SELECT *, (CASE lang WHEN 'zh' THEN 0.612 WHEN 'en' THEN 0.458 ELSE 0.547 END)::DOUBLE AS lo,
  (CASE lang WHEN 'zh' THEN 0.842 WHEN 'en' THEN 0.682 ELSE 0.752 END)::DOUBLE AS hi FROM scored_v)
""")
def zone_bands(spark, d):
    f0, r, lang = F.col("f0"), F.col("resonance"), F.col("lang")
    return scored(spark, d).select(
        "recording_id", "phoneme", "lang", F.round("resonance", 6).alias("resonance"), S.score_zone(r, lang).alias("zone"),
        S.pitch_zone(f0).alias("pitch_zone"), S.pitch_side(f0).alias("pitch_side"),
        F.round(S.pitch_side_confidence(f0), 6).alias("pitch_confidence"),
        S.score_side(r, lang).alias("score_side"), F.round(S.score_side_confidence(r, lang), 6).alias("score_confidence"),
    )


@query("vowel_predicates", "P2 P3", ("scored_v",), f"""
SELECT lang, language, phoneme, pkey AS stats_key, vowel AS vowel_label, coalesce({_IS_VOWEL}, false) AS by_set, coalesce({_BY_LETTER}, false) AS by_letter, count(*) AS n
FROM scored_v GROUP BY ALL
""")
def vowel_predicates(spark, d):
    lang, ph = F.col("lang"), F.col("phoneme")
    return A.phones(spark, d).groupBy("lang", "language", "phoneme").agg(F.count(F.lit(1)).alias("n")).select(
        "lang", "language", "phoneme", S.phone_key(lang, ph).alias("stats_key"), S.vowel_label(lang, ph).alias("vowel_label"),
        S.is_vowel_by_set(lang, ph).alias("by_set"), S.is_vowel_by_letter(lang, ph).alias("by_letter"), "n",
    )


# --- ceilings ---------------------------------------------------------------------


def multi_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Phones seen at five ceilings: formants are stretched by a factor per (ceiling, label length).

    Phones are laid out by recording before they become five rows, and carry a bound on those at a ceiling.
    """
    p = A.phones(spark, d).select("recording_id", "speaker_id", "lang", F.col("phoneme").alias("phone"), "f1", "f2", "f3")
    p = sized(p, ["recording_id"], P.ROWS)
    grid = F.explode(F.array(*[F.lit(c) for c in D.CEILINGS])).alias("ceiling_hz")
    long = p.select("recording_id", "speaker_id", "lang", "phone", "f1", "f2", "f3", P.ROWS, grid)
    bend = 1 + (F.col("ceiling_hz") - 5000) / 10000.0 * (F.col("f1") % 7) / 7
    return long.select(
        "recording_id", "speaker_id", "lang", "phone", "ceiling_hz", P.ROWS,
        *[(F.col(f) * bend).alias(f) for f in ("f1", "f2", "f3")],
    )


view("multi_v", """
SELECT recording_id, speaker_id, lang, phone, pkey, phoneme, ceiling_hz, f1 * bend AS f1, f2 * bend AS f2, f3 * bend AS f3
FROM (SELECT *, phoneme AS phone, 1 + (ceiling_hz - 5000) / 10000.0::DOUBLE * fmod(f1, 7) / 7 AS bend
      FROM (SELECT *, unnest([4500, 5000, 5500, 6000, 6500]) AS ceiling_hz FROM key_v))
""", ("key_v",))
view("ceiling_v", f"""
SELECT recording_id, lang, ceiling_hz, count(*) AS classes, CASE WHEN count(*) >= 3 THEN avg(cv) END AS score
FROM (SELECT recording_id, lang, phone, ceiling_hz,
        coalesce(stddev_samp(f1) / quantile_cont(f1, 0.5), 0) + 1.5 * coalesce(stddev_samp(f2) / quantile_cont(f2, 0.5), 0)
        + 0.5 * coalesce(stddev_samp(f3) / quantile_cont(f3, 0.5), 0) AS cv
      FROM multi_v WHERE {_BY_LETTER} GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL
""", ("multi_v",))
view("pick_v", """
SELECT r.recording_id, r.speaker_id, r.lang, coalesce(b.ceiling_hz, CASE WHEN r.lang IN ('fr', 'zh', 'en') THEN 5500 ELSE 5000 END) AS ceiling_hz, b.best AS best_score
FROM (SELECT DISTINCT recording_id, speaker_id, lang FROM key_v) r LEFT JOIN (
  SELECT recording_id, ceiling_hz, best FROM (
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY abs(ceiling_hz - 5500), ceiling_hz) AS rn
    FROM (SELECT *, min(score) OVER (PARTITION BY recording_id) AS best FROM ceiling_v WHERE score IS NOT NULL AND lang IN ('fr', 'zh', 'en'))
    WHERE score <= best * 1.05) WHERE rn = 1) b ON r.recording_id = b.recording_id
""", ("ceiling_v", "key_v"))


@query("ceiling_scores", "A5", ("ceiling_v",), """
SELECT recording_id, lang, ceiling_hz, classes, round(score, 6) AS score FROM ceiling_v
""")
def ceiling_scores(spark, d):
    return P.ceiling_scores(multi_ceiling(spark, d), ["recording_id"], P.ROWS).withColumn("score", F.round("score", 6))


def chosen_ceiling(spark, d):
    m = multi_ceiling(spark, d)
    recs = A.phones(spark, d).select("recording_id", "speaker_id", "lang").distinct()
    return P.pick_ceiling(P.ceiling_scores(m, ["recording_id"], P.ROWS), recs, ["recording_id"])


@query("ceiling_pick", "T1", ("pick_v",), "SELECT recording_id, lang, ceiling_hz, round(best_score, 6) AS best_score FROM pick_v")
def ceiling_pick(spark, d):
    return chosen_ceiling(spark, d).select("recording_id", "lang", "ceiling_hz", F.round("best_score", 6).alias("best_score"))


@query("ceiling_hist", "A6", ("pick_v",), """
SELECT ceiling_hz, votes, count(*) AS speakers FROM (
  SELECT speaker_id, ceiling_hz, votes, row_number() OVER (PARTITION BY speaker_id ORDER BY votes DESC, f) AS rn
  FROM (SELECT speaker_id, ceiling_hz, count(*) AS votes, min(recording_id) AS f FROM pick_v GROUP BY ALL)) WHERE rn = 1 GROUP BY ALL
""")
def ceiling_hist(spark, d):
    modal = P.modal_value(chosen_ceiling(spark, d), ["speaker_id"], "ceiling_hz", "recording_id")
    return modal.groupBy("ceiling_hz", "votes").agg(F.count(F.lit(1)).alias("speakers"))


@query("formant_substitution", "J6", ("timeline_v",), """
SELECT recording_id, start, phone, seq, round(coalesce2.f1, 6) AS f1, round(coalesce2.f2, 6) AS f2 FROM (
  SELECT t.recording_id, t.start, t.phone, t.seq,
    CASE WHEN n.phone IS NOT NULL THEN n.f1 ELSE t.f1 END AS f1, CASE WHEN n.phone IS NOT NULL THEN n.f2 ELSE t.f2 END AS f2
  FROM (SELECT recording_id, floor(t) AS start, phone, ref AS seq, value + 100 AS f1, value AS f2 FROM timeline_v) t
  LEFT JOIN (SELECT recording_id, start, phone, arg_max(f1, seq) AS f1, arg_max(struct_pack(v := f2), seq).v AS f2 FROM (
      SELECT recording_id, floor(t) AS start, phone, ref AS seq, value * 2 AS f1, CASE WHEN k % 5 = 0 THEN NULL ELSE value * 3 END AS f2
      FROM timeline_v WHERE kind <> 'view') GROUP BY ALL) n
  ON t.recording_id = n.recording_id AND t.start = n.start AND t.phone = n.phone) AS coalesce2
""")
def formant_substitution(spark, d):
    t = A.timeline(spark, d).withColumn("start", F.floor("t").cast("double")).withColumn("seq", F.col("ref"))
    base = t.select("recording_id", "start", "phone", "seq", (F.col("value") + 100).alias("f1"), F.col("value").alias("f2"), F.lit(0.0).alias("f3"))
    new = t.where("kind <> 'view'").select(
        "recording_id", "phone", "start", "seq", (F.col("value") * 2).alias("f1"),
        F.when(F.col("k") % 5 != 0, F.col("value") * 3).alias("f2"), F.lit(1.0).alias("f3"),
    )
    new = new.select("*")
    out = P.substitute_formants(base, new, ["recording_id"])
    return out.select("recording_id", "start", "phone", "seq", *r6("f1", "f2"))


# --- comparing two statistics versions -------------------------------------------------


def _versions(spark, d):
    k = keyed(spark, d)
    return tuple(ST.moments(k.where(F.col("batch") == b), ["phoneme"], 2) for b in ("F", "O"))


for _b, _v in (("F", "old_v"), ("O", "new_v")):
    view(f"{_v}_c", f"""
    SELECT phoneme, formant, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS stdev FROM cells_v
    WHERE batch = '{_b}' AND value IS NOT NULL GROUP BY ALL HAVING count(value) >= 2
    """, ("cells_v",))
    view(_v, f"""
    SELECT s.phoneme, s.formant, coalesce(mean, 0.0) AS mean, coalesce(stdev, 1.0) AS stdev
    FROM (SELECT phoneme, unnest([0, 1, 2, 3]) AS formant FROM {_v}_c GROUP BY phoneme HAVING count(*) FILTER (WHERE formant IN (1, 2)) = 2) s
    LEFT JOIN {_v}_c c ON s.phoneme = c.phoneme AND s.formant = c.formant
    """, (f"{_v}_c",))
# The newer version misses one label and renames another, so coverage differs.
view("aligned_v", """
SELECT coalesce(o.phoneme, n.phoneme) AS phoneme, coalesce(o.formant, n.formant) AS formant, o.mean AS mean_old, o.stdev AS stdev_old,
  n.mean AS mean_new, n.stdev AS stdev_new,
  CASE WHEN o.phoneme IS NULL THEN 'added' WHEN n.phoneme IS NULL THEN 'dropped' ELSE 'common' END AS presence
FROM old_v o FULL OUTER JOIN (SELECT CASE WHEN phoneme = 's' THEN 'z' ELSE phoneme END AS phoneme, formant, mean, stdev FROM new_v) n
  ON o.phoneme = n.phoneme AND o.formant = n.formant
""", ("old_v", "new_v"))


def aligned(spark, d):
    old, new = _versions(spark, d)
    return ST.align_versions(old, new.withColumn("phoneme", F.when(F.col("phoneme") == "s", "z").otherwise(F.col("phoneme"))))


@query("stats_alignment", "J9 U2", ("aligned_v",), """
SELECT phoneme, formant, presence, round(mean_old, 3) AS mean_old, round(mean_new, 3) AS mean_new FROM aligned_v
""")
def stats_alignment(spark, d):
    return aligned(spark, d).select("phoneme", "formant", "presence", *r3("mean_old", "mean_new"))


@query("stats_drift", "A32", ("aligned_v",), """
SELECT phoneme, formant, round(mean_new - mean_old, 3) AS delta, round(abs(mean_new - mean_old) / (CASE WHEN stdev_old = 0 THEN 1 ELSE stdev_old END), 6) AS shift,
  round(CASE WHEN stdev_old > 0 THEN stdev_new / stdev_old END, 6) AS growth, coalesce(stdev_old > 0 AND stdev_new / stdev_old > 1.5, false) AS blow_up
FROM aligned_v WHERE presence = 'common'
""")
def stats_drift(spark, d):
    return ST.drift(aligned(spark, d)).select(
        "phoneme", "formant", *r3("delta"), *r6("shift", "growth"), F.coalesce(F.col("growth") > ST.BLOW_UP, F.lit(False)).alias("blow_up")
    )


@query("drift_summary", "A32 U2", ("aligned_v",), """
SELECT count(*) AS cells, round(avg(abs(mean_new - mean_old) / (CASE WHEN stdev_old = 0 THEN 1 ELSE stdev_old END)), 6) AS mean_shift,
  count(*) FILTER (WHERE stdev_new / stdev_old > 1.5) AS blow_ups,
  (SELECT count(DISTINCT phoneme) FROM aligned_v WHERE presence = 'added') AS added,
  (SELECT count(DISTINCT phoneme) FROM aligned_v WHERE presence = 'dropped') AS dropped
FROM aligned_v WHERE presence = 'common'
""")
def drift_summary(spark, d):
    a = aligned(spark, d)
    unit = F.when(F.col("stdev_old") == 0, F.lit(1.0)).otherwise(F.col("stdev_old"))
    common = F.col("presence") == "common"
    return a.agg(
        F.count_if(common).alias("cells"),
        F.round(F.avg(F.when(common, F.abs(F.col("mean_new") - F.col("mean_old")) / unit)), 6).alias("mean_shift"),
        F.count_if(common & (F.col("stdev_new") / F.col("stdev_old") > ST.BLOW_UP)).alias("blow_ups"),
        F.count_distinct(F.when(F.col("presence") == "added", F.col("phoneme"))).alias("added"),
        F.count_distinct(F.when(F.col("presence") == "dropped", F.col("phoneme"))).alias("dropped"),
    )


@query("top_drift", "T4", ("aligned_v",), """
SELECT phoneme, formant, round(abs(mean_new - mean_old) / stdev_old, 6) AS shift FROM aligned_v WHERE presence = 'common'
ORDER BY abs(mean_new - mean_old) / stdev_old DESC, phoneme, formant LIMIT 15
""")
def top_drift(spark, d):
    dr = ST.drift(aligned(spark, d))
    return dr.orderBy(F.desc("shift"), "phoneme", "formant").limit(15).select("phoneme", "formant", *r6("shift"))


@query("top_drift_f2", "T4", ("aligned_v",), """
SELECT phoneme, """ + ", ".join(f"round(max(mean_{s}) FILTER (formant = {i}), 3) AS f{i}_{s}" for i in (1, 2, 3) for s in ("old", "new")) + """
FROM aligned_v WHERE presence = 'common' GROUP BY phoneme HAVING count(*) FILTER (formant = 2) > 0
ORDER BY abs(max(mean_new) FILTER (formant = 2) - max(mean_old) FILTER (formant = 2)) DESC, phoneme LIMIT 15
""")
def top_drift_f2(spark, d):
    return ST.top_shift(aligned(spark, d), 2, 15).select("phoneme", *r3(*[f"f{i}_{s}" for i in (1, 2, 3) for s in ("old", "new")]))


@query("canary_check", "J19", ("aligned_v",), """
SELECT phoneme, round(mean_old, 3) AS mean_old, round(mean_new, 3) AS mean_new, round(mean_new - mean_old, 3) AS delta
FROM aligned_v WHERE presence = 'common' AND formant = 2 AND phoneme IN ('i', 'y', 'e')
""")
def canary_check(spark, d):
    a = aligned(spark, d).where("presence = 'common' AND formant = 2")
    canary = spark.createDataFrame([(v,) for v in D.CANARY_VOWELS], "phoneme string")
    return a.join(canary, "phoneme", "left_semi").select(
        "phoneme", *r3("mean_old", "mean_new"), F.round(F.col("mean_new") - F.col("mean_old"), 3).alias("delta")
    )


@query("stats_json", "K1 S4", ("train_v",), """
SELECT lang, phoneme, formant, round(mean, 3) AS mean, round(stdev, 3) AS stdev FROM train_v
""")
def stats_json(spark, d):
    """Write form (one JSON object per language) read back into the long form."""
    from voxrill.sources.readers import explode_stats

    s = ST.train(keyed(spark, d), ["lang", "phoneme"])
    return explode_stats(ST.nested_json(s, ["lang"]), "json", ["lang"]).select("lang", "phoneme", "formant", *r3("mean", "stdev"))
