"""Queries for weight search, validation, calibration and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators import audit as AU
from voxrill.operators import fit as FT
from voxrill.operators import phones as P
from voxrill.operators import search as SE
from voxrill.operators.quantiles import quantiles
from voxrill.plans import adapters as A
from voxrill.plans import phone_queries as PQ
from voxrill.plans.phone_queries import r3, r6
from voxrill.plans.registry import query, view
from voxrill.session import cut_lineage, shared_folder

G, K, SEED = 10, 5, "cv"

view("grid_v", f"""
SELECT i * {G + 1} + j AS cand, i / {G}::DOUBLE AS w1, j / {G}::DOUBLE AS w2, ({G} - i - j) / {G}::DOUBLE AS w3
FROM (SELECT unnest(range(0, {G + 1})) AS i), (SELECT unnest(range(0, {G + 1})) AS j) WHERE i + j <= {G}
""")
view("cand_v", """
SELECT recording_id, speaker_id, sex, cand, avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, z_f1 * w1 + z_f2 * w2 + z_f3 * w3 + 0.5))) AS score
FROM z_v, grid_v WHERE NOT outlier AND z_f1 IS NOT NULL AND z_f2 IS NOT NULL AND z_f3 IS NOT NULL GROUP BY ALL
""", ("z_v", "grid_v"))


@query("simplex_grid", "U7", ("grid_v", "phones_v"), """
SELECT lang, CAST(cand AS INTEGER) AS cand, round(w1, 9) AS w1, round(w2, 9) AS w2, round(w3, 9) AS w3 FROM grid_v, (SELECT DISTINCT lang FROM phones_v) WHERE w2 >= 0.1
""")
def simplex_grid(spark, d):
    """A grid for each language that the phones speak."""
    g = FT.simplex_grids(A.phones(spark, d).select("lang").distinct(), G, 0.1)
    return g.select("lang", "cand", *[F.round(c, 9).alias(c) for c in ("w1", "w2", "w3")])


def utterance_z(spark, d):
    z = P.attach_reference(P.flag_outliers(A.phones(spark, d)), P.reference_wide(PQ.score_stats(spark, d)))
    return z.where(~F.col("outlier")).select("recording_id", F.col("z_f1").alias("z1"), F.col("z_f2").alias("z2"), F.col("z_f3").alias("z3"))


def who(spark, d):
    return A.phones(spark, d).select("recording_id", "speaker_id", "sex").distinct()


def candidate_scores(spark, d):
    return evaluated(spark, d, FT.simplex_grid(spark, G), lambda s: s)


def evaluated(spark, d, candidates, evaluate):
    """``evaluate`` of the scores of all candidates, block by block."""
    owners = who(spark, d)
    return FT.search(utterance_z(spark, d), "recording_id", candidates, lambda s: evaluate(s.join(owners, "recording_id")))


@query("candidate_scores", "J10 D4", ("cand_v",), "SELECT recording_id, cand, round(score, 6) AS score FROM cand_v")
def candidate_scores_q(spark, d):
    return candidate_scores(spark, d).select("recording_id", "cand", *r6("score"))


def _fold_sql(unit: str) -> str:
    return f"CAST(CAST('0x' || left(sha1('{SEED}|' || {unit}), 8) AS BIGINT) % {K} AS INTEGER)"


def _cv_views(name: str, src: str, unit: str, needs) -> None:
    view(name, f"""
    SELECT cand, avg(acc) AS mean_acc, stddev_pop(acc) AS std_acc FROM (
      SELECT f.cand, f.fold, avg(CASE WHEN (sex = 'M' AND score <= thr) OR (sex = 'F' AND score >= thr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
      FROM (SELECT *, {_fold_sql(unit)} AS fold FROM {src}) f
      JOIN (SELECT cand, fold, quantile_cont(score, 0.5) AS thr FROM (
          SELECT cand, score, unnest(list_filter(range(0, {K}), lambda x: x <> {_fold_sql(unit)})) AS fold FROM {src}) GROUP BY ALL) t
      ON f.cand = t.cand AND f.fold = t.fold GROUP BY ALL) GROUP BY cand
    """, needs)


view("spk_cand_v", "SELECT speaker_id, sex, cand, quantile_cont(score, 0.5) AS score FROM cand_v GROUP BY ALL", ("cand_v",))
_cv_views("cv_v", "cand_v", "recording_id", ("cand_v",))
_cv_views("spk_cv_v", "spk_cand_v", "speaker_id", ("spk_cand_v",))


@query("weight_grid_cv", "A27", ("cv_v",), "SELECT cand, round(mean_acc, 6) AS mean_acc, round(std_acc, 6) AS std_acc FROM cv_v")
def weight_grid_cv(spark, d):
    return utterance_cv(spark, d, FT.simplex_grid(spark, G)).select("cand", *r6("mean_acc", "std_acc"))


def units(spark, d, unit):
    return SE.unit_rows(utterance_z(spark, d), "recording_id", who(spark, d), unit, K, SEED)


def utterance_cv(spark, d, candidates):
    return SE.cross_validated(units(spark, d, "recording_id"), candidates, K)


@query("speaker_grid_cv", "A28", ("spk_cv_v",), "SELECT cand, round(mean_acc, 6) AS mean_acc, round(std_acc, 6) AS std_acc FROM spk_cv_v")
def speaker_grid_cv(spark, d):
    return speaker_cv(spark, d, FT.simplex_grid(spark, G)).select("cand", *r6("mean_acc", "std_acc"))


def speaker_cv(spark, d, candidates):
    return SE.cross_validated(units(spark, d, "speaker_id"), candidates, K)


@query("full_fit", "A29", ("cand_v",), """
SELECT c.cand, round(avg(CASE WHEN (sex = 'M' AND score <= thr) OR (sex = 'F' AND score >= thr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS acc
FROM cand_v c JOIN (SELECT cand, quantile_cont(score, 0.5) AS thr FROM cand_v GROUP BY cand) t ON c.cand = t.cand GROUP BY c.cand
""")
def full_fit(spark, d):
    return SE.fitted(units(spark, d, "recording_id"), FT.simplex_grid(spark, G)).select("cand", *r6("acc"))


view("winner_v", """
SELECT s.cand, mean_acc, std_acc, w1, w2, w3 FROM spk_cv_v s JOIN grid_v g ON s.cand = g.cand
ORDER BY round(mean_acc - 1e-6 * std_acc, 12) DESC, std_acc, s.cand LIMIT 1
""", ("spk_cv_v", "grid_v"))


def winner(spark, d):
    grid = FT.simplex_grid(spark, G)
    return FT.best_candidate(speaker_cv(spark, d, grid), grid)


@query("best_weights", "T5 K2", ("winner_v",), "SELECT cand, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(mean_acc, 6) AS mean_acc FROM winner_v")
def best_weights(spark, d):
    return winner(spark, d).select("cand", *r6("w1", "w2", "w3", "mean_acc"))


@query("weights_file", "K2", ("winner_v",), "SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3 FROM winner_v")
def weights_file(spark, d):
    """The winning weights written as a JSON array and read back."""
    from voxrill.sources import writers as W

    path = _written(spark, "weights", lambda p: W.write_json_text(W.weights_json(winner(spark, d)), p))
    w = spark.read.text(path).select(F.from_json("value", "array<double>").alias("w"))
    return w.select(*[F.round(F.get("w", F.lit(i)), 6).alias(f"w{i + 1}") for i in range(3)])


@query("refine_grid", "U7", ("winner_v",), """
SELECT a * 9 + b * 3 + c AS cand, round(x / (x + y + z), 6) AS w1, round(y / (x + y + z), 6) AS w2, round(z / (x + y + z), 6) AS w3 FROM (
  SELECT a, b, c, w1 - 0.05::DOUBLE + a * 0.05::DOUBLE AS x, w2 - 0.05::DOUBLE + b * 0.05::DOUBLE AS y, w3 - 0.05::DOUBLE + c * 0.05::DOUBLE AS z
  FROM winner_v, (SELECT unnest(range(0, 3))::INTEGER AS a), (SELECT unnest(range(0, 3))::INTEGER AS b), (SELECT unnest(range(0, 3))::INTEGER AS c))
WHERE x >= -1e-9 AND y >= -1e-9 AND z >= -1e-9 AND x + y + z > 1e-9
""")
def refine_grid(spark, d):
    return FT.box_grid(winner(spark, d), 0.05, 3).select("cand", *r6("w1", "w2", "w3"))


view("refine_v", """
SELECT a * 9 + b * 3 + c AS cand, x / (x + y + z) AS w1, y / (x + y + z) AS w2, z / (x + y + z) AS w3 FROM (
  SELECT a, b, c, w1 - 0.05::DOUBLE + a * 0.05::DOUBLE AS x, w2 - 0.05::DOUBLE + b * 0.05::DOUBLE AS y, w3 - 0.05::DOUBLE + c * 0.05::DOUBLE AS z
  FROM winner_v, (SELECT unnest(range(0, 3))::INTEGER AS a), (SELECT unnest(range(0, 3))::INTEGER AS b), (SELECT unnest(range(0, 3))::INTEGER AS c))
WHERE x >= -1e-9 AND y >= -1e-9 AND z >= -1e-9 AND x + y + z > 1e-9
""", ("winner_v",))
view("fine_v", """
SELECT recording_id, speaker_id, sex, cand, avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, z_f1 * w1 + z_f2 * w2 + z_f3 * w3 + 0.5))) AS score
FROM z_v, refine_v WHERE NOT outlier AND z_f1 IS NOT NULL AND z_f2 IS NOT NULL AND z_f3 IS NOT NULL GROUP BY ALL
""", ("z_v", "refine_v"))
view("spk_fine_v", "SELECT speaker_id, sex, cand, quantile_cont(score, 0.5) AS score FROM fine_v GROUP BY ALL", ("fine_v",))
_cv_views("fine_cv_v", "spk_fine_v", "speaker_id", ("spk_fine_v",))


@query("refined_weights", "T5 U7 D4", ("winner_v", "refine_v", "fine_cv_v"), """
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(mean_acc, 6) AS mean_acc FROM (
  SELECT 0 AS f, mean_acc, std_acc, w1, w2, w3 FROM winner_v UNION ALL
  (SELECT 1, mean_acc, std_acc, w1, w2, w3 FROM fine_cv_v JOIN refine_v USING (cand) ORDER BY round(mean_acc - 1e-6 * std_acc, 12) DESC, std_acc, cand LIMIT 1))
ORDER BY round(mean_acc, 12) DESC, round(std_acc, 12), f LIMIT 1
""")
def refined_weights(spark, d):
    """The box around the winner is scored too and takes its place only if strictly better."""
    first = cut_lineage(winner(spark, d))
    box = FT.box_grid(first, 0.05, 3)
    best = FT.best_candidate(speaker_cv(spark, d, box), box)
    return FT.keep_better(first, best).select(*r6("w1", "w2", "w3", "mean_acc"))


# --- thresholds and holdout -----------------------------------------------------------------------


def labelled(spark, d):
    lab, doc = A.table(spark, d, "labels"), A.table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select("doc_id", (F.col("quality") == 1).alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"))


view("sweep_v", """
SELECT i AS step, i * 0.001::DOUBLE AS threshold, avg(CASE WHEN (score >= i * 0.001::DOUBLE) = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
FROM (SELECT quality = 1 AS y, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS score FROM labels JOIN documents USING (doc_id)), (SELECT unnest(range(0, 1001)) AS i) GROUP BY i
""")


@query("threshold_sweep", "A25", ("sweep_v",), "SELECT CAST(step AS INTEGER) AS step, round(threshold, 6) AS threshold, round(acc, 6) AS acc FROM sweep_v")
def threshold_sweep(spark, d):
    return FT.threshold_sweep(labelled(spark, d), [], F.col("y"), F.col("score")).select("step", *r6("threshold", "acc"))


@query("best_threshold", "T6", ("sweep_v",), "SELECT round(threshold, 6) AS threshold, round(acc, 6) AS acc FROM sweep_v ORDER BY round(acc, 9) DESC, step LIMIT 1")
def best_threshold(spark, d):
    return FT.best_threshold(FT.threshold_sweep(labelled(spark, d), [], F.col("y"), F.col("score")), []).select(*r6("threshold", "acc"))


view("spk_v", "SELECT speaker_id, sex, quantile_cont(mean_resonance, 0.5) AS score FROM summary_v WHERE mean_resonance IS NOT NULL GROUP BY ALL", ("summary_v",))


@query("holdout_report", "A24", ("spk_v",), """
SELECT round(median_m, 6) AS median_m, round(median_f, 6) AS median_f, speakers_m, speakers_f, round(median_f - median_m, 6) AS delta, round(acc, 6) AS acc,
  median_f - median_m >= 0.18 AND acc >= 0.85 AS passed
FROM (SELECT quantile_cont(score, 0.5) FILTER (sex = 'M') AS median_m, quantile_cont(score, 0.5) FILTER (sex = 'F') AS median_f,
    count(*) FILTER (sex = 'M') AS speakers_m, count(*) FILTER (sex = 'F') AS speakers_f FROM spk_v),
  (SELECT max(acc) AS acc FROM (SELECT avg(CASE WHEN (score >= i * 0.001::DOUBLE) = (sex = 'F') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM spk_v, (SELECT unnest(range(0, 1001)) AS i) GROUP BY i))
""")
def holdout_report(spark, d):
    s = PQ.summaries(spark, d).select("speaker_id", "sex", F.col("mean_resonance").alias("score"))
    return FT.holdout_report(s, []).select("speakers_m", "speakers_f", "passed", *r6("median_m", "median_f", "delta", "acc"))


view("pair_v", """
SELECT recording_id, speaker_id, sex, cand, avg(s) AS score FROM (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(z_f1, 0) * w1 + coalesce(z_f2, 0) * w2 + coalesce(z_f3, 0) * w3 + 0.5)) AS s FROM z_v, grid_v
  WHERE cand IN (110, 77, 55) AND NOT outlier AND (w1 = 0 OR z_f1 IS NOT NULL) AND (w2 = 0 OR z_f2 IS NOT NULL) AND (w3 = 0 OR z_f3 IS NOT NULL))
WHERE s > 0 GROUP BY ALL
""", ("z_v", "grid_v"))


@query("weight_pairs", "A26", ("pair_v",), """
SELECT cand, round(median_m, 6) AS median_m, round(median_f, 6) AS median_f, round(median_f - median_m, 6) AS delta, round(acc, 6) AS acc FROM (
  SELECT cand, quantile_cont(score, 0.5) FILTER (sex = 'M') AS median_m, quantile_cont(score, 0.5) FILTER (sex = 'F') AS median_f FROM spk_cand3_v GROUP BY cand)
JOIN (SELECT cand, max(acc) AS acc FROM (SELECT cand, i, avg(CASE WHEN (score >= i * 0.001::DOUBLE) = (sex = 'F') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
  FROM spk_cand3_v, (SELECT unnest(range(0, 1001)) AS i) GROUP BY ALL) GROUP BY cand) USING (cand)
""".replace("spk_cand3_v", "(SELECT speaker_id, sex, cand, quantile_cont(score, 0.5) AS score FROM pair_v GROUP BY ALL)"))
def weight_pairs(spark, d):
    """Speaker medians of recording means that leave out zeros and need only the z with a weight."""
    pairs = FT.simplex_grid(spark, G).where(F.col("cand").isin(110, 77, 55))
    s = FT.pair_scores(utterance_z(spark, d), "recording_id", pairs).join(who(spark, d), "recording_id")
    s = cut_lineage(s)
    return FT.holdout_report(s, ["cand"]).select("cand", *r6("median_m", "median_f", "delta", "acc"))


# --- calibration -------------------------------------------------------------------------------------


def sessions(spark, d):
    s = PQ.summaries(spark, d)
    return s.withColumn("low_quality", F.col("n_phones") % 3 == 0)


view("bucket_v", """
SELECT lang, sex, count(*) AS n, count(median_resonance) AS n_with_resonance, count(*) FILTER (median_resonance >= 0.98) AS n_at_ceiling,
  count(*) FILTER (n_phones % 3 = 0) AS n_low_align, quantile_cont(median_resonance, 0.05) AS p5, quantile_cont(median_resonance, 0.25) AS p25,
  quantile_cont(median_resonance, 0.5) AS p50, quantile_cont(median_resonance, 0.75) AS p75, quantile_cont(median_resonance, 0.95) AS p95,
  avg(median_resonance) AS mean, CASE WHEN count(median_resonance) > 1 THEN stddev_pop(median_resonance) END AS std, quantile_cont(median_pitch, 0.5) AS f0_p50
FROM summary_v GROUP BY lang, sex
""", ("summary_v",))


@query("bucket_percentiles", "A17", ("bucket_v",), """
SELECT lang, sex, n, n_with_resonance, n_at_ceiling, n_low_align, round(p5, 6) AS p5, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75,
  round(p95, 6) AS p95, round(mean, 6) AS mean, round(std, 6) AS std, round(f0_p50, 6) AS f0_p50 FROM bucket_v
""")
def bucket_percentiles(spark, d):
    b = AU.bucket_percentiles(sessions(spark, d), ["lang", "sex"])
    return b.select("lang", "sex", "n", "n_with_resonance", "n_at_ceiling", "n_low_align", *r6("p5", "p25", "p50", "p75", "p95", "mean", "std", "f0_p50"))


@query("bucket_csv", "K3", ("bucket_v",), """
SELECT lang || '_' || sex AS bucket, CAST(n AS VARCHAR) AS n, coalesce(printf('%.2f', round(f0_p50, 6)), '') AS f0_p50, CAST(n_at_ceiling AS VARCHAR) AS n_at_ceiling FROM bucket_v
""")
def bucket_csv(spark, d):
    from voxrill.sources.writers import bucket_cells

    b = AU.bucket_percentiles(sessions(spark, d), ["lang", "sex"]).withColumn("f0_p50", F.round("f0_p50", 6))
    return bucket_cells(b, digits=2).select("bucket", "n", "f0_p50", "n_at_ceiling")


def _written(spark, name, write):
    """Write below the shared folder and give the path."""
    path = shared_folder(spark, name)
    write(path)
    return path


@query("bucket_csv_file", "K3", ("bucket_v",), """
SELECT lang || '_' || sex AS bucket, CAST(n AS VARCHAR) AS n, CAST(n_with_resonance AS VARCHAR) AS n_with_resonance, """ + ", ".join(
    f"coalesce(printf('%.2f', round({c}, 6)), '') AS {c}" for c in ("p50", "mean", "std", "f0_p50")) + """,
  CAST(n_at_ceiling AS VARCHAR) AS n_at_ceiling, CAST(n_low_align AS VARCHAR) AS n_low_align FROM bucket_v
""")
def bucket_csv_file(spark, d):
    """The report written as CSV and read back as text."""
    from voxrill.sources import writers as W

    b = AU.bucket_percentiles(sessions(spark, d), ["lang", "sex"])
    cells = W.bucket_cells(b.withColumns({c: F.round(c, 6) for c in ("p50", "mean", "std", "f0_p50")}), digits=2)
    back = spark.read.option("header", "true").option("emptyValue", "").csv(_written(spark, "csv", lambda p: W.write_csv(cells, p)))
    names = ("bucket", "n", "n_with_resonance", "p50", "mean", "std", "f0_p50", "n_at_ceiling", "n_low_align")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names])


@query("vowel_csv_file", "K3", ("vowel_v",), """
SELECT lang, sex, vowel, CAST(count(resonance_med) AS VARCHAR) AS n_sessions, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS n_phones_total FROM vowel_v GROUP BY lang, sex, vowel
""")
def vowel_csv_file(spark, d):
    """One folder for each bucket of the per-vowel report, read back."""
    from voxrill.sources import writers as W

    cells = W.vowel_cells(AU.vowel_pool(PQ.vowels(spark, d), ["lang", "sex"], VOWEL_METRICS))
    back = spark.read.option("header", "true").csv(_written(spark, "csv", lambda p: W.write_csv(cells, p, ["lang", "sex"])))
    return back.select("lang", "sex", "vowel", "n_sessions", "n_phones_total")


VOWEL_METRICS = ["resonance_med", "z_f1_med", "z_f2_med", "z_f3_med", "f1_med_hz", "f2_med_hz", "f3_med_hz"]


@query("per_vowel_pool", "A18", ("vowel_v",), "SELECT lang, sex, vowel, count(resonance_med) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_phones_total, " + ", ".join(f"round(quantile_cont({m}, 0.5), 6) AS {m}_p50" for m in VOWEL_METRICS) + " FROM vowel_v GROUP BY lang, sex, vowel")
def per_vowel_pool(spark, d):
    p = AU.vowel_pool(PQ.vowels(spark, d), ["lang", "sex"], VOWEL_METRICS)
    return p.select("lang", "sex", "vowel", "n_sessions", "n_phones_total", *r6(*[f"{m}_p50" for m in VOWEL_METRICS]))


@query("score_histogram", "A19", ("scored_v",), """
SELECT g.sex, g.bin, coalesce(n, 0) AS n FROM (SELECT 'F' AS sex, unnest(range(0, 20))::INTEGER AS bin UNION ALL SELECT 'M', unnest(range(0, 20))::INTEGER) g
LEFT JOIN (SELECT sex, CAST(greatest(0, least(19, floor(resonance * 20))) AS INTEGER) AS bin, count(*) AS n FROM scored_v WHERE resonance IS NOT NULL GROUP BY ALL) h ON g.sex = h.sex AND g.bin = h.bin
""")
def score_histogram(spark, d):
    return AU.histogram(PQ.scored(spark, d), ["sex"], F.col("resonance"))


# --- audits -------------------------------------------------------------------------------------------

view("audit_spk_v", "SELECT speaker_id, sex, quantile_cont(median_resonance, 0.5) AS med FROM summary_v WHERE median_resonance IS NOT NULL GROUP BY ALL", ("summary_v",))
view("audit_v", "SELECT sex, count(*) AS n, avg(med) AS mean, " + ", ".join(
    f"list_sort(list(med))[greatest(0, least(count(*) - 1, CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT))) + 1] AS {n}" for n, p in AU.PCTS.items()
) + " FROM audit_spk_v GROUP BY sex", ("audit_spk_v",))


def speakers(spark, d):
    return cut_lineage(AU.speaker_medians(PQ.summaries(spark, d), ["speaker_id", "sex"], "median_resonance"))


PCT_COLS = list(AU.PCTS)


@query("nearest_rank_audit", "A20", ("audit_v",), "SELECT sex, n, round(mean, 6) AS mean, " + ", ".join(f"round({p}, 6) AS {p}" for p in PCT_COLS) + " FROM audit_v")
def nearest_rank_audit(spark, d):
    return AU.nearest_rank(speakers(spark, d), ["sex"], "median_resonance").select("sex", "n", *r6("mean", *PCT_COLS))


view("own_v", f"""
SELECT s.*, (f1 - m1) / nullif(s1, 0) AS own_1, (f2 - m2) / nullif(s2, 0) AS own_2, (f3 - m3) / nullif(s3, 0) AS own_3
FROM scored_v s JOIN ref_v r ON s.lang = r.lang AND s.pkey = r.phoneme WHERE {PQ._IS_VOWEL.replace('lang', 's.lang')}
""", ("scored_v", "ref_v"))


def own_vowels(spark, d):
    """Scored vowels with z against the statistics of the label itself; labels without statistics are left out."""
    v = PQ.scored(spark, d).withColumn("vowel", S.vowel_label(F.col("lang"), F.col("phoneme"))).where(S.is_vowel_label(F.col("lang"), F.col("vowel")))
    own = P.attach_reference(v.drop("z_f0", "z_f1", "z_f2", "z_f3").withColumn("expected", F.col("phoneme")), P.reference_wide(PQ.score_stats(spark, d)))
    known = P.reference_wide(PQ.score_stats(spark, d)).select(F.col("lang").alias("_l"), F.col("phoneme").alias("_p"))
    return own.join(known, (F.col("lang") == F.col("_l")) & (S.phone_key(F.col("lang"), F.col("phoneme")) == F.col("_p")), "left_semi")


@query("noisy_vowels", "A23", ("own_v",), """
SELECT lang, sex, vowel, round(avg(CASE WHEN resonance <= 0.02 OR resonance >= 0.98 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS sat_rate
FROM own_v WHERE resonance IS NOT NULL GROUP BY lang, sex, vowel HAVING avg(CASE WHEN resonance <= 0.02 OR resonance >= 0.98 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.05
""")
def noisy_vowels(spark, d):
    """Vowels with many scores at the ends of the scale; 5 % instead of the usual 50 %, which these tables never reach."""
    return AU.noisy_labels(own_vowels(spark, d), ["lang", "sex", "vowel"], 0.05).select("lang", "sex", "vowel", *r6("sat_rate"))


@query("saturation_audit", "A21", ("own_v",), """
SELECT lang, sex, vowel, count(own_1) AS n, round(avg(CASE WHEN resonance IS NOT NULL THEN CASE WHEN resonance <= 0.02 OR resonance >= 0.98 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS sat_rate,
  round(quantile_cont(f1, 0.5), 6) AS f1, round(quantile_cont(f2, 0.5), 6) AS f2, round(quantile_cont(f3, 0.5), 6) AS f3, round(quantile_cont(own_1, 0.5), 6) AS z_f1,
  round(quantile_cont(own_2, 0.5), 6) AS z_f2, round(quantile_cont(own_3, 0.5), 6) AS z_f3
FROM own_v GROUP BY lang, sex, vowel HAVING count(own_1) >= 3
""")
def saturation_audit(spark, d):
    return AU.saturation(own_vowels(spark, d), ["lang", "sex", "vowel"]).select("lang", "sex", "vowel", "n", *r6("sat_rate", "f1", "f2", "f3", "z_f1", "z_f2", "z_f3"))


@query("zone_thresholds", "A22", ("audit_v",), """
SELECT unnest(['clearly_male', 'leans_male', 'neutral', 'leans_female', 'clearly_female']) AS zone, unnest([NULL, round(p5, 3), round(p25, 3), round(p75, 3), round(p95, 3)]) AS lo,
  unnest([round(p5, 3), round(p25, 3), round(p75, 3), round(p95, 3), NULL]) AS hi FROM audit_v WHERE sex = 'F'
""")
def zone_thresholds(spark, d):
    return AU.zone_thresholds(AU.nearest_rank(speakers(spark, d), ["sex"], "median_resonance"))


@query("decision_metrics", "A23", ("audit_v",), """
SELECT round(greatest(f.p5, m.p5), 6) AS overlap_lo, round(least(f.p95, m.p95), 6) AS overlap_hi, round(f.p50 - m.p50, 6) AS gap,
  greatest(f.p5, m.p5) < least(f.p95, m.p95) AS overlaps, (SELECT count(*) FROM audit_spk_v WHERE sex = 'F' AND med >= 0.98) AS f_top,
  (SELECT count(*) FROM audit_spk_v WHERE sex = 'M' AND med >= 0.98) AS m_top, (SELECT count(*) FROM audit_spk_v WHERE sex = 'M' AND med <= 0.02) AS m_bottom
FROM audit_v f, audit_v m WHERE f.sex = 'F' AND m.sex = 'M'
""")
def decision_metrics(spark, d):
    s = speakers(spark, d)
    m = AU.decision_metrics(AU.nearest_rank(s, ["sex"], "median_resonance"), s, "median_resonance")
    return m.select("overlaps", "f_top", "m_top", "m_bottom", *r6("overlap_lo", "overlap_hi", "gap"))


@query("literature_check", "J17", ("key_v",), """
SELECT l.vowel, literature, coalesce(n, 0) AS n, round(CASE WHEN n >= 5 THEN med END, 6) AS med,
  CASE WHEN coalesce(n, 0) < 5 THEN 'n<5' WHEN med / literature < 0.75 THEN 'COLLAPSE' WHEN med / literature < 0.85 THEN 'low' ELSE 'ok' END AS verdict
FROM (SELECT unnest(['i', 'y', 'e', 'ej', 'ə', 'a', 'u']) AS vowel, unnest([2700.0, 2300, 2200, 2100, 1700, 1400, 800])::DOUBLE AS literature) l
LEFT JOIN (SELECT pkey AS vowel, count(f2) AS n, quantile_cont(f2, 0.5) AS med FROM key_v WHERE sex = 'F' AND lang = 'zh' AND f2 IS NOT NULL GROUP BY ALL) m ON l.vowel = m.vowel
""")
def literature_check(spark, d):
    lit = spark.createDataFrame([(k, float(v)) for k, v in D.LITERATURE_F2.items()], "vowel string, literature double")
    p = PQ.keyed(spark, d).where("sex = 'F' AND lang = 'zh'").withColumnRenamed("phoneme", "vowel")
    return AU.literature_check(p, lit, "vowel", F.col("f2")).withColumn("med", F.round("med", 6))


@query("result_join", "J8 S16", ("speakers_v",), """
SELECT speaker_id, CASE WHEN speaker_id % 5 = 0 THEN 'no raw json' WHEN speaker_id % 5 IN (1, 4) THEN 'json decode' WHEN speaker_id % 5 = 2 THEN 'zero phones' END AS reason,
  CASE WHEN speaker_id % 5 = 3 THEN round(speaker_id / 1000.0::DOUBLE, 6) END AS median
FROM speakers_v
""")
def result_join(spark, d):
    """A result file for each speaker, written and read back; some are missing, broken, empty or without phones."""
    from voxrill.sources.readers import join_results, read_results

    m = A.speakers(spark, d).select("speaker_id")
    k = F.col("speaker_id") % 5
    whole = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("phoneme"))).alias("phones"), (F.col("speaker_id") / 1000).alias("medianResonance")))
    raw = m.where("speaker_id % 5 <> 0").select("speaker_id", F.when(k == 1, "{oops").when(k == 2, '{"phones":[]}').when(k == 4, "").otherwise(whole).alias("raw"))
    # A file each: all tasks write, and each moves its own files in place, so neither one task nor the driver handles them all.
    raw = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "speaker_id")
    path = _written(spark, "results", lambda p: raw.write.partitionBy("speaker_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(p))
    files = read_results(spark, path, "speaker_id", r"/speaker_id=([^/]+)/").withColumn("speaker_id", F.col("speaker_id").cast("long"))
    return join_results(m, files, "speaker_id", "raw").select("speaker_id", "reason", F.when(F.col("reason").isNull(), F.round("result.medianResonance", 6)).alias("median"))


# --- category evaluation -----------------------------------------------------------------------------------


def category_segments(spark, d):
    t = A.timeline(spark, d)
    cat = F.element_at(F.array(*[F.lit(c) for c in ("cis_female", "cis_male", "neutral")]), (F.col("recording_id") % 3 + 1).cast("int"))
    return t.where("kind IN ('click', 'purchase')").select(
        F.col("recording_id").alias("file"), cat.alias("category"),
        F.when(cat == "cis_female", "female").when(cat == "cis_male", "male").otherwise("neutral").alias("truth"),
        F.when(F.col("kind") == "click", "female").otherwise("male").alias("label"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("margin"), F.col("k").cast("double").alias("duration"),
    )


view("cat_v", """
SELECT recording_id AS file, ['cis_female', 'cis_male', 'neutral'][recording_id % 3 + 1] AS category, ['female', 'male', 'neutral'][recording_id % 3 + 1] AS truth,
  CASE kind WHEN 'click' THEN 'female' ELSE 'male' END AS label, least(value / 100, 1.0::DOUBLE) AS margin, k::DOUBLE AS duration FROM timeline_v WHERE kind IN ('click', 'purchase')
""", ("timeline_v",))


@query("category_margins", "A30", ("cat_v",), "SELECT category, count(DISTINCT file) AS files, count(margin) AS segs, round(avg(margin), 3) AS mean, " + ", ".join(
    f"round(quantile_cont(margin, {p}), 6) AS {n}" for n, p in {**AU.PCTS, "p10": 0.1, "p90": 0.9}.items()) + " FROM cat_v GROUP BY category")
def category_margins(spark, d):
    m = AU.margin_percentiles(category_segments(spark, d), ["category"])
    return m.select("category", "files", "segs", *r3("mean"), *r6(*PCT_COLS, "p10", "p90"))


@query("category_accuracy", "A30", ("cat_v",), """
SELECT category, count(*) AS segs, round(avg(CASE WHEN truth <> 'neutral' THEN CASE WHEN label = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS accuracy FROM cat_v GROUP BY category
""")
def category_accuracy(spark, d):
    return AU.category_accuracy(category_segments(spark, d), ["category"]).withColumn("accuracy", F.round("accuracy", 6))


@query("minority_ratio", "A30", ("cat_v",), """
SELECT category, count(*) AS files, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90,
  round(quantile_cont(r, 0.95), 6) AS p95, round(max(r), 6) AS top, count(*) FILTER (r > 0) AS mixed FROM (
  SELECT category, file, 1 - max(d) / sum(d) AS r FROM (SELECT category, file, label, sum(duration) AS d FROM cat_v GROUP BY ALL) GROUP BY ALL HAVING sum(d) > 0) GROUP BY category
""")
def minority_ratio(spark, d):
    r = AU.minority_ratio(category_segments(spark, d), ["category"])
    return AU.minority_report(r, ["category"]).select("category", "files", "mixed", *r6("mean", "p50", "p90", "p95", "top"))


@query("category_pitch", "A30", ("cat_v",), """
SELECT category, count(*) AS files, round(avg(f0), 6) AS mean, round(quantile_cont(f0, 0.1), 6) AS p10, round(quantile_cont(f0, 0.5), 6) AS p50,
  round(quantile_cont(f0, 0.9), 6) AS p90, round(min(f0), 6) AS low, round(max(f0), 6) AS high
FROM (SELECT category, file, CASE WHEN file % 4 = 0 THEN 0 ELSE sum(duration) END AS f0 FROM cat_v GROUP BY category, file) WHERE f0 > 0 GROUP BY category
""")
def category_pitch(spark, d):
    """The files' own pitch; every fourth file has none."""
    f = category_segments(spark, d).groupBy("category", "file").agg(F.sum("duration").alias("f0"))
    p = AU.category_pitch(f.withColumn("f0", F.when(F.col("file") % 4 == 0, 0.0).otherwise(F.col("f0"))), ["category"])
    return p.select("category", "files", *r6("mean", "p10", "p50", "p90", "low", "high"))


@query("file_detail", "A30", ("cat_v",), """
SELECT category, file, count(*) AS segs, count(*) FILTER (label = 'female') AS n_female, count(*) FILTER (label = 'male') AS n_male,
  round(sum(margin * duration) / nullif(sum(duration), 0), 4) AS mean_margin, round(min(margin), 6) AS min_margin,
  round(avg(CASE WHEN truth <> 'neutral' THEN CASE WHEN label = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS accuracy FROM cat_v GROUP BY category, file
""")
def file_detail(spark, d):
    f = AU.file_detail(category_segments(spark, d), ["category"])
    return f.select("category", "file", "segs", "n_female", "n_male", F.round("mean_margin", 4).alias("mean_margin"), *r6("min_margin", "accuracy"))


@query("variant_stats", "A31", ("cat_v",), """
SELECT category, variant, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_pop(v), 6) AS std, count(*) FILTER (v BETWEEN 0.4 AND 0.7) AS n_mid, round(min(v), 6) AS low, round(max(v), 6) AS high
FROM (SELECT category, 'old' AS variant, margin AS v FROM cat_v UNION ALL SELECT category, 't2', margin * 0.8 FROM cat_v) GROUP BY ALL
""")
def variant_stats(spark, d):
    v = AU.variant_stats(category_segments(spark, d), ["category"], {"old": F.col("margin"), "t2": F.col("margin") * 0.8})
    return v.select("category", "variant", "n", "n_mid", *r3("mean"), *r6("std", "low", "high"))


@query("extreme_files", "T7", ("cat_v",), """
SELECT category, arg_min(file, struct_pack(m, f := file)) AS lowest, round(min(m), 3) AS lowest_value, arg_max(file, struct_pack(m, f := file)) AS highest, round(max(m), 3) AS highest_value
FROM (SELECT category, file, avg(margin) AS m FROM cat_v GROUP BY ALL) GROUP BY category
""")
def extreme_files(spark, d):
    f = category_segments(spark, d).groupBy("category", "file").agg(F.avg("margin").alias("m"))
    e = AU.extreme_files(f, ["category"], "m")
    return e.select("category", "lowest", "highest", *r3("lowest_value", "highest_value"))


def _variants_sql() -> str:
    return ", ".join(f"('{v}', {p!r}::DOUBLE, {f!r}::DOUBLE)" for v, (p, f) in AU.VARIANTS.items())


view("variant_v", f"""
SELECT lang, variant, quantile_cont(p, 0.5) AS f0, quantile_cont(s, 0.5) AS score FROM (
  SELECT lang, variant, recording_id, quantile_cont(CASE WHEN f0 <> 0 THEN f0 * pf END, 0.5) AS p, quantile_cont(CASE WHEN r <> 0 THEN r END, 0.5) AS s FROM (
    SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + CASE WHEN lang = 'en' THEN 0.7321428571428571::DOUBLE * z1 + 0.26785714285714285::DOUBLE * z2
      ELSE 0.762::DOUBLE * z1 + 0.236::DOUBLE * z2 + 0.002::DOUBLE * z3 END)) * CASE WHEN z1 + z2 + CASE WHEN lang = 'en' THEN 0 ELSE z3 END IS NULL THEN NULL ELSE 1 END AS r
    FROM (SELECT o.lang, o.recording_id, o.f0, variant, pf, CASE WHEN a.phoneme IS NOT NULL THEN (f1 * ff - b.m1) / nullif(b.s1, 0) END AS z1,
        CASE WHEN a.phoneme IS NOT NULL THEN (f2 * ff - b.m2) / nullif(b.s2, 0) END AS z2, CASE WHEN a.phoneme IS NOT NULL THEN (f3 * ff - b.m3) / nullif(b.s3, 0) END AS z3
      FROM outlier_v o CROSS JOIN (VALUES {_variants_sql()}) v(variant, pf, ff)
      LEFT JOIN ref_v a ON o.lang = a.lang AND o.pkey = a.phoneme LEFT JOIN ref_v b ON o.lang = b.lang AND o.ekey = b.phoneme WHERE NOT outlier))
  GROUP BY ALL) GROUP BY ALL
""", ("outlier_v", "ref_v"))


@query("variant_checks", "J20", ("variant_v",), """
SELECT lang, abs(v0.f0 - vp.f0) <= 0.5 AND abs(v0.score - vp.score) <= 0.005 AS repeatable, v1.f0 > v0.f0 AND v0.f0 > v2.f0 AS pitch_direction,
  v3.score > v4.score AS formant_direction, v3.score - v4.score >= 0.05 AS formant_amplitude, round(v3.score - v4.score, 6) AS score_gap, round(v1.f0 / v2.f0, 6) AS pitch_ratio
FROM (SELECT * FROM variant_v WHERE variant = 'V0') v0 JOIN (SELECT * FROM variant_v WHERE variant = 'V0p') vp USING (lang) JOIN (SELECT * FROM variant_v WHERE variant = 'V1') v1 USING (lang)
JOIN (SELECT * FROM variant_v WHERE variant = 'V2') v2 USING (lang) JOIN (SELECT * FROM variant_v WHERE variant = 'V3') v3 USING (lang) JOIN (SELECT * FROM variant_v WHERE variant = 'V4') v4 USING (lang)
""")
def variant_checks(spark, d):
    """Every phone shifted in pitch or formants and scored again: what its recordings then report is compared."""
    shifted = P.score_phones(A.phones(spark, d), PQ.score_stats(spark, d), spread=AU.shifted_phones)
    summary = P.hold_summary(P.recording_summary(shifted, ["source", "recording_id", "lang", "variant"]), shifted)
    out = AU.compare_variants(AU.variant_runs(summary))
    return out.select("lang", "repeatable", "pitch_direction", "formant_direction", "formant_amplitude", *r6("score_gap", "pitch_ratio"))


@query("range_assertions", "A40", ("vowel_v",), f"""
SELECT lang, sex AS variant, bool_and(coalesce(resonance_med BETWEEN 0 AND 1, false)) AS score_in_range,
  bool_and(coalesce(CASE WHEN resonance_med >= {D.LEVEL_GOOD} THEN 'good' WHEN resonance_med >= {D.LEVEL_WEAK} THEN 'low' WHEN resonance_med IS NOT NULL THEN 'weak' END IN ('good', 'low', 'weak'), false)) AS levels_ok,
  bool_and(len(list_filter(json_keys(to_json(v)), lambda k: k IN ('weakest_formant', 'z', 'F_med_hz'))) = 0) AS no_legacy,
  bool_and(coalesce(n >= 2, false)) AS enough_tokens, count(*) AS rows_checked
FROM vowel_v v GROUP BY lang, sex
""")
def range_assertions(spark, d):
    """Each language and variant (here the sex) by itself."""
    v = PQ.vowels(spark, d)
    return AU.range_assertions(v.withColumn("variant", F.col("sex")), ["lang", "variant"])
