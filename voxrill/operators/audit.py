"""Evaluation roll-ups: calibration buckets, audits, histograms, stage times, category reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators.ordered import neighbours
from voxrill.operators.quantiles import medians, quantiles

PCTS = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def bucket_percentiles(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibration bucket: counts, linear percentiles, mean, population deviation, pitch median.

    sessions: (keys, median_resonance, median_pitch, low_quality).
    """
    r = F.col("median_resonance")
    base = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(r).alias("n_with_resonance"),
        F.count_if(r >= D.AT_CEILING).alias("n_at_ceiling"), F.count_if("low_quality").alias("n_low_align"),
        F.avg(r).alias("mean"), F.when(F.count(r) > 1, F.stddev_pop(r)).alias("std"),
    )
    # One pass ranks both metrics; of the pitch only the median is kept.
    q = quantiles(sessions, keys, {"": r, "f0_": F.col("median_pitch")}, PCTS)
    return base.join(q.drop(*[f"f0_{p}" for p in PCTS if p != "p50"]), list(keys), "left")


def vowel_pool(vowels: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Median over sessions of session medians, with session and phone counts."""
    group = [*keys, "vowel"]
    base = vowels.groupBy(*group).agg(F.count("resonance_med").alias("n_sessions"), F.sum("n").alias("n_phones_total"))
    med = medians(vowels, group, {m: F.col(m) for m in metrics})
    out = base.where("n_sessions > 0").join(med, group, "left")
    return out.select(*group, "n_sessions", "n_phones_total", *[F.col(m).alias(f"{m}_p50") for m in metrics])


def histogram(rows: DataFrame, keys: Sequence[str], value: Column, bins: int = 20) -> DataFrame:
    """Counts on [0, 1] in equal bins, outside values in the edge bins, zeros included."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value * bins))).cast("int")
    got = rows.where(value.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = got.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(got, [*keys, "bin"], "left").fillna({"n": 0})


def speaker_medians(recordings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median over the recordings of a speaker."""
    return medians(recordings, keys, {value: F.col(value)})


def nearest_rank(speakers: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and nearest-rank percentiles of speaker values."""
    base = speakers.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = quantiles(speakers, keys, {"": F.col(value)}, PCTS, rule="nearest")
    return base.join(q, list(keys))


def saturation(phones: DataFrame, keys: Sequence[str], min_count: int = 3) -> DataFrame:
    """Per-label medians of formants and z, and the share of scores at the ends of the scale.

    phones: vowels only, with z against the statistics of their own label.
    """
    sat = F.when(F.col("resonance").isNotNull(), ((F.col("resonance") <= 0.02) | (F.col("resonance") >= 0.98)).cast("double"))
    base = phones.groupBy(*keys).agg(F.count("z_f1").alias("n"), F.avg(sat).alias("sat_rate"))
    m = medians(phones, keys, {c: F.col(c) for c in ("f1", "f2", "f3", "z_f1", "z_f2", "z_f3")})
    return base.where(F.col("n") >= min_count).join(m, list(keys), "left")


def noisy_labels(phones: DataFrame, keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Labels with more than ``limit`` of their scores at the ends of the scale."""
    r = F.col("resonance")
    rate = phones.where(r.isNotNull()).groupBy(*keys).agg(F.avg(((r <= 0.02) | (r >= 0.98)).cast("double")).alias("sat_rate"))
    return rate.where(F.col("sat_rate") > limit)


def zone_thresholds(table: DataFrame) -> DataFrame:
    """Zone rows derived from the female percentiles of a nearest-rank table (one row per zone)."""
    f = table.where("sex = 'F'")
    r = lambda c: F.round(c, 3)
    none = F.lit(None).cast("double")
    zones = F.array(
        F.struct(F.lit("clearly_male").alias("zone"), none.alias("lo"), r("p5").alias("hi")),
        F.struct(F.lit("leans_male").alias("zone"), r("p5").alias("lo"), r("p25").alias("hi")),
        F.struct(F.lit("neutral").alias("zone"), r("p25").alias("lo"), r("p75").alias("hi")),
        F.struct(F.lit("leans_female").alias("zone"), r("p75").alias("lo"), r("p95").alias("hi")),
        F.struct(F.lit("clearly_female").alias("zone"), r("p95").alias("lo"), none.alias("hi")),
    )
    return f.select(F.explode(zones).alias("z")).select("z.*")


def decision_metrics(table: DataFrame, speakers: DataFrame, value: str) -> DataFrame:
    """Overlap band, median gap and saturation counts from the two sexes' percentiles."""
    side = lambda sex, c: F.max(F.when(F.col("sex") == sex, F.col(c)))
    t = table.agg(
        F.greatest(side("F", "p5"), side("M", "p5")).alias("overlap_lo"),
        F.least(side("F", "p95"), side("M", "p95")).alias("overlap_hi"),
        (side("F", "p50") - side("M", "p50")).alias("gap"),
    )
    v = F.col(value)
    s = speakers.agg(
        F.count_if((F.col("sex") == "F") & (v >= D.AT_CEILING)).alias("f_top"),
        F.count_if((F.col("sex") == "M") & (v >= D.AT_CEILING)).alias("m_top"),
        F.count_if((F.col("sex") == "M") & (v <= 0.02)).alias("m_bottom"),
    )
    # Both sides are single aggregate rows.
    return t.join(s, F.lit(True)).withColumn("overlaps", F.col("overlap_lo") < F.col("overlap_hi"))


def literature_check(rows: DataFrame, literature: DataFrame, label: str, value: Column) -> DataFrame:
    """Median against a literature value per label: n<5, COLLAPSE, low or ok."""
    m = medians(rows, [label], {"med": value}, counts=True)
    out = literature.join(m, label, "left").withColumn("n", F.coalesce("med_n", F.lit(0)))
    enough, ratio = F.col("n") >= 5, F.col("med") / F.col("literature")
    verdict = F.when(~enough, "n<5").when(ratio < 0.75, "COLLAPSE").when(ratio < 0.85, "low").otherwise("ok")
    return out.select(label, "literature", "n", F.when(enough, F.col("med")).alias("med"), verdict.alias("verdict"))


def stage_profile(events: DataFrame, keys: Sequence[str], at: str, label: str, total: str, block: Column) -> DataFrame:
    """Mean time per stage: each gap counts for the event before it, from task start to task end."""
    step = neighbours(events, keys, [at], block, prev={"_at": F.col(at), "_label": F.col(label)})
    gaps = step.select(*keys, total, F.coalesce("_label", F.lit("boot")).alias("stage"), (F.col(at) - F.coalesce("_at", F.lit(0.0))).alias("dur"))
    tail = events.groupBy(*keys).agg(F.max(total).alias(total), F.max_by(label, at).alias("stage"), F.max(at).alias("_last"))
    tail = tail.select(*keys, total, "stage", (F.col(total) - F.col("_last")).alias("dur"))
    per = gaps.unionByName(tail).groupBy(*keys, "stage").agg(F.sum("dur").alias("secs"), F.max(total).alias(total))
    share = F.col("secs") / F.nullif(F.col(total), F.lit(0.0))
    return per.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.avg("secs").alias("mean_s"), F.avg(share).alias("mean_share"))


def window_robustness(windows: DataFrame, lo: float, hi: float, frame_s: float) -> DataFrame:
    """Per window length: all, computable and in-band windows, and percentiles of their medians and of their voiced seconds.

    windows: (length_s, n, median) as ``sequence.pane_windows`` gives them.
    """
    m = F.col("median")
    base = windows.groupBy("length_s").agg(F.count(F.lit(1)).alias("windows"), F.count(m).alias("computable"), F.count_if(m.between(lo, hi)).alias("in_band"))
    points = {"_p10": 0.1, "_p25": 0.25, "_p50": 0.5, "_p75": 0.75, "_p90": 0.9}
    return base.join(quantiles(windows, ["length_s"], {"m": m, "v": F.col("n") * frame_s}, points), "length_s")


# --- category evaluation -------------------------------------------------------------------------


def margin_percentiles(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = segments.groupBy(*keys).agg(F.count_distinct("file").alias("files"), F.count("margin").alias("segs"), F.avg("margin").alias("mean"))
    q = quantiles(segments, keys, {"": F.col("margin")}, {**PCTS, "p10": 0.10, "p90": 0.90})
    return base.join(q, list(keys), "left")


def category_accuracy(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of segments with the true label; neutral categories are not scored."""
    acc = F.avg(F.when(F.col("truth") != "neutral", (F.col("label") == F.col("truth")).cast("double")))
    return segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segs"), acc.alias("accuracy"))


def minority_ratio(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration share of the labels other than a file's longest, per file."""
    per = segments.groupBy(*keys, "file", "label").agg(F.sum("duration").alias("d"))
    f = per.groupBy(*keys, "file").agg(F.sum("d").alias("_t"), F.max("d").alias("_m"))
    return f.where("_t > 0").select(*keys, "file", ((F.col("_t") - F.col("_m")) / F.col("_t")).alias("ratio"))


def minority_report(ratios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, percentiles, maximum and number of mixed files of minority ratios."""
    q = quantiles(ratios, keys, {"": F.col("ratio")}, {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    a = ratios.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.avg("ratio").alias("mean"), F.max("ratio").alias("top"), F.count_if(F.col("ratio") > 0).alias("mixed"))
    return a.join(q, list(keys))


def category_pitch(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of the files' own pitch per category; files without a positive pitch do not count."""
    known = files.where(F.col("f0") > 0)
    q = quantiles(known, keys, {"": F.col("f0")}, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    a = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.avg("f0").alias("mean"), F.min("f0").alias("low"), F.max("f0").alias("high"))
    return a.join(q, list(keys))


def file_detail(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per file: counts by label, duration-weighted and minimum margin, accuracy."""
    ok = F.when(F.col("truth") != "neutral", (F.col("label") == F.col("truth")).cast("double"))
    return segments.groupBy(*keys, "file").agg(
        F.count(F.lit(1)).alias("segs"), F.count_if(F.col("label") == "female").alias("n_female"), F.count_if(F.col("label") == "male").alias("n_male"),
        (F.sum(F.col("margin") * F.col("duration")) / F.nullif(F.sum("duration"), F.lit(0.0))).alias("mean_margin"),
        F.min("margin").alias("min_margin"), F.avg(ok).alias("accuracy"),
    )


def variant_stats(segments: DataFrame, keys: Sequence[str], variants: Mapping[str, Column]) -> DataFrame:
    """Mean, population deviation and mid-range count per confidence variant (long form)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("v")) for n, c in variants.items()])
    long = segments.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return long.groupBy(*keys, "variant").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.count_if(F.col("v").between(0.4, 0.7)).alias("n_mid"), F.min("v").alias("low"), F.max("v").alias("high"),
    )


def extreme_files(files: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lowest and highest file per category (ties by name)."""
    order = F.struct(value, "file")
    return files.groupBy(*keys).agg(
        F.min_by("file", order).alias("lowest"), F.min(value).alias("lowest_value"),
        F.max_by("file", order).alias("highest"), F.max(value).alias("highest_value"),
    )


# --- fixed values: what the perturbed variants of a recording multiply (pitch by four semitones, formants by a fifth) ---
VARIANTS = {"V0": (1.0, 1.0), "V0p": (1.0, 1.0), "V1": (2 ** (4 / 12), 1.0), "V2": (2 ** (-4 / 12), 1.0), "V3": (1.0, 1.2), "V4": (1.0, 1 / 1.2)}


def shifted_phones(phones: DataFrame, variants: Mapping[str, tuple[float, float]] = VARIANTS) -> DataFrame:
    """Every phone once for each variant, its pitch and its formants multiplied; a recording's variants are recordings of their own.

    The column ``source_id`` keeps the recording, ``recording_id`` names recording and variant.
    """
    table = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(p).alias("p"), F.lit(f).alias("f")) for v, (p, f) in variants.items()])
    each = phones.withColumn("_v", F.explode(table))
    shifted = {"f0": F.col("f0") * F.col("_v.p"), **{c: F.col(c) * F.col("_v.f") for c in ("f1", "f2", "f3")}}
    return each.withColumns({
        **shifted, "source_id": F.col("recording_id"), "variant": F.col("_v.variant"),
        "recording_id": F.concat_ws(":", F.col("recording_id").cast("string"), F.col("_v.variant")),
    }).drop("_v")


def variant_runs(summaries: DataFrame) -> DataFrame:
    """(lang, variant, f0, score): medians over the recordings' median pitch and score."""
    return medians(summaries, ["lang", "variant"], {"f0": F.col("median_pitch"), "score": F.col("median_resonance")})


def compare_variants(runs: DataFrame, f0_tol: float = 0.5, score_tol: float = 0.005, gap: float = 0.05) -> DataFrame:
    """Checks per language over variants V0, V0p, V1..V4: repeatability, direction, amplitude."""
    keys = ["V0", "V0p", "V1", "V2", "V3", "V4"]
    p = runs.groupBy("lang").pivot("variant", keys).agg(F.max("f0").alias("f0"), F.max("score").alias("score"))
    f0 = {k: F.col(f"{k}_f0") for k in keys}
    sc = {k: F.col(f"{k}_score") for k in keys}
    # A missing variant fails its checks.
    sure = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return p.select(
        "lang",
        sure((F.abs(f0["V0"] - f0["V0p"]) <= f0_tol) & (F.abs(sc["V0"] - sc["V0p"]) <= score_tol), "repeatable"),
        sure((f0["V1"] > f0["V0"]) & (f0["V0"] > f0["V2"]), "pitch_direction"),
        sure(sc["V3"] > sc["V4"], "formant_direction"),
        sure(sc["V3"] - sc["V4"] >= gap, "formant_amplitude"), (sc["V3"] - sc["V4"]).alias("score_gap"), (f0["V1"] / f0["V2"]).alias("pitch_ratio"),
    )


# --- fixed values: names of fields that vowel rows no longer have, and the level names -------------
LEGACY_FIELDS = {"weakest_formant", "z", "F_med_hz"}
LEVELS = ["good", "low", "weak"]


def range_assertions(vowels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Checks of vowel rows per group: scores in range, known levels, no former fields, enough tokens."""
    r = F.col("resonance_med")
    sure = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return vowels.groupBy(*keys).agg(
        sure(r.between(0, 1)).alias("score_in_range"), sure(S.level_key(r).isin(LEVELS)).alias("levels_ok"),
        F.lit(not LEGACY_FIELDS & set(vowels.columns)).alias("no_legacy"), sure(F.col("n") >= 2).alias("enough_tokens"), F.count(F.lit(1)).alias("rows_checked"))
