"""Corpus preparation: joins, bounds, balanced and speaker-disjoint selection, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators.ordered import scan


def seeded(seed: str, *parts: str) -> Column:
    """Reproducible shuffle key."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def hash_block(col: str, digits: int = 3) -> Column:
    """Block of a hex digest: its leading digits, evenly filled whatever the keys are.

    A digit more divides a block's rows by 16; choose as many as keep a block within a task.
    """
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


def join_index(clips: DataFrame, speakers: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Clips with a labelled speaker and a non-empty transcript."""
    labelled = speakers.where(F.col("gender").isin("male", "female"))
    return clips.join(labelled, "speaker_id").join(transcripts.where("sentence <> ''"), "utt")


def within_duration(clips: DataFrame, lang: Column, seconds: Column) -> DataFrame:
    """Keep clips inside the duration bounds of their corpus language."""
    lo = S.pick({k: v[0] for k, v in D.DURATION_BOUNDS.items()}, lang)
    hi = S.pick({k: v[1] for k, v in D.DURATION_BOUNDS.items()}, lang)
    return clips.where(seconds.between(lo, hi))


def with_durations(manifest: DataFrame, durations: DataFrame, lo_ms: int, hi_ms: int) -> DataFrame:
    """Manifest rows whose clip has a known duration inside the range."""
    ok = durations.where(F.col("duration_ms").between(lo_ms, hi_ms))
    return manifest.join(ok, "path")


def cap_per_speaker(clips: DataFrame, speaker: str, order: Sequence, cap: int, name: str = "rn") -> DataFrame:
    """First ``cap`` clips per speaker; the limit is applied per task before the shuffle."""
    w = Window.partitionBy(speaker).orderBy(*order)
    return clips.withColumn(name, F.row_number().over(w)).where(F.col(name) <= cap)


def balanced_sample(clips: DataFrame, n: int, cap: int, seed: str) -> DataFrame:
    """Alternate male and female speakers, up to ``cap`` clips each, until ``n`` clips; then a shuffled cut at ``n``.

    Speakers are ordered by a seeded hash, so the sample is reproducible.  When
    one sex runs out the other continues.
    """
    picked = cap_per_speaker(clips.withColumn("_h", seeded(seed, "clip_id")), "speaker_id", ["_h"], cap)
    spk = picked.groupBy("speaker_id", "gender").agg(F.count(F.lit(1)).alias("_k")).withColumn("_sh", seeded(seed, "speaker_id"))
    spk = scan(spk, ["gender"], ["_sh", "speaker_id"], hash_block("_sh"), sums={"_turn": F.lit(1)})
    spk = spk.withColumn("_side", F.when(F.col("gender") == "male", 0).otherwise(1)).withColumn("_all", F.lit(0))
    spk = scan(spk, ["_all"], ["_turn", "_side"], F.floor(F.col("_turn") / 10000), sums={"_upto": F.col("_k")})
    chosen = spk.where(F.col("_upto") - F.col("_k") < n).select("speaker_id")
    return picked.join(chosen, "speaker_id", "left_semi").orderBy("_h", "clip_id").limit(n).drop("_h", "rn")


def round_robin(clips: DataFrame, cap: int, order: Sequence) -> DataFrame:
    """Interleave speakers: everyone's first clip, then everyone's second, up to ``cap``."""
    return cap_per_speaker(clips, "speaker_id", order, cap, "turn")


def gender_balance(clips: DataFrame, seed: str) -> DataFrame:
    """Cut the larger sex to the size of the smaller (in seeded order)."""
    keyed = clips.withColumn("_h", seeded(seed, "clip_id"))
    ranked = scan(keyed, ["gender"], ["_h", "clip_id"], hash_block("_h"), sums={"_r": F.lit(1)})
    # One row per sex, then one scalar.
    both = F.array("male", "female")
    sizes = clips.groupBy().agg(F.count_if(F.col("gender") == "male").alias("male"), F.count_if(F.col("gender") == "female").alias("female"))
    smaller = sizes.select(F.array_min(both).alias("n")).scalar()
    return ranked.where(F.col("_r") <= smaller).drop("_h", "_r")


def first_clips(clips: DataFrame, k: int, order: Sequence) -> DataFrame:
    """The first ``k`` clips of each speaker as one row; speakers with fewer are dropped."""
    top = cap_per_speaker(clips, "speaker_id", order, k)
    rows = F.sort_array(F.collect_list(F.struct("rn", "clip_id", "sentence", "duration_ms")))
    s = top.groupBy("speaker_id", "gender").agg(F.count(F.lit(1)).alias("_n"), rows.alias("_r"), F.sum("duration_ms").alias("duration_ms"))
    return s.where(F.col("_n") == k).select(
        "speaker_id", "gender", "duration_ms",
        F.transform("_r", lambda x: x["clip_id"]).alias("clip_ids"),
        F.array_join(F.transform("_r", lambda x: x["sentence"]), "").alias("transcript"),
    )


def session_windows(clips: DataFrame, k: int, cycles: int, target: int, order: Sequence) -> DataFrame:
    """Disjoint ``k``-clip sessions, one per speaker and cycle, in cycle order up to ``target``."""
    top = cap_per_speaker(clips, "speaker_id", order, k * cycles)
    s = top.withColumn("cycle", F.floor((F.col("rn") - 1) / k).cast("int")).groupBy("speaker_id", "cycle").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_ms").alias("duration_ms"), F.min("clip_id").alias("first_clip")
    )
    return s.where(F.col("_n") == k).orderBy("cycle", "speaker_id").limit(target).drop("_n")


def pick_speakers(speakers: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` speakers per sex in seeded order."""
    w = Window.partitionBy("gender").orderBy("_h", "speaker_id")
    return speakers.withColumn("_h", seeded(seed, "speaker_id")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("_h")


def pool_splits(splits: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Union of splits; where a key repeats, the later split wins."""
    tagged = [s.select(key, value, F.lit(i).alias("_s")) for i, s in enumerate(splits)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.max_by(value, "_s").alias(value))


def not_done(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates without a finished result."""
    return candidates.join(done.select(key), key, "left_anti")


def dedupe_by_content(rows: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(one representative per content, key -> representative): work is done once per content.

    The digest shuffles 64 bytes per row instead of the content, and repeats
    collapse before the shuffle.
    """
    hashed = rows.withColumn("digest", F.sha2(content, 256))
    reps = hashed.groupBy("digest").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))
    return reps, hashed.select(key, "digest").join(reps, "digest")


def split_holdout(clips: DataFrame, seed: str, fraction: float) -> DataFrame:
    """Mark the clips of holdout speakers."""
    return clips.withColumn("holdout", S.speaker_holdout(seed, F.col("speaker_id").cast("string"), fraction))


def totals(clips: DataFrame) -> DataFrame:
    """Clips, speakers' clips and minutes per language and gender, with subtotals."""
    g = clips.rollup("lang", "gender").agg(
        F.count(F.lit(1)).alias("clips"), (F.sum("duration_ms") / 60000.0).alias("minutes"), F.grouping_id().cast("int").alias("level")
    )
    return g
