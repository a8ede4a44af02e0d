"""Output forms: JSON objects, fixed-precision CSV cells, manifests, bundles, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrill.operators.ordered import scan
from voxrill.sources.readers import EXPORT_VERSION, MAX_SESSIONS


def _fixed(c: str, digits: int) -> Column:
    """Fixed-precision text; empty for a missing value."""
    return F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{digits}f", c)).alias(c)


def bucket_cells(buckets: DataFrame, digits: int = 4) -> DataFrame:
    """Calibration buckets as text cells in report order."""
    num = ["p5", "p25", "p50", "p75", "p95", "mean", "std", "f0_p50"]
    text = lambda c: F.col(c).cast("string").alias(c)
    return buckets.select(
        F.concat_ws("_", "lang", "sex").alias("bucket"), text("n"), text("n_with_resonance"), *[_fixed(c, digits) for c in num],
        text("n_at_ceiling"), text("n_low_align"))


def vowel_cells(pool: DataFrame, digits: int = 3) -> DataFrame:
    """Per-vowel pool as text cells, largest first within its bucket."""
    num = [c for c in pool.columns if c.endswith("_p50")]
    return pool.orderBy("lang", "sex", F.desc("n_phones_total"), "vowel").select(
        "lang", "sex", "vowel", F.col("n_sessions").cast("string").alias("n_sessions"), F.col("n_phones_total").cast("string").alias("n_phones_total"),
        *[_fixed(c, digits) for c in num])


def write_csv(cells: DataFrame, path: str, partition_by=()) -> None:
    cells.write.mode("overwrite").partitionBy(*partition_by).option("emptyValue", "").csv(path, header=True)


def write_json_text(docs: DataFrame, path: str) -> None:
    """One JSON document per line from a ``json`` column."""
    docs.select("json").write.mode("overwrite").text(path)


def weights_json(winner: DataFrame) -> DataFrame:
    """The winning weights as a JSON array."""
    return winner.select(F.to_json(F.array("w1", "w2", "w3")).alias("json"))


def append_observations(rows: DataFrame, path: str) -> None:
    """Append-only JSON-lines checkpoint of finished observations."""
    rows.write.mode("append").json(path)


def merge_manifest(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing entries not replaced by new ones, followed by the new ones."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_subset(rows: DataFrame, path: str) -> None:
    """Tab-separated subset manifest."""
    rows.select("client_id", "path", "sentence", "gender", "duration_ms").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path, header=True)


def bundle(manifest: DataFrame, results: DataFrame, key: str, created_at: Column, exported_at: Column) -> DataFrame:
    """Manifest row x summary as a nested session bundle; rows without a result are left out.

    results: (key, engine_c struct).
    """
    j = manifest.join(results, key)
    session = F.struct(
        F.element_at(F.split("wav", "/"), -1).alias("filename"),
        F.struct(F.col("engine_c"), F.col("engine_c.median_pitch_hz").alias("overall_f0_median_hz")).alias("summary"),
        F.array().cast("array<string>").alias("analysis"), created_at.alias("created_at"))
    meta = F.struct("lang", "sex", F.col("spk_id"), F.col(key), "duration_sec", F.char_length("transcript").alias("transcript_len_chars"))
    return j.select(
        "lang", "sex", F.lit(EXPORT_VERSION).alias("export_schema_version"), exported_at.alias("exported_at"),
        F.struct(F.array(session).alias("sessions")).alias("payload"), meta.alias("calibration_meta"))


def write_bundles(bundles: DataFrame, path: str) -> None:
    bundles.withColumn("part_lang", F.col("lang")).withColumn("part_sex", F.col("sex")).drop("lang", "sex").write.mode("overwrite").partitionBy("part_lang", "part_sex").json(path)


def export_sessions(sessions: DataFrame, keep_engine: bool = True) -> DataFrame:
    """Slim export form: per-frame confidences dropped, the engine block optional."""
    out = sessions.withColumn("analysis", F.transform("analysis", lambda s: s.dropFields("confidence_frames")))
    return out if keep_engine else out.withColumn("summary", F.col("summary").dropFields("engine_c"))


def export_payload(slim: DataFrame, file_key: str, block: Column, per_file: int = MAX_SESSIONS) -> DataFrame:
    """Export documents of at most ``per_file`` sessions (the importer's limit), numbered per key in the order of idx.

    ``block`` is a monotone function of idx: numbering runs inside blocks, so no key has to fit a task.
    """
    numbered = scan(slim, [file_key], ["idx"], block, sums={"_n": F.lit(1)}).withColumn("file_no", F.floor((F.col("_n") - 1) / per_file).cast("int"))
    session = F.struct("filename", "summary", "analysis", "created_at")
    return numbered.groupBy(file_key, "file_no").agg(
        F.lit(EXPORT_VERSION).alias("export_schema_version"),
        F.struct(F.transform(F.sort_array(F.collect_list(F.struct("idx", session.alias("s")))), lambda x: x["s"]).alias("sessions")).alias("payload"))


def event_params(params: Column) -> Column:
    """Parameters as embedded JSON text; missing fields are left out."""
    return F.to_json(params)
