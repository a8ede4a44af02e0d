"""Reference statistics: training, storage form, comparison of two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.operators.phones import FORMANTS
from voxrill.operators.quantiles import quantile_long


def moments(phones: DataFrame, keys: Sequence[str], min_obs: int, guard: bool = True) -> DataFrame:
    """Count, mean, sample deviation and range per (keys, formant), without the median.

    This is what scoring needs: one map-side-combined aggregate with the four
    formants side by side, turned into rows afterwards.  With ``guard`` a label
    is kept only if F1 and F2 both have enough values, and its other formants
    are filled; without it each formant stands alone.
    """
    aggs = []
    for i, f in enumerate(FORMANTS):
        c = F.col(f)
        aggs.append(F.struct(
            F.lit(i).alias("formant"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stdev"),
            F.max(c).alias("max"), F.min(c).alias("min"),
        ).alias(f"_{f}"))
    wide = phones.groupBy(*keys).agg(*aggs)
    if guard:
        wide = wide.where((F.col("_f1.n") >= min_obs) & (F.col("_f2.n") >= min_obs))
    cells = wide.select(*keys, F.explode(F.array(*[f"_{f}" for f in FORMANTS])).alias("_c")).select(*keys, "_c.*")
    if not guard:
        return cells.where(F.col("n") >= min_obs)
    enough = F.col("n") >= min_obs
    filled = {"n": F.lit(0), "mean": F.lit(0.0), "stdev": F.lit(1.0), "max": F.lit(0.0), "min": F.lit(0.0)}
    return cells.select(*keys, "formant", *[F.when(enough, F.col(c)).otherwise(v).alias(c) for c, v in filled.items()])


def train(phones: DataFrame, keys: Sequence[str], min_obs: int = 200) -> DataFrame:
    """Reference statistics (keys, formant, n, mean, stdev, median, max, min).

    A formant needs ``min_obs`` values, a label needs F1 and F2; a missing
    formant of a kept label is filled with (0, 1, 0, 0, 0).
    """
    base = moments(phones, keys, min_obs)
    mid = quantile_long(phones, keys, {str(i): F.col(f) for i, f in enumerate(FORMANTS)}, [0.5]).select(
        *keys, F.col("metric").cast("int").alias("formant"), F.col("q")[0].alias("_med")
    )
    return base.join(mid, [*keys, "formant"], "left").select(
        *keys, "formant", "n", "mean", "stdev",
        F.when(F.col("n") > 0, F.col("_med")).otherwise(F.lit(0.0)).alias("median"), "max", "min",
    )


def complete_cases(phones: DataFrame) -> DataFrame:
    """Phones with all four values present and non-zero."""
    return phones.where((F.col("f0") != 0) & (F.col("f1") != 0) & (F.col("f2") != 0) & (F.col("f3") != 0))


def train_complete(phones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training on complete cases only; a label needs two of them."""
    full = complete_cases(phones)
    base = moments(full, keys, 2, guard=False)
    mid = quantile_long(full, keys, {str(i): F.col(f) for i, f in enumerate(FORMANTS)}, [0.5]).select(
        *keys, F.col("metric").cast("int").alias("formant"), F.col("q")[0].alias("median")
    )
    return base.join(mid, [*keys, "formant"], "left").select(*keys, "formant", "n", "mean", "stdev", "median", "max", "min")


def align_versions(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("phoneme", "formant")) -> DataFrame:
    """Full outer alignment of two statistics tables with a presence label."""
    o = old.select(*keys, F.col("mean").alias("mean_old"), F.col("stdev").alias("stdev_old"))
    n = new.select(*keys, F.col("mean").alias("mean_new"), F.col("stdev").alias("stdev_new"))
    both = o.join(n, list(keys), "full_outer")
    presence = (
        F.when(F.col("mean_old").isNull(), "added").when(F.col("mean_new").isNull(), "dropped").otherwise("common")
    )
    return both.withColumn("presence", presence)


def top_shift(aligned: DataFrame, formant: int, n: int) -> DataFrame:
    """The ``n`` labels whose mean of one formant moved most, with old and new means of all formants."""
    common = aligned.where("presence = 'common'")
    cells = [F.max(F.when(F.col("formant") == i, F.col(f"mean_{side}"))).alias(f"f{i}_{side}") for i in (1, 2, 3) for side in ("old", "new")]
    wide = common.groupBy("phoneme").agg(*cells).withColumn("shift", F.col(f"f{formant}_new") - F.col(f"f{formant}_old"))
    return wide.where("shift IS NOT NULL").orderBy(F.desc(F.abs("shift")), "phoneme").limit(n)


#: A deviation that grew by more than this factor is reported.
BLOW_UP = 1.5


def drift(aligned: DataFrame) -> DataFrame:
    """Mean shift in old deviations and deviation growth, common cells only (deviation 0 counts as 1)."""
    unit = F.when(F.col("stdev_old") == 0, F.lit(1.0)).otherwise(F.col("stdev_old"))
    return aligned.where("presence = 'common'").select(
        "phoneme", "formant",
        (F.col("mean_new") - F.col("mean_old")).alias("delta"),
        (F.abs(F.col("mean_new") - F.col("mean_old")) / unit).alias("shift"),
        F.when(F.col("stdev_old") > 0, F.col("stdev_new") / F.col("stdev_old")).alias("growth"),
    )


def nested_json(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON object per key group: label -> four {mean, stdev, median, max, min}.

    Statistics are bounded by the phone inventory, so a group fits a row.
    """
    cell = F.struct("mean", "stdev", "median", "max", "min")
    per_phone = stats.groupBy(*keys, "phoneme").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("formant", cell.alias("cell")))), lambda s: s["cell"]).alias("cells")
    )
    entries = F.sort_array(F.collect_list(F.struct("phoneme", "cells")))
    return per_phone.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("json"))
