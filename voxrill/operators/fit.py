"""Score-weight search and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxrill.operators.quantiles import medians
from voxrill.session import cut_lineage


def simplex_grids(groups: DataFrame, g: int, min_f2: float = 0.0) -> DataFrame:
    """For every row of ``groups``, all (i, j, k)/g with i + j + k = g and w2 at or above the floor, numbered in (i, j) order."""
    i = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(g))).alias("i"))
    ij = i.select("*", F.explode(F.sequence(F.lit(0), g - F.col("i"))).alias("j"))
    w = ij.select(
        *groups.columns, (F.col("i") * (g + 1) + F.col("j")).alias("cand"),
        (F.col("i") / g).alias("w1"), (F.col("j") / g).alias("w2"), ((g - F.col("i") - F.col("j")) / g).alias("w3"),
    )
    return w.where(F.col("w2") >= min_f2 - 1e-9)


def simplex_grid(spark: SparkSession, g: int, min_f2: float = 0.0) -> DataFrame:
    """One grid of weights."""
    return simplex_grids(spark.range(1), g, min_f2).drop("id")


def box_grid(winner: DataFrame, half: float, steps: int, min_f2: float = 0.0) -> DataFrame:
    """Grid around a winner row (w1, w2, w3), negatives dropped, renormalised to sum 1.

    The centre is clipped to [0, 1]; where nothing of the box is left it stands alone.
    """
    clipped = winner.select(*[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))).alias(c) for c in ("w1", "w2", "w3")])
    axis = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: -half + s * (2 * half / max(1, steps - 1)))
    g = clipped.select("w1", "w2", "w3", F.posexplode(axis).alias("a", "da"))
    g = g.select("*", F.posexplode(axis).alias("b", "db"))
    g = g.select("*", F.posexplode(axis).alias("c", "dc"))
    x, y, z = F.col("w1") + F.col("da"), F.col("w2") + F.col("db"), F.col("w3") + F.col("dc")
    g = g.select((F.col("a") * steps * steps + F.col("b") * steps + F.col("c")).alias("cand"), x.alias("x"), y.alias("y"), z.alias("z"))
    total = F.col("x") + F.col("y") + F.col("z")
    ok = (F.col("x") >= -1e-9) & (F.col("y") >= -1e-9) & (F.col("z") >= -1e-9) & (total > 1e-9)
    out = g.where(ok).select("cand", (F.col("x") / total).alias("w1"), (F.col("y") / total).alias("w2"), (F.col("z") / total).alias("w3"))
    whole = F.col("w1") + F.col("w2") + F.col("w3")
    centre = clipped.select(F.lit(0).alias("cand"), *[(F.col(c) / whole).alias(c) for c in ("w1", "w2", "w3")])
    # A single row beside a single count.
    alone = centre.join(out.agg(F.count(F.lit(1)).alias("_n")), F.lit(True)).where("_n = 0").drop("_n")
    return out.unionByName(alone).where(F.col("w2") >= min_f2 - 1e-9)


#: Candidates that are scored at a time; their table (three doubles a row) travels with the tasks.
BLOCK_CANDIDATES = 4096


def candidate_blocks(candidates: DataFrame, size: int = BLOCK_CANDIDATES) -> Iterator[list]:
    """The candidates (cand, w1, w2, w3) in order of their number, so many rows at a time."""
    rows = candidates.select("cand", "w1", "w2", "w3").orderBy("cand").toLocalIterator()
    while block := list(islice(rows, size)):
        yield block


def score_block(z: DataFrame, utt: str, block: Sequence) -> DataFrame:
    """Mean clamped score per (utterance, candidate of one block): (utt, cand, score).

    The clip is per phone, so scores cannot be built from utterance sums.  Each
    Arrow batch of phone rows is multiplied with the weight matrix and reduced
    to one partial sum per utterance in the batch before anything is shuffled,
    so a long utterance is spread over tasks.
    """
    weights = np.array([[r["w1"], r["w2"], r["w3"]] for r in block], dtype=np.float64).T

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            codes, names = pd.factorize(b[utt])
            order = np.argsort(codes, kind="stable")
            scores = np.clip(b[["z1", "z2", "z3"]].to_numpy()[order] @ weights + 0.5, 0.0, 1.0)
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            sums = np.add.reduceat(scores, first, axis=0)
            sizes = np.diff(np.r_[first, len(codes)])
            yield pd.DataFrame({utt: names, "n": sizes, "sums": list(sums)})

    kind = dict(z.dtypes)[utt]
    known = z.where(F.col("z1").isNotNull() & F.col("z2").isNotNull() & F.col("z3").isNotNull()).select(utt, "z1", "z2", "z3")
    parts = known.mapInPandas(partial, f"{utt} {kind}, n long, sums array<double>")
    long = parts.select(utt, "n", F.posexplode("sums").alias("_at", "_s"))
    mean = long.groupBy(utt, "_at").agg((F.sum("_s") / F.sum("n")).alias("score"))
    # As many rows as a block has.
    ids = z.sparkSession.createDataFrame([(i, int(r["cand"])) for i, r in enumerate(block)], "_at int, cand long")
    return mean.join(F.broadcast(ids), "_at").select(utt, "cand", "score")


def search(z: DataFrame, utt: str, candidates: DataFrame, evaluate: Callable[[DataFrame], DataFrame], size: int = BLOCK_CANDIDATES) -> DataFrame:
    """``evaluate`` of the scores of every block of candidates, one block after the other, put together.

    Only one block's scores exist at a time; what stays is what ``evaluate`` makes of them.
    """
    out = None
    for block in candidate_blocks(candidates, size):
        one = cut_lineage(evaluate(score_block(z, utt, block)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no candidates")
    return out


def pair_scores(z: DataFrame, utt: str, pairs: DataFrame) -> DataFrame:
    """Recording mean per (utterance, candidate) as a summary has it: (utt, cand, score).

    A phone counts if every z with a weight is known; a z without weight may be missing.  Scores of exactly
    zero do not enter the mean.  For a handful of candidates: each phone row is looked at once for each.
    """
    w = F.broadcast(pairs.select(F.collect_list(F.struct("cand", "w1", "w2", "w3")).alias("_w")))
    each = z.join(w, F.lit(True)).select(utt, "z1", "z2", "z3", F.explode("_w").alias("_w")).select(utt, "z1", "z2", "z3", "_w.*")
    usable = F.lit(True)
    total = F.lit(0.5)
    for i in (1, 2, 3):
        usable = usable & ((F.col(f"w{i}") == 0) | F.col(f"z{i}").isNotNull())
        total = total + F.col(f"w{i}") * F.coalesce(F.col(f"z{i}"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return each.where(usable).withColumn("_s", score).where("_s > 0").groupBy(utt, "cand").agg(F.avg("_s").alias("score"))


def keep_better(winner: DataFrame, refined: DataFrame) -> DataFrame:
    """The refined winner if its accuracy is strictly higher, or equal with a smaller deviation; else the winner."""
    both = winner.withColumn("_f", F.lit(0)).unionByName(refined.withColumn("_f", F.lit(1)))
    return both.orderBy(F.desc(F.round("mean_acc", 12)), F.round("std_acc", 12), "_f").limit(1).drop("_f")


def _correct(score: Column, thr: Column) -> Column:
    """Male at or below, female at or above the threshold: the boundary counts for both."""
    return (((F.col("sex") == "M") & (score <= thr)) | ((F.col("sex") == "F") & (score >= thr))).cast("double")


def fold_of(unit: Column, k: int, seed: str) -> Column:
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), unit.cast("string"))), 1, 8), 16, 10).cast("long")
    return (h % k).cast("int")


def kfold_accuracy(scores: DataFrame, unit: str, k: int, seed: str) -> DataFrame:
    """Mean and population deviation of fold accuracy per candidate.

    scores: (unit, sex, cand, score).  The threshold of a fold is the median of
    the rows outside it; every row trains the k-1 other folds.
    """
    f = scores.withColumn("fold", fold_of(F.col(unit), k, seed))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col("fold"))
    train = f.select("cand", "score", F.explode(others).alias("fold"))
    thr = medians(train, ["cand", "fold"], {"thr": F.col("score")})
    per = f.join(thr, ["cand", "fold"]).groupBy("cand", "fold").agg(F.avg(_correct(F.col("score"), F.col("thr"))).alias("acc"))
    return per.groupBy("cand").agg(F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc"))


def speaker_scores(scores: DataFrame, speaker: str) -> DataFrame:
    """Median utterance score per speaker and candidate."""
    return medians(scores, [speaker, "sex", "cand"], {"score": F.col("score")})


def full_fit_accuracy(scores: DataFrame) -> DataFrame:
    """Accuracy per candidate at the median of all rows."""
    thr = medians(scores, ["cand"], {"thr": F.col("score")})
    return scores.join(thr, "cand").groupBy("cand").agg(F.avg(_correct(F.col("score"), F.col("thr"))).alias("acc"))


def best_candidate(folds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Highest mean accuracy less a millionth of its deviation; first candidate on ties."""
    merit = F.round(F.col("mean_acc") - 1e-6 * F.col("std_acc"), 12)
    return folds.withColumn("merit", merit).join(candidates, "cand").orderBy(F.desc("merit"), "std_acc", "cand").limit(1)


def threshold_sweep(scores: DataFrame, keys: Sequence[str], positive: Column, value: Column, steps: int = 1001) -> DataFrame:
    """Accuracy of ``score >= t`` for ``steps`` even thresholds on [0, 1].

    Each score is reduced to the index of the last threshold at or below it;
    running counts over at most ``steps + 1`` indices per group give every accuracy.
    """
    unit = 1.0 / (steps - 1)
    near = F.floor(value * (steps - 1)).cast("int")
    at = F.when((near + 1) * unit <= value, near + 1).when(near * unit > value, near - 1).otherwise(near)
    at = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), at))
    hist = scores.where(value.isNotNull()).groupBy(*keys, at.alias("_at")).agg(
        F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q")
    )
    total = hist.groupBy(*keys).agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    grid = total.select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("_at"), "_tp", "_tq")
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    g = grid.join(hist, [*keys, "_at"], "left").select(
        *keys, "_at", "_tp", "_tq", F.coalesce(F.sum("_p").over(w), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_q").over(w), F.lit(0)).alias("_bq")
    )
    # Positives below the threshold are misses, negatives below it are hits.
    acc = (F.col("_tp") - F.col("_bp") + F.col("_bq")) / (F.col("_tp") + F.col("_tq"))
    return g.where(F.col("_at") >= 0).select(*keys, F.col("_at").alias("step"), (F.col("_at") * unit).alias("threshold"), acc.alias("acc"))


def best_threshold(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First threshold with the highest accuracy."""
    best = F.max_by(F.struct("threshold", "acc"), F.struct(F.col("acc"), -F.col("step")))
    return sweep.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def holdout_report(utterances: DataFrame, keys: Sequence[str], min_delta: float = 0.18, min_acc: float = 0.85) -> DataFrame:
    """Speaker medians, sex medians, their gap, the best threshold accuracy and the gate.

    utterances: (keys, speaker_id, sex, score).
    """
    spk = medians(utterances.where(F.col("score").isNotNull()), [*keys, "speaker_id", "sex"], {"score": F.col("score")})
    sex = medians(spk, [*keys, "sex"], {"mid": F.col("score")}, counts=True)
    side = lambda s, c: F.max(F.when(F.col("sex") == s, F.col(c)))
    gap = sex.groupBy(*keys).agg(
        side("M", "mid").alias("median_m"), side("F", "mid").alias("median_f"),
        side("M", "mid_n").alias("speakers_m"), side("F", "mid_n").alias("speakers_f"),
    )
    best = best_threshold(threshold_sweep(spk, keys, F.col("sex") == "F", F.col("score")), keys)
    out = gap.join(best, list(keys)) if keys else gap.join(best, F.lit(True))
    delta = F.col("median_f") - F.col("median_m")
    return out.withColumn("delta", delta).withColumn("passed", (delta >= min_delta) & (F.col("acc") >= min_acc))
