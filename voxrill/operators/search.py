"""Weight search by counting: cross-validated accuracy of any number of candidates without a row per score.

The phones of a unit (an utterance, or all utterances of a speaker) are gathered once into one row; that is
the only shuffle of data, whatever the candidates. Every pass reads those rows, scores all candidates of the
grid in vectorised steps and keeps counts: how many units of a fold fall into each bucket of scores. Bucket
counts of a training set are the total less the fold's own. The bucket with the median is split again until
few values are in it, these are fetched, and the last pass counts right decisions at the thresholds found.
What leaves a task has the size of the grid, not of the data.

A score is the mean over an utterance's phones of ``clip(z . w + 0.5, 0, 1)``; phones that lack a z do not
count, and a unit of several utterances has the median of their scores. Rows are written once and summed in
one order, so that every pass sees the same scores to the last bit. A unit has to fit a task (32 bytes a
phone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.operators.fit import fold_of
from voxrill.session import cut_lineage

#: Candidates of one search: three numbers each travel with every task.
MAX_CANDIDATES = 200_000
#: Counters of a task, in all; buckets follow from it and the number of candidates.
MAX_COUNTERS = 1 << 24
BUCKETS = 256
#: Training units in a bucket up to which their scores are fetched.
FEW = 4096
#: Splits of a bucket; after six by 256 it holds a few dozen different numbers at most.
MAX_SPLITS = 6
#: Phones that are scored at a time, and numbers of one step.
SLICE_PHONES = 1 << 13
STEP_CELLS = 1 << 17
#: Bytes of unit rows that a Python worker gets at a time; a longer unit comes alone.
BATCH_BYTES = "8m"


def unit_rows(z: DataFrame, utt: str, owners: DataFrame, unit: str, k: int, seed: str) -> DataFrame:
    """(fold, sex, phones) of every unit, written once. Sexes: 0 M, 1 F, 2 any other, -1 unknown.

    z: (utt, z1, z2, z3); owners: (utt, unit, sex), one row for each utterance.
    """
    known = z.where("z1 IS NOT NULL AND z2 IS NOT NULL AND z3 IS NOT NULL").select(F.col(utt).alias("_u"), "z1", "z2", "z3")
    o = owners.select(F.col(utt).alias("_u"), F.col(unit).alias("_unit"), F.col("sex").alias("_sex"))
    code = F.when(F.col("_sex").isNull(), -1).when(F.col("_sex") == "M", 0).when(F.col("_sex") == "F", 1).otherwise(2)
    one = F.struct(F.xxhash64("_u").alias("u"), "z1", "z2", "z3")
    # Scoring takes long for few bytes: the partitions asked for, not as many as the bytes would fill.
    n = int(z.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = known.join(o, "_u").repartition(n, "_unit").groupBy("_unit", "_sex").agg(F.sort_array(F.collect_list(one)).alias("phones"))
    return cut_lineage(rows.select(F.coalesce(fold_of(F.col("_unit"), k, seed), F.lit(0)).alias("fold"), code.alias("sex"), "phones"))


@dataclass
class _Slice:
    """Some units: their phones side by side, where utterances and units begin, and what is known of each unit."""

    z: np.ndarray
    utterances: np.ndarray
    units: np.ndarray
    fold: np.ndarray
    sex: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        """One row of unit scores for each candidate. Candidates are rows throughout, so a score does not depend on how many are asked for."""
        s = w[:, :1] * self.z[0] + w[:, 1:2] * self.z[1] + w[:, 2:] * self.z[2] + 0.5
        np.clip(s, 0.0, 1.0, out=s)
        sizes = np.diff(np.append(self.utterances, self.z.shape[1]))
        means = np.add.reduceat(s, self.utterances, axis=1) / sizes
        if len(self.units) == len(self.utterances):
            return means
        ends = np.append(self.units[1:], len(self.utterances))
        return np.stack([np.median(means[:, a:b], axis=1) for a, b in zip(self.units, ends)], axis=1)

    def steps(self, w: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The scores of all candidates, so many at a time."""
        width = max(1, STEP_CELLS // self.z.shape[1])
        for a in range(0, len(w), width):
            at = slice(a, min(len(w), a + width))
            yield at, self.scores(w[at])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for b in batches:
        fold, sex = b.column(0).to_numpy(), b.column(1).to_numpy()
        phones = b.column(2)
        offsets = phones.offsets.to_numpy()
        i = 0
        while i < len(fold):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_PHONES, side="right")) - 1)
            low, high = int(offsets[i]), int(offsets[j])
            u, *z = (c.to_numpy() for c in phones.values.slice(low, high - low).flatten())
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
            mine = np.union1d(starts, offsets[i:j] - low)  # the same utterance twice, in two units, is two
            yield _Slice(np.stack(z), mine, np.searchsorted(mine, offsets[i:j] - low), fold[i:j], sex[i:j])
            i = j


class Search:
    """Passes over unit rows for one set of candidates.

    Buckets only narrow down where a median is. Its value is taken by rank among the scores fetched, with the
    number of smaller ones counted in the same pass, so rounding at a bucket's edge does no harm.
    """

    #: Candidates whose counters go together.
    CHUNK = 64
    #: How far, beyond its edges, a bucket is searched.
    MARGIN = 1e-12

    def __init__(self, units: DataFrame, candidates: DataFrame, k: int = 1, buckets: int = BUCKETS, few: int = FEW):
        """With one fold the threshold is the median of all units, else that of the units outside a unit's fold."""
        rows = candidates.select("cand", "w1", "w2", "w3").orderBy("cand").limit(MAX_CANDIDATES + 1).toPandas()
        if not 0 < len(rows) <= MAX_CANDIDATES:
            raise ValueError(f"a search takes 1 to {MAX_CANDIDATES} candidates; split the grid")
        units.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.units, self.k, self.few = units, k, few
        self.cand = rows["cand"].tolist()
        self.w = rows[["w1", "w2", "w3"]].to_numpy(float)
        self.buckets = int(max(8, min(buckets, MAX_COUNTERS // (len(rows) * k))))
        self.sent = units.sparkSession.sparkContext.broadcast(self.w)  # at most MAX_CANDIDATES rows

    def _counted(self, count) -> np.ndarray:
        """Counters (candidates, folds, 1 + buckets) that ``count(slice, weights, counters)`` fills, over all tasks."""
        sent, k, n, chunk = self.sent, self.k, self.buckets + 1, self.CHUNK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = sent.value
            counters = np.zeros((len(w), k, n), np.int64)
            for part in _slices(batches):
                count(part, w, counters)
            at = list(range(0, len(w), chunk))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a // chunk for a in at], pa.int32()), pa.array([counters[a:a + chunk].tobytes() for a in at], pa.binary())], names=["chunk", "counts"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(b, np.int64) for b in pdf["counts"]], axis=0)
            return pd.DataFrame({"chunk": [key[0]], "counts": [total.tobytes()]})

        # One row for each task and chunk; as much as the counters of one task reaches the driver.
        rows = self.units.mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
        if not rows:
            return np.zeros((len(self.w), k, n), np.int64)
        return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["chunk"])]).reshape(-1, k, n)

    def _narrowed(self, train: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(low, high, most scores inside) of the buckets from the lower to the upper middle value."""
        n = self.buckets
        upto = np.cumsum(train, axis=2)  # of all below the interval, then bucket by bucket
        first, last = (np.clip((upto <= rank[:, :, None]).sum(axis=2) - 1, 0, n - 1) for rank in ((size - 1) // 2, size // 2))
        inside = np.take_along_axis(upto, last[:, :, None] + 1, 2) - np.take_along_axis(upto, first[:, :, None], 2)
        width = (high - low) / n
        return low + first * width - self.MARGIN, low + (last + 1) * width + self.MARGIN, int(inside.max(initial=0))

    def _first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The units of every training set, and where in [0, 1] its median is. A training set is all units less a fold."""
        n, k = self.buckets, self.k

        def count(part: _Slice, w: np.ndarray, counters: np.ndarray) -> None:
            for at, s in part.steps(w):
                b = np.minimum((s * n).astype(np.int64), n - 1)
                cell = (np.arange(len(s))[:, None] * k + part.fold) * n + b
                counters[at, :, 1:] += np.bincount(cell.ravel(), minlength=len(s) * k * n).reshape(len(s), k, n)

        own = self._counted(count)
        train = own.sum(axis=1, keepdims=True) - own if k > 1 else own
        size = train.sum(axis=2)
        zero = np.zeros(size.shape)
        return (size, *self._narrowed(train, zero, zero + 1.0, size))

    def _split(self, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each interval once more in buckets."""
        n, k = self.buckets, self.k

        def count(part: _Slice, w: np.ndarray, counters: np.ndarray) -> None:
            for at, s in part.steps(w):
                for f in range(k):
                    t = s[:, part.fold != f] if k > 1 else s
                    a, b = low[at, f, None], high[at, f, None]
                    x = np.floor((t - a) / (b - a) * n).astype(np.int64)
                    counters[at, f, 0] += (x < 0).sum(axis=1)
                    row, col = np.nonzero((x >= 0) & (x < n))
                    counters[at, f, 1:] += np.bincount(row * n + x[row, col], minlength=len(t) * n).reshape(len(t), n)

        return self._narrowed(self._counted(count), low, high, size)

    def thresholds(self) -> np.ndarray:
        """The median training score of each candidate and fold; NaN without training units."""
        size, low, high, most = self._first()
        splits = 1
        while most > self.few and splits < MAX_SPLITS:
            low, high, most = self._split(size, low, high)
            splits += 1
        sent, k = self.sent, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = sent.value
            below = np.zeros((len(w), k), np.int64)
            cells, values = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in _slices(batches):
                for at, s in part.steps(w):
                    for f in range(k):
                        t = s[:, part.fold != f] if k > 1 else s
                        below[at, f] += (t < low[at, f, None]).sum(axis=1)
                        row, col = np.nonzero((t >= low[at, f, None]) & (t <= high[at, f, None]))
                        cells.append((row + at.start) * k + f)
                        values.append(t[row, col])
            cell, value = np.concatenate(cells), np.concatenate(values)
            order = np.argsort(cell, kind="stable")
            offsets = np.searchsorted(cell[order], np.arange(len(w) * k + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(w) * k), pa.int64()), pa.array(below.ravel()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order]))],
                names=["cell", "below", "values"])

        parts = self.units.mapInArrow(run, "cell long, below long, values array<double>")
        each = parts.groupBy("cell").agg(F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("values"))).alias("v"))
        known = self.units.sparkSession.createDataFrame(pd.DataFrame({"cell": np.arange(size.size), "n": size.ravel()}))
        lower = F.get("v", (F.floor((F.col("n") - 1) / 2) - F.col("below")).cast("int"))
        upper = F.get("v", (F.floor(F.col("n") / 2) - F.col("below")).cast("int"))
        rows = each.join(known, "cell").where("n > 0").select("cell", ((lower + upper) / 2).alias("t")).collect()  # one for each candidate and fold
        out = np.full(size.size, np.nan)
        for r in rows:
            if r["t"] is None:
                raise RuntimeError("a median lies outside the bucket that its rank led to")
            out[r["cell"]] = r["t"]
        return out.reshape(size.shape)

    def decisions(self) -> DataFrame:
        """(cand, fold, correct, total): right decisions at the threshold of each fold. Units of unknown sex make none."""
        sent, k, cand = self.sent, self.k, self.cand
        limits = self.units.sparkSession.sparkContext.broadcast(self.thresholds())  # candidates x folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, thr = sent.value, limits.value
            right, total = np.zeros((len(w), k), np.int64), np.zeros((len(w), k), np.int64)
            for part in _slices(batches):
                for at, s in part.steps(w):
                    t = thr[at][:, part.fold]
                    # The boundary counts for both sexes.
                    ok = ((part.sex == 0) & (s <= t)) | ((part.sex == 1) & (s >= t))
                    for f in range(k):
                        mine = part.fold == f
                        right[at, f] += ok[:, mine].sum(axis=1)
                        total[at, f] += (mine & (part.sex >= 0)).sum() * ~np.isnan(thr[at, f])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(cand, k), pa.int64()), pa.array(np.tile(np.arange(k), len(w)), pa.int32()), pa.array(right.ravel()), pa.array(total.ravel())],
                names=["cand", "fold", "correct", "total"])

        parts = self.units.mapInArrow(run, "cand long, fold int, correct long, total long")
        return parts.groupBy("cand", "fold").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).where("total > 0")


def cross_validated(units: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(cand, mean_acc, std_acc): mean and population deviation of the folds' accuracy, each at the median of the other folds."""
    acc = F.col("correct") / F.col("total")
    return Search(units, candidates, k).decisions().groupBy("cand").agg(F.avg(acc).alias("mean_acc"), F.stddev_pop(acc).alias("std_acc"))


def fitted(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cand, acc): accuracy at the median of all units."""
    return Search(units.withColumn("fold", F.lit(0)).select("fold", "sex", "phones"), candidates).decisions().select("cand", (F.col("correct") / F.col("total")).alias("acc"))
