"""A quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of shape features. Each feature is cut into bins at quantiles of the training
rows. Training cycles over the features: each turn fits a shallow tree to the current gradient over that
feature's bins alone and adds a small part of it to the feature's lookup table. When the single features
have settled, pairs of features are ranked by what a table over both could still explain, and the best
ones are boosted in the same cyclic way. What remains is one table for each feature and pair, so a score
is a sum of looked-up values, added up for a whole batch at once.

The model learns from at most ``max_rows`` labelled rows, those with the smallest hash of their id, one
for each distinct text; scoring covers every row. A null or empty text has zero for every feature and is
scored like any other; labels that are null or have no document are not used, and without both kinds of
label every row gets the same score. Repeated rows score alike, very long texts are read whole, an empty
table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.llm.toxicity import fold, labelled
from voxrill.session import cut_lineage

MAX_ROWS = 40_000
BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
PAIRS = 8
RIDGE = 1.0

FEATURES = (
    "words", "word_length", "longest_word", "upper", "digit", "symbol", "punctuation", "non_ascii", "distinct_words", "top_word", "repeats",
    "lines", "line_length", "distinct_lines", "sentence_ends", "marked_words", "compression",
)

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        5 if _b >= 128 else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 4 if _c in ".,;:!?'\"-()" else 0 if _c.isspace() or "a" <= _c <= "z" else 3
    )


def features(text: bytes) -> list[float]:
    """The shape of a text, FEATURES in order."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    ends = sum(w.endswith((b".", b"?", b"!")) for w in words)
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,") for w in words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    # Whole text, in pieces of bounded size.
    packed = sum(len(zlib.compress(text[i:i + 65536], 1)) for i in range(0, size, 65536))
    return [
        math.log1p(n), (size - n + 1) / n, float(max(map(len, words))), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], len(counts) / n, max(counts.values()) / n,
        same / n, math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), ends / n, marked / n, packed / size,
    ]


@dataclass
class Model:
    """Cuts and lookup tables; plain arrays, so that it travels."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The values of a shallow tree over ordered bins with gradient sums g and curvature sums h."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
        at = int(gain.argmax())
        if gain[at] > 1e-9:
            return np.concatenate([_split(g[:at + 1], h[:at + 1], depth - 1), _split(g[at + 1:], h[at + 1:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _split_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a grid: the best cut of one side, then of the other side within each half."""
    best, out = -np.inf, np.full(g.shape, _leaf(g.sum(), h.sum()))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for at in range(1, gg.shape[0]):
            parts, gain = [], 0.0
            for rows in (slice(0, at), slice(at, None)):
                gs, hs = gg[rows].sum(0), hh[rows].sum(0)
                values = _split(gs, hs, 1)
                gain += float((values * gs - 0.5 * values**2 * hs).sum())
                parts.append(np.broadcast_to(values, gg[rows].shape))
            if gain > best:
                grid = np.concatenate(parts)
                best, out = gain, (grid.T if flip else grid)
    return out


def _gradient(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return y - p, p * (1 - p)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables of single features, then those of the best pairs."""
    n, k = x.shape
    cuts = [_cuts(x[:, f], BINS) for f in range(k)]
    pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(k)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts, [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(n, model.base)
    for _ in range(ROUNDS):
        for f in range(k):
            g, h = _gradient(z, y)
            size = len(cuts[f]) + 1
            step = RATE * _split(np.bincount(at[f], g, size), np.bincount(at[f], h, size), 2)
            model.tables[f] += step
            z += step[at[f]]
    wide = [len(c) + 1 for c in pair_cuts]
    cell = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(pair_cuts)]
    g, h = _gradient(z, y)
    gains = []
    for a in range(k):
        for b in range(a):
            i = cell[a] * wide[b] + cell[b]
            gs, hs = np.bincount(i, g, wide[a] * wide[b]), np.bincount(i, h, wide[a] * wide[b])
            gains.append((float((gs**2 / (hs + RIDGE)).sum()), a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 1e-6]
    model.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    index = [cell[a] * wide[b] + cell[b] for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (a, b) in enumerate(model.pairs):
            g, h = _gradient(z, y)
            shape = (wide[a], wide[b])
            step = RATE * _split_pair(np.bincount(index[t], g, wide[a] * wide[b]).reshape(shape), np.bincount(index[t], h, wide[a] * wide[b]).reshape(shape))
            model.pair_tables[t] += step
            z += step.ravel()[index[t]]
    return model


def _features_of(column) -> np.ndarray:
    return np.array([features(raw.as_py()) for raw in column], float).reshape(-1, len(FEATURES))


def train(
    docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", target: str = "quality"
) -> Model:
    """Learn from the labelled rows for which ``use`` (a condition on the labels) holds."""
    rows = labelled(docs, labels, target, use, max_rows, id_col, text_col)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _features_of(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    # At most max_rows rows of numbers reach the driver; sorted, so that the fit does not depend on their arrival.
    seen = cut_lineage(rows.mapInArrow(common.by_batch(measure), "y int, x array<double>")).toPandas()
    if not len(seen):
        return fit(np.zeros((1, len(FEATURES))), np.array([0.5]))
    x, y = np.stack(seen["x"].to_list()), seen["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_features_of(batch.column(1))))], names=[id_col, "score"])

    return docs.select(docs[id_col], common.body(docs, text_col).alias("_body")).mapInArrow(common.by_batch(apply), f"`{id_col}` {id_type}, score double")


@query("op4_quality")
def op4_quality(spark, d):
    """A quality score for every document, learned outside the held-out fifth."""
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    scored = scores(docs, train(docs, labels, fold(labels["doc_id"], 5) != 0))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
