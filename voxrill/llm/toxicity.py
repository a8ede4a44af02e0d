"""Toxicity by a weighted grammar of clauses.

Four small transducers read the words of a text: a polarity one (negation opens a scope of a few words),
a frame one (a verb of reporting or a quotation mark makes a clause reported speech), a target one (a
person is addressed) and a hostility one (an insult, or a threat, which counts once a target is there).
Their composition is one table of states, and a clause, not a word, is what it accepts: the weight of a
matched clause is the sum of its insults, less under negation or in reported speech, more against a
target. A document's evidence is the sum over its clauses; a logistic curve turns evidence, its density
and the number of matched clauses into a score.

Which words insult is known from a short list and learned from labelled rows: word stems that mark toxic
rows and hardly any others, over distinct texts. Learning reads at most ``max_rows`` labelled rows, those
with the smallest hash of their id; scoring covers every row.

A null or empty text has no clause and the score that goes with no evidence. Labels that are null, and
labels without a document, are not used; without any label a fixed curve and the short list serve. Rows
that repeat have equal scores, very long texts are read word by word, an empty table gives an empty result,
and other columns pass through or are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

# The short list.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "crush", "stab", "shoot")
TARGETS = ("you", "your", "you're", "yourself", "u", "he", "she", "they", "them", "du", "ihr", "tu", "vous", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "called", "calls", "quoted", "according", "reported", "sagte", "dit", "dijo")

#: Words that a negation reaches.
SCOPE = 3
#: Weight of an insult under negation; factors of a clause in reported speech and against a target.
NEGATED, REPORTED, TARGETED = 0.2, 0.5, 1.3
#: Weight of a listed insult that the labels say nothing about, and of a threat.
DEFAULT_WEIGHT = 3.0
#: Lengths of stems; a whole word is a stem of its own.
STEMS = (3, 4, 5, 6, 7, 8)
MAX_ROWS = 40_000
#: Words whose symbol a task remembers before it forgets them all.
CACHE = 60_000

NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
_EDGE = "\"'“”„«»()[]{}<>.,;:!?…-–—*_~`|#&%$"
_CLOSES = re.compile(r"[.!?;:…]+[\"'”«»)\]]*$")
_LETTERS = re.compile(r"[^\W\d_]+")


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The composed transducer: next state and whether hostility is negated, by state and symbol.

    A state is (words left in a negation's scope, reported, target seen, threat seen) in mixed radix.
    """
    n = (SCOPE + 1) * 8
    after, negated = np.zeros((n, END + 1), np.int64), np.zeros((n, END + 1), bool)
    for state in range(n):
        scope, flags = divmod(state, 8)
        reported, target, threat = flags >> 2, flags >> 1 & 1, flags & 1
        for symbol in range(END + 1):
            s, r, t, h = max(0, scope - 1), reported, target, threat
            if symbol == NEGATION:
                s = SCOPE
            elif symbol == REPORT:
                r = 1
            elif symbol == TARGET:
                t = 1
            elif symbol == THREAT:
                h = 1 if not scope else h
            elif symbol == END:
                s = r = t = h = 0
            after[state, symbol] = s * 8 + (r << 2 | t << 1 | h)
            negated[state, symbol] = scope > 0
    return after, negated


@dataclass
class Grammar:
    """Stems with weights, the curve, and the composed transducer; plain values, so that it travels."""

    stems: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [-3.0, 2.0, 0.5, 0.5])

    def __post_init__(self):
        after, negated = compose()
        self.after, self.negated = after.tolist(), negated.tolist()
        self.lengths = sorted({len(s) for s in self.stems if not s.startswith("=")})
        self.words = {w: c for ws, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in ws}
        self.cache: dict[str, tuple[int, float, bool]] = {}

    def symbol(self, raw: str) -> tuple[int, float, bool]:
        """(symbol, weight, whether the word closes its clause) of a word as it stands."""
        core = raw.strip(_EDGE)
        closes = core is not raw and _CLOSES.search(raw) is not None
        quoted = raw[:1] in "\"“„«"
        weight = self.weight(core)
        if weight:
            found = (INSULT, weight, closes)
        elif core in self.words:
            found = (self.words[core], 0.0, closes)
        else:
            found = (REPORT if quoted else NOTHING, 0.0, closes)
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[raw] = found
        return found

    def weight(self, word: str) -> float:
        """The weight of the longest stem of a word, 0 if it has none. Compounds are read part by part."""
        best = 0.0
        for part in _LETTERS.findall(word):
            found = self.stems.get("=" + part)
            if found is None:
                for n in reversed(self.lengths):
                    if len(part) >= n and (found := self.stems.get(part[:n])) is not None:
                        break
            best = max(best, found or 0.0)
        return best

    def evidence(self, text: str) -> tuple[float, float, float]:
        """(sum of clause weights, number of matched clauses, number of words), by running the transducer."""
        after, negated, cache, symbol_of = self.after, self.negated, self.cache, self.symbol
        total, matched, state, clause = 0.0, 0, 0, 0.0
        words = text.lower().replace("\n", " ; ").split()
        for raw in words:
            found = cache.get(raw)
            if found is None:
                found = symbol_of(raw)
            symbol, weight, closes = found
            if symbol == NOTHING and not closes:
                if state >= 8:
                    state -= 8
                continue
            if symbol == INSULT:
                clause += weight * (NEGATED if negated[state][symbol] else 1.0)
            state = after[state][symbol]
            if closes:
                if state & 3 == 3:
                    clause += DEFAULT_WEIGHT
                if clause:
                    total += self.clause_weight(clause, state)
                    matched += 1
                state, clause = 0, 0.0
        if state & 3 == 3:
            clause += DEFAULT_WEIGHT
        if clause:
            total += self.clause_weight(clause, state)
            matched += 1
        return total, float(matched), float(len(words))

    @staticmethod
    def clause_weight(hostile: float, state: int) -> float:
        return hostile * (REPORTED if state & 4 else 1.0) * (TARGETED if state & 2 else 1.0)

    def features(self, text: str) -> tuple[float, float, float]:
        total, matched, words = self.evidence(text)
        return math.log1p(total), math.log1p(100.0 * total / max(words, 20.0)), math.log1p(matched)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _stems_of(text: str) -> set[str]:
    out = set()
    for word in set(_LETTERS.findall(text.lower())):
        out.add("=" + word)
        out.update(word[:n] for n in STEMS if len(word) > n)
    return out


def _counted(rows: DataFrame, wanted: Column, stems) -> Counter:
    """In how many of the wanted rows each stem occurs; ``stems``: a broadcast set to count, or None for all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                every = _stems_of(raw.as_py().decode("utf-8", "replace"))
                found.update(every if stems is None else every & stems.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["stem", "n"])

    return rows.where(wanted).select("_body").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, use: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(_y, _body): at most ``max_rows`` labelled texts to learn from, each distinct text once, the same ones on every run.

    An id with several labels, and a text under several ids, has the label that most of them give, 0 where
    they are even. The bound holds for ids and, after the join, for texts, however many texts share an id.
    """
    most = (F.avg("_y") > 0.5).cast("int").alias("_y")
    given = labels.where(labels[target].isNotNull() & labels[id_col].isNotNull() & use).select(labels[id_col].alias("_id"), labels[target].cast("int").alias("_y"))
    some = common.sample_by_hash(given.groupBy("_id").agg(most), max_rows, "_id")
    rows = docs.select(docs[id_col].alias("_id"), common.body(docs, text_col).alias("_body"))
    joined = rows.join(F.broadcast(some), "_id").withColumn("_digest", F.xxhash64("_body"))  # some: max_rows ids at most
    # Digests alone are ordered and cut; the texts that stay are fetched afterwards.
    kept = common.sample_by_hash(joined.groupBy("_digest").agg(most), max_rows, "_digest")
    return joined.select("_digest", "_body").join(F.broadcast(kept), "_digest").select("_y", "_body").distinct()


def learn_stems(rows: DataFrame, min_share: float = 0.02, least: int = 5, purity: float = 0.75) -> dict[str, float]:
    """Stems of toxic rows: in at least ``min_share`` of them, and of all rows with the stem ``purity`` toxic.

    Of stems that begin alike the one stays that finds most toxic rows for few others, the longest of equals. A share of the rows
    bounds how many stems can qualify, whatever the corpus.
    """
    toxic, clean = (rows.where(f"_y = {y}").count() for y in (1, 0))
    need = max(least, math.ceil(min_share * toxic))
    spark = rows.sparkSession
    often = {r["stem"]: r["n"] for r in _counted(rows, F.col("_y") == 1, None).where(F.col("n") >= need).collect()}
    if not often:
        return {}
    sent = spark.sparkContext.broadcast(set(often))
    other = {r["stem"]: r["n"] for r in _counted(rows, F.col("_y") == 0, sent).collect()}
    kept: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of kept stems
    for stem in sorted(often, key=lambda s: (3 * other.get(s, 0) - often[s], -len(s), s)):
        n, m = often[stem], other.get(stem, 0)
        word = stem.lstrip("=")
        if n < purity * (n + m) or word in begun or any(word[:k] in kept or "=" + word[:k] in kept for k in range(min(STEMS), len(word) + 1)):
            continue
        kept[stem] = min(6.0, math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1)))
        begun.update(word[:k] for k in range(1, len(word) + 1))
    return kept


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(
    docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic"
) -> Grammar:
    """Learn stems and curve from the labelled rows for which ``use`` (a condition on the labels) holds."""
    rows = cut_lineage(labelled(docs, labels, target, use, max_rows, id_col, text_col))
    stems = {"=" + w: DEFAULT_WEIGHT for w in INSULTS} | learn_stems(rows)
    grammar = Grammar(stems)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grammar.features(raw.as_py().decode("utf-8", "replace")) for raw in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], names=["y", "a", "b", "c"])

    # At most max_rows rows of four numbers.
    seen = rows.select("_y", "_body").mapInArrow(common.by_batch(measure), "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    if seen["y"].nunique() == 2:
        grammar.curve = _fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy(float))
    return grammar


@lru_cache(maxsize=2)
def _grammar(stems: tuple, curve: tuple) -> Grammar:
    return Grammar(dict(stems), list(curve))


def scores(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """(_given, _score): every row with its score."""
    key = (tuple(grammar.stems.items()), tuple(grammar.curve))
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_given"), common.body(docs, text_col).alias("_body"))

    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = _grammar(*key)
        for t in texts:
            yield pa.array([g.score(raw.as_py().decode("utf-8", "replace")) for raw in t], pa.float64())

    return wrapped.select("_given", F.arrow_udf(apply, "double")("_body").alias("_score"))


def reject_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    return scores(docs, grammar, text_col).where(F.col("_score") < threshold).select(*common.given(docs.columns))


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo the number of parts."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def train_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Grammar:
    labels = common.table(spark, sf_dir, "labels")
    return train(docs, labels, fold(labels["doc_id"], 3) != 1)


@query("op2_toxicity")
def op2_toxicity(spark, d):
    """A toxicity score for every document, learned outside the held-out third."""
    docs = common.table(spark, d, "documents")
    scored = scores(docs, train_for(spark, docs, d))
    doc_id = F.col("_given.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), F.coalesce(fold(doc_id, 3) == 1, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.7).cast("int").alias("predicted"),
    )
