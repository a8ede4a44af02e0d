"""Phone-observation analytics: outliers, z-scores, scores, per-recording and per-vowel roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.operators.ordered import scan
from voxrill.operators.quantiles import bound, by_size, lists, medians, picked, shared
from voxrill.session import cut_lineage

FORMANTS = ["f0", "f1", "f2", "f3"]
#: A bound on the rows of a phone's recording: the roll-ups below gather groups inside short recordings.
ROWS = "recording_rows"
#: Rows, on average, of a task whose rows were multiplied and are gathered there. The column ROWS says by this mark that
#: tasks are laid out so; the lists of such a task fit in memory, and need no sort of all its rows.
SPREAD_ROWS, LAID_OUT = 1 << 20, "laid_out"
_HASHED_LISTS = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(SPREAD_ROWS)}


def _size(rows: DataFrame, keys: Sequence[str], rec: str) -> str | None:
    """The column that bounds groups by ``keys``, where they lie inside recordings of known length."""
    return ROWS if ROWS in rows.columns and rec in keys else None


def flag_outliers(
    phones: DataFrame, rec: str = "recording_id", limit: float = 2.0, spread: Callable[[DataFrame], DataFrame] | None = None,
    together: bool = False,
) -> DataFrame:
    """NULL each formant further than ``limit`` deviations from its recording mean and flag the phone.

    Means and deviations come from a map-side-combined aggregate joined back,
    so a long recording is never sorted or buffered in one task.  They are written
    once: one row per recording, with its length, which bounds the column ROWS.
    A recording with fewer than two values or no spread flags nothing.

    ``spread`` makes rows of several recordings out of each phone and names the
    phone's own recording ``source_id``. A phone then travels once, to the moments
    of all recordings made of its own, and is multiplied where it arrives; the
    column ``source`` says how the rows are laid out: where all recordings are
    short, in tasks of about SPREAD_ROWS rows.

    ``together`` lays the flagged phones out by recording where all recordings are
    short: labels and formants travel, and what is worked out from them is where
    roll-ups by recording need it. Longer recordings stay spread as they are.
    """
    each = spread(phones) if spread else phones
    aggs = [F.avg(f).alias(f"_m_{f}") for f in FORMANTS] + [F.stddev_samp(f).alias(f"_s_{f}") for f in FORMANTS]
    moments = cut_lineage(each.groupBy(*(["source_id"] if spread else []), rec).agg(*aggs, F.count(F.lit(1)).alias("_n")))
    most = bound(moments, "_n")
    if spread:
        # As structs, so that phones without a recording meet their moments too.
        made = F.struct(rec, F.struct(*[c for c in moments.columns if c.startswith("_")]).alias("m"))
        held = moments.groupBy(F.struct(F.col("source_id").alias("id")).alias("source")).agg(F.map_from_entries(F.collect_list(made)).alias("_made"))
        own = phones.withColumn("source", F.struct(F.col(rec).alias("id")))
        if most is not None:
            rows = moments.agg(F.sum("_n")).first()[0] or 0
            own = own.repartition(max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SPREAD_ROWS)), "source")
        each = spread(own.join(held, "source"))
        placed = each.withColumn("_own", F.element_at("_made", F.col(rec))).select(*[c for c in each.columns if c != "_made"], "_own.*")
        each = each.drop("_made")
    else:
        placed = phones.join(moments, rec)
    far = {
        f: F.coalesce(F.abs(F.col(f) - F.col(f"_m_{f}")) / F.nullif(F.col(f"_s_{f}"), F.lit(0.0)) > limit, F.lit(False))
        for f in FORMANTS
    }
    any_far = far["f0"] | far["f1"] | far["f2"] | far["f3"]
    keep = [c for c in each.columns if c not in (*FORMANTS, ROWS)]
    sizes = [F.col("_n").alias(ROWS)] if most is None else []
    flagged = placed.select(*keep, *[F.when(~far[f], F.col(f)).alias(f) for f in FORMANTS], any_far.alias("outlier"), *sizes)
    if most is None:
        return flagged
    bounded = F.lit(most).alias(ROWS, metadata={LAID_OUT: True}) if spread else F.lit(most).alias(ROWS)
    return (flagged.repartition(rec) if together else flagged).select("*", bounded)


def reference_wide(stats: DataFrame) -> DataFrame:
    """Long statistics (lang, phoneme, formant, mean, stdev) to one row per label."""
    aggs = []
    for i in range(4):
        here = F.col("formant") == i
        aggs += [F.max(F.when(here, F.col("mean"))).alias(f"mean{i}"), F.max(F.when(here, F.col("stdev"))).alias(f"stdev{i}")]
    return stats.groupBy("lang", "phoneme").agg(*aggs)


def attach_reference(phones: DataFrame, wide: DataFrame) -> DataFrame:
    """z-scores against the *expected* label, only where both labels have statistics.

    The reference has one row per (language, label): its size is bounded by the
    phone inventories, so it is broadcast.  Each row also lists the
    labels known in its language, so one join answers both conditions.  Phones
    without statistics stay, with NULL z.
    """
    ref = wide.select(
        F.col("lang").alias("_l"), F.col("phoneme").alias("_p"),
        F.collect_set("phoneme").over(Window.partitionBy("lang")).alias("_known"),
        *[c for c in wide.columns if c not in ("lang", "phoneme")],
    )
    key = lambda c: S.phone_key(F.col("lang"), F.col(c))
    out = phones.join(F.broadcast(ref), (F.col("lang") == F.col("_l")) & (key("expected") == F.col("_p")), "left")
    both = F.array_contains("_known", key("phoneme"))
    zs = [F.when(both, S.zscore(F.col(f), F.col(f"mean{i}"), F.col(f"stdev{i}"))).alias(f"z_{f}") for i, f in enumerate(FORMANTS)]
    return out.select(*phones.columns, *zs)


def weight_columns(lang: Column) -> list[Column]:
    """The three score weights of a language as columns."""
    return [S.pick({k: v[i] for k, v in D.WEIGHTS.items()}, lang, D.WEIGHTS["zh"][i]) for i in range(3)]


def score_phones(
    phones: DataFrame, stats: DataFrame, weights: Sequence[Column] | None = None, spread: Callable[[DataFrame], DataFrame] | None = None,
    together: bool = False,
) -> DataFrame:
    """Outlier removal, z-scores and the clamped linear score per phone; ``spread`` and ``together`` as in ``flag_outliers``."""
    ws = list(weights) if weights is not None else weight_columns(F.col("lang"))
    z = attach_reference(flag_outliers(phones, spread=spread, together=together), reference_wide(stats))
    return z.withColumn("resonance", S.resonance([F.col("z_f1"), F.col("z_f2"), F.col("z_f3")], ws))


def recording_summary(scored: DataFrame, keys: Sequence[str], rec: str = "recording_id") -> DataFrame:
    """Mean, median and sample deviation of pitch and score per recording.

    Phones flagged in any formant and exact zeros are left out of both samples.
    """
    ok = ~F.col("outlier")
    pitch = F.when(ok & (F.col("f0") != 0), F.col("f0"))
    score = F.when(ok & (F.col("resonance") != 0), F.col("resonance"))
    aggs = [
        F.count(F.lit(1)).alias("n_phones"),
        F.count("_p").alias("n_pitch"), F.count("_r").alias("n_score"),
        F.avg("_p").alias("mean_pitch"), F.stddev_samp("_p").alias("stdev_pitch"),
        F.avg("_r").alias("mean_resonance"), F.stddev_samp("_r").alias("stdev_resonance"),
    ]
    mids = {"median_pitch": F.col("_p"), "median_resonance": F.col("_r")}

    def spread(rows: DataFrame) -> DataFrame:
        base = shared(rows.select(*keys, pitch.alias("_p"), score.alias("_r")), [*keys, "_p", "_r"])
        return base.groupBy(*keys).agg(*aggs).join(medians(base, keys, mids), list(keys), "left")

    if size := _size(scored, keys, rec):
        small, large = by_size(scored, size)
        held = small.select(*keys, pitch.alias("_p"), score.alias("_r")).groupBy(*keys).agg(*aggs, *lists(mids))
        plain = [c for c in held.columns if not c.startswith("_l_")]
        out = held.select(*plain, *picked(mids, {"": 0.5})).unionByName(spread(large))
    else:
        out = spread(scored)
    reason = (
        F.when(F.col("n_pitch") < 2, "too few pitched phones").when(F.col("n_score") < 2, "too few scored phones")
    )
    return out.withColumn("reason", reason)


def hold_summary(summary: DataFrame, scored: DataFrame) -> DataFrame:
    """``summary`` of ``scored``, one row per recording, written with lists in hash tables where the tasks of ``scored`` are laid out for that."""
    if ROWS in scored.columns and scored.schema[ROWS].metadata.get(LAID_OUT):
        return cut_lineage(summary, conf=_HASHED_LISTS)
    return summary


def per_vowel(scored: DataFrame, keys: Sequence[str], min_tokens: int = D.PANEL_MIN_TOKENS, rec: str = "recording_id") -> DataFrame:
    """Medians of score, z and formants per phone label, scored phones only (zeros included)."""
    size = _size(scored, keys, rec)
    rows = scored.where(F.col("resonance").isNotNull()).select(
        *keys,
        *([] if "lang" in keys else ["lang"]),
        S.vowel_label(F.col("lang"), F.col("phoneme")).alias("vowel"),
        "resonance", "z_f1", "z_f2", "z_f3", "f1", "f2", "f3", *([size] if size else []),
    )
    group = [*keys, *([] if "lang" in keys else ["lang"]), "vowel"]
    metrics = {m: F.col(m) for m in ("resonance", "z_f1", "z_f2", "z_f3", "f1", "f2", "f3")}
    med = medians(rows, group, metrics, counts=True, size=size, inside=rec if size else None).where(F.col("resonance_n") >= min_tokens)
    return med.select(
        *keys, "vowel", S.is_vowel_label(F.col("lang"), F.col("vowel")).alias("is_vowel"),
        F.col("resonance_n").alias("n"),
        F.round("resonance", 3).alias("resonance_med"),
        *[F.round(f"z_f{i}", 3).alias(f"z_f{i}_med") for i in (1, 2, 3)],
        *[F.round(f"f{i}", 0).alias(f"f{i}_med_hz") for i in (1, 2, 3)],
    )


def median_of_medians(vowels: DataFrame, keys: Sequence[str], min_tokens: int, value: str = "resonance_med") -> DataFrame:
    """Median over vowels with enough tokens: every vowel weighs the same."""
    ok = F.when(F.col("n") >= min_tokens, F.col(value))
    return medians(vowels, keys, {"median_of_vowels": ok}, counts=True).withColumnRenamed("median_of_vowels_n", "n_vowels")


# --- formant ceilings ---------------------------------------------------------


def ceiling_scores(rows: DataFrame, keys: Sequence[str], size: str | None = None) -> DataFrame:
    """Weighted within-class variation per ceiling; lower is better.

    ``rows`` is long: (keys, lang, phone, ceiling_hz, f1, f2, f3).  Classes are
    the raw labels of vowels; a class needs two tokens, a score three classes,
    and a variation that cannot be computed counts as zero.  ``size`` names a
    bound on the rows that share the keys at one ceiling, where there is one.
    """
    vowels = rows.where(S.is_vowel_by_letter(F.col("lang"), F.col("phone")))
    group = [*keys, "lang", "phone", "ceiling_hz"]
    positive = {f: F.when(F.col(f) > 0, F.col(f)) for f in ("f1", "f2", "f3")}
    aggs = [F.count(F.lit(1)).alias("tokens"), *[F.stddev_samp(c).alias(f"_s_{f}") for f, c in positive.items()]]
    enough = F.col("tokens") >= D.MIN_TOKENS_PER_CLASS

    def spread(part: DataFrame) -> DataFrame:
        return part.groupBy(*group).agg(*aggs).where(enough).join(medians(part, group, positive), group, "left")

    if size:
        small, large = by_size(vowels, size)
        held = small.groupBy(*group).agg(*aggs, *lists(positive)).where(enough)
        plain = [c for c in held.columns if not c.startswith("_l_")]
        classes = held.select(*plain, *picked(positive, {"": 0.5})).unionByName(spread(large))
    else:
        classes = spread(vowels)
    cv = [F.coalesce(F.col(f"_s_{f}") / F.col(f), F.lit(0.0)) for f in ("f1", "f2", "f3")]
    per_class = classes.select(*group, (cv[0] + D.F2_WEIGHT * cv[1] + D.F3_WEIGHT * cv[2]).alias("_cv"))
    return (
        per_class.groupBy(*keys, "lang", "ceiling_hz")
        .agg(F.count(F.lit(1)).alias("classes"), F.avg("_cv").alias("_avg"))
        .select(
            *keys, "lang", "ceiling_hz", "classes",
            F.when(F.col("classes") >= D.MIN_VOWEL_CLASSES, F.col("_avg")).alias("score"),
        )
    )


def pick_ceiling(scores: DataFrame, recordings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest score within 5 %, then nearest the middle candidate; defaults where none is scored.

    A recording has at most five candidates, so the choice is one struct minimum.
    """
    k = F.array_position(F.array(*[F.lit(c) for c in D.CEILINGS]), F.col("ceiling_hz")) - 1
    mid = len(D.CEILINGS) // 2
    ranked = (
        scores.where(F.col("score").isNotNull() & F.col("lang").isin(D.ADAPTIVE_LANGS))
        .groupBy(*keys)
        .agg(
            F.collect_list(F.struct(F.abs(k - mid).alias("d"), k.alias("k"), "ceiling_hz", "score")).alias("_c"),
            F.min("score").alias("best_score"),
        )
    )
    near = F.array_min(F.filter("_c", lambda c: c["score"] <= F.col("best_score") * D.TIE_TOLERANCE))
    chosen = ranked.select(*keys, "best_score", near["ceiling_hz"].alias("_hz"))
    fallback = F.when(F.col("lang").isin(D.ADAPTIVE_LANGS), D.DEFAULT_CEILING).otherwise(D.LEGACY_CEILING)
    return recordings.join(chosen, list(keys), "left").withColumn("ceiling_hz", F.coalesce("_hz", fallback)).drop("_hz")


def modal_value(rows: DataFrame, keys: Sequence[str], value: str, first: str) -> DataFrame:
    """Most frequent value per key; a tie goes to the value seen first by ``first``."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(first).alias("_first"))
    best = F.max_by(F.struct(value, "votes"), F.struct(F.col("votes"), -F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{value}", "_b.votes")


def substitute_formants(phones: DataFrame, chosen: DataFrame, keys: Sequence[str], start: str = "start") -> DataFrame:
    """Replace f1..f3 by the chosen-ceiling row with the same (rounded start, label).

    The last duplicate wins; unmatched phones keep their formants and a matched
    missing value stays NULL.
    """
    key = F.round(F.col(start), 4)
    last = (
        chosen.withColumn("_at", key)
        .groupBy(*keys, "phone", "_at")
        .agg(F.max_by(F.struct("f1", "f2", "f3"), F.col("seq")).alias("_new"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("phone").alias("_ph"), F.col("_at").alias("_t"), "_new")
    )
    on = (F.col("phone") == F.col("_ph")) & key.eqNullSafe(F.col("_t"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = phones.join(last, on, "left")
    return out.select(
        *[c for c in phones.columns if c not in ("f1", "f2", "f3")],
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in ("f1", "f2", "f3")],
    )


# --- words ----------------------------------------------------------------------


def known_times(phones: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, time: str) -> DataFrame:
    """Give a phone of unknown time the latest known time of the phones before it in the sequence.

    ``attach_words`` then leaves it with the word of the phone before; without any known time before it, it
    stays unknown.
    """
    out = scan(phones, keys, order, block, maxes={"__t": F.col(time)})
    return out.withColumn(time, F.col("__t")).drop("__t")


def attach_words(items: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Each phone gets the last word that starts at or before it, its index and its place in the word.

    ``items`` holds words and phones in one timeline: (keys, order..., is_word,
    word, word_time).  Words must sort before phones at equal time.  Phones
    before the first word are dropped; give unknown times a value first (``known_times``).
    """
    w = F.col("is_word")
    counted = scan(items, keys, order, block, sums={"words_so_far": w.cast("long"), "phones_so_far": (~w).cast("long")})
    held = scan(
        counted, keys, order, block,
        fills={"_w": F.when(w, F.struct("word", "word_time", F.col("phones_so_far").alias("before")))},
    )
    return held.where(~w & F.col("_w").isNotNull()).select(
        *[c for c in items.columns if c not in ("is_word", "word", "word_time")],
        F.col("_w.word").alias("word"),
        F.col("_w.word_time").alias("word_time"),
        (F.col("words_so_far") - 1).alias("word_index"),
        (F.col("phones_so_far") - F.col("_w.before") - 1).alias("nth"),
    )


def attach_expected(phones: DataFrame, dictionary: DataFrame, word_key: Column) -> DataFrame:
    """Dictionary target of the n-th phone of its word; unknown words and overruns give NULL."""
    d = dictionary.select(F.col("word").alias("_dw"), F.col("phones").alias("_dp"))
    return (
        phones.withColumn("_wk", word_key)
        .join(d, F.col("_wk") == F.col("_dw"), "left")
        .withColumn("expected", F.get("_dp", F.col("nth").cast("int")))
        .drop("_wk", "_dw", "_dp")
    )
