"""Column expressions: parsing, label rules, banding and small formulas.

All of them are plain built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxrill.functions import dims as D


def pick(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table, or ``default`` for an unknown key."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def bands(v: Column, uppers: Sequence[tuple[str, float]], top: str) -> Column:
    """First band whose upper bound exceeds ``v``; NULL and NaN give NULL."""
    out = F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string"))
    for name, upper in uppers:
        out = out.when(v < upper, F.lit(name))
    return out.otherwise(F.lit(top))


# --- parsing and labels -----------------------------------------------------


def positive_number(s: Column) -> Column:
    """Number text to DOUBLE; undefined, non-numeric, NaN and values <= 0 give NULL."""
    v = s.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def formant_number(s: Column) -> Column:
    """Formant cell of the aligner text: any cell with ``--`` is undefined."""
    return F.when(~s.contains("--"), s.try_cast("double"))


def strip_tone(p: Column) -> Column:
    return F.regexp_replace(p, D.TONE_MARKS, "")


def strip_stress(p: Column) -> Column:
    return F.regexp_replace(p, D.STRESS_DIGIT, "")


def phone_key(lang: Column, phone: Column) -> Column:
    """Label used to look up reference statistics: zh loses tone marks."""
    return F.when(lang == "zh", strip_tone(phone)).otherwise(phone)


def vowel_label(lang: Column, phone: Column) -> Column:
    """Label used to group phones: zh loses tone marks, en loses the stress digit."""
    return F.when(lang == "zh", strip_tone(phone)).when(lang == "en", strip_stress(phone)).otherwise(phone)


def is_vowel_label(lang: Column, label: Column) -> Column:
    """Vowel test of an already normalised label, one hash lookup over all inventories."""
    known = [f"{code}:{v}" for code, labels in D.VOWELS.items() for v in labels]
    return F.coalesce(F.concat_ws(":", lang, label).isin(known), F.lit(False))


def is_vowel_by_set(lang: Column, phone: Column) -> Column:
    """Vowel test by inventory membership (all four languages)."""
    return is_vowel_label(lang, vowel_label(lang, phone))


def is_vowel_by_letter(lang: Column, phone: Column) -> Column:
    """Vowel test of the ceiling search: sets for zh/fr/ko, any of AEIOUY otherwise."""
    by_set = lang.isin("zh", "fr", "ko")
    return F.coalesce(F.when(by_set, is_vowel_label(lang, phone_key(lang, phone))).otherwise(phone.rlike("[AEIOUY]")), F.lit(False))


def normalize_lang(tag: Column) -> Column:
    return pick(D.LANGUAGE_TAGS, tag, D.DEFAULT_LANGUAGE)


def normalize_gender(label: Column) -> Column:
    return pick(D.GENDER_LABELS, F.lower(F.trim(label)))


# --- scores -----------------------------------------------------------------


def zscore(v: Column, mean: Column, stdev: Column) -> Column:
    return (v - mean) / F.nullif(stdev, F.lit(0.0))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def resonance(zs: Sequence[Column], ws: Sequence[Column]) -> Column:
    """clamp(sum w*z + 0.5), given only if each z with a non-zero weight is known."""
    known = F.lit(True)
    total = F.lit(0.0)
    for z, w in zip(zs, ws):
        known = known & ((w == 0) | z.isNotNull())
        total = total + w * F.coalesce(z, F.lit(0.0))
    return F.when(known, clamp01(total + 0.5))


def score_zone(v: Column, lang: Column) -> Column:
    out = bands(v, D.SCORE_ZONES["zh"], D.TOP_SCORE_ZONE)
    for code in ("fr", "en", "ko"):
        out = F.when(lang == code, bands(v, D.SCORE_ZONES[code], D.TOP_SCORE_ZONE)).otherwise(out)
    return out


def pitch_zone(hz: Column) -> Column:
    return bands(hz, D.PITCH_ZONES, D.TOP_PITCH_ZONE)


def pitch_side(hz: Column) -> Column:
    """male / neutral / female by pitch; both bounds are neutral."""
    return (
        F.when(hz.isNull() | F.isnan(hz) | (hz <= 0), F.lit(None).cast("string"))
        .when(hz < D.PITCH_MALE_BELOW, "male")
        .when(hz > D.PITCH_FEMALE_ABOVE, "female")
        .otherwise("neutral")
    )


def pitch_side_confidence(hz: Column) -> Column:
    lo, hi = D.PITCH_MALE_BELOW, D.PITCH_FEMALE_ABOVE
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    side = pitch_side(hz)
    return (
        F.when(side == "male", clamp01((lo - hz) / (lo - D.PITCH_BAND[0])))
        .when(side == "female", clamp01((hz - hi) / (D.PITCH_BAND[1] - hi)))
        .when(side == "neutral", F.greatest(F.lit(0.0), 1 - F.abs(hz - mid) / half))
        .otherwise(F.lit(0.0))
    )


def _side_bounds(lang: Column) -> tuple[Column, Column]:
    lo = pick({k: v[0] for k, v in D.THREE_ZONES.items()}, lang, D.THREE_ZONES["zh"][0])
    hi = pick({k: v[1] for k, v in D.THREE_ZONES.items()}, lang, D.THREE_ZONES["zh"][1])
    return lo, hi


def score_side(v: Column, lang: Column) -> Column:
    lo, hi = _side_bounds(lang)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string"))
        .when(v < lo, "male")
        .when(v > hi, "female")
        .otherwise("neutral")
    )


def score_side_confidence(v: Column, lang: Column) -> Column:
    lo, hi = _side_bounds(lang)
    side = score_side(v, lang)
    return (
        F.when(side == "male", clamp01((lo - v) / lo))
        .when(side == "female", clamp01((v - hi) / (1 - hi)))
        .when(side == "neutral", F.greatest(F.lit(0.0), 1 - F.abs(v - (lo + hi) / 2) / ((hi - lo) / 2)))
        .otherwise(F.lit(0.0))
    )


def duration_tier(seconds: Column) -> Column:
    return (
        F.when(seconds < D.TIER_MINIMAL_BELOW_S, "minimal")
        .when(seconds < D.TIER_STANDARD_BELOW_S, "standard")
        .otherwise("full")
    )


def tone_tendency(label: Column, margin: Column) -> Column:
    voiced = label.isin("female", "male")
    side = F.when(label == "female", "feminine").otherwise("masculine")
    return (
        F.when(voiced & (margin >= D.TONE_CLEAR), F.concat(F.lit("leans_"), side))
        .when(voiced & (margin >= D.TONE_WEAK), F.concat(F.lit("weakly_"), side))
        .otherwise("not_clearly_leaning")
    )


def level_key(score: Column) -> Column:
    return F.when(score >= D.LEVEL_GOOD, "good").when(score >= D.LEVEL_WEAK, "low").when(score.isNotNull(), "weak")


def signed_score(label: Column, confidence: Column, fallback: Column) -> Column:
    """0..100 display score from a label and its confidence; 50 when unlabelled."""
    conf = F.least(F.coalesce(confidence, fallback, F.lit(0.5)), F.lit(1.0))
    return F.when(label == "female", 50 + conf * 50).when(label == "male", 50 - conf * 50).otherwise(F.lit(50.0))


def sigmoid_rescale(score: Column) -> Column:
    return 100 / (1 + F.exp(-(score / 100 - 0.5) * 5.5))


def age_ratio(age_days: Column) -> Column:
    """Position on the time axis: 40% for a day, 30% for a week, the rest by square root of a month."""
    a = F.greatest(F.lit(0.0), age_days)
    return (
        F.when(a <= 1, a * 0.4)
        .when(a <= 7, 0.4 + (a - 1) / 6 * 0.3)
        .otherwise(0.7 + F.least(F.lit(1.0), F.sqrt((a - 7) / 30)) * 0.3)
    )


def first_positive(*cols: Column) -> Column:
    """First candidate that is present, finite and above zero."""
    return F.coalesce(*[F.when((c > 0) & ~F.isnan(c.cast("double")) & (c.cast("double") < float("inf")), c) for c in cols])


def dbfs(rms: Column) -> Column:
    return F.when(rms > 0, 20 * F.log10(rms))


def softmax_rescaled(probs: Column, temperature: float) -> Column:
    """Temperature-scaled softmax of a probability array."""
    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-10))) / temperature)
    raw = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def top2_margin(probs: Column) -> Column:
    s = F.sort_array(probs, asc=False)
    return s[0] - s[1]


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two token arrays; empty gives 0."""
    both = F.size(F.array_union(a, b))
    score = F.size(F.array_intersect(a, b)) / both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(F.lit(0.0))


def jaccard_sets(a: Column, b: Column) -> Column:
    """``jaccard`` for arrays known to hold distinct, at least one, elements: one array operation."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def token_count(lang: Column, text: Column) -> Column:
    """Han characters (zh), Hangul syllables (ko), whitespace tokens otherwise."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(lang.isin("en", "fr"), words)
        .when(lang == "ko", F.regexp_count(text, F.lit("[가-힣]")))
        .otherwise(F.regexp_count(text, F.lit("[一-鿿]")))
    )


def speaker_holdout(seed: str, speaker: Column, fraction: float) -> Column:
    """Deterministic speaker-level split on the first 32 bits of SHA-1(seed|speaker)."""
    bucket = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), speaker)), 1, 8), 16, 10).cast("long") % 1000
    return bucket < int(fraction * 1000)
