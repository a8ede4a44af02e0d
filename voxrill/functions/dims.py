"""Phone sets, score zones, thresholds, weights and label tables.

These must equal the published measurement definitions for results to match.
"""

from __future__ import annotations

# --- fixed values: vowel nuclei per language -------------------------------
ZH_VOWELS = ["a", "aj", "aw", "e", "ej", "i", "io", "o", "ow", "u", "y", "ə", "ɥ", "ʐ̩", "z̩"]
FR_VOWELS = ["a", "ɑ", "e", "ɛ", "i", "o", "ɔ", "u", "y", "ø", "œ", "ə", "ɛ̃", "ɑ̃", "ɔ̃", "œ̃"]
KO_VOWELS = ["ɐ", "e", "eː", "ɛ", "ɛː", "i", "iː", "o", "oː", "u", "uː", "ɨ", "ɨː", "ʌ", "ʌː"]
EN_VOWELS = ["AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"]
VOWELS = {"zh": ZH_VOWELS, "fr": FR_VOWELS, "ko": KO_VOWELS, "en": EN_VOWELS}
TONE_MARKS = "[˥˦˧˨˩]+"
STRESS_DIGIT = "[012]$"

# --- fixed values: language tags -------------------------------------------
LANGUAGE_TAGS = {
    "zh-CN": "zh", "zh": "zh",
    "en-US": "en", "en": "en",
    "fr-FR": "fr", "fr": "fr",
    "ko-KR": "ko", "ko": "ko",
}
DEFAULT_LANGUAGE = "zh"

# --- fixed values: gender labels in crowd corpora --------------------------
GENDER_LABELS = {
    "male": "male", "male_masculine": "male",
    "female": "female", "female_feminine": "female",
}

# --- fixed values: formant-ceiling search ----------------------------------
CEILINGS = [4500, 5000, 5500, 6000, 6500]
DEFAULT_CEILING = 5500
LEGACY_CEILING = 5000
ADAPTIVE_LANGS = ["fr", "zh", "en"]
MIN_TOKENS_PER_CLASS = 2
MIN_VOWEL_CLASSES = 3
F2_WEIGHT = 1.5
F3_WEIGHT = 0.5
TIE_TOLERANCE = 1.05

# --- fixed values: score weights per language ------------------------------
WEIGHTS = {
    "zh": [0.762, 0.236, 0.002],
    "en": [0.7321428571428571, 0.26785714285714285, 0.0],
    "fr": [0.762, 0.236, 0.002],
    "ko": [0.762, 0.236, 0.002],
}

# --- fixed values: score zones (upper bound of each zone) ------------------
SCORE_ZONES = {
    "zh": [("clearly_below_female", 0.490), ("leans_male", 0.612), ("mid_neutral", 0.842), ("leans_female", 0.98)],
    "fr": [("clearly_below_female", 0.430), ("leans_male", 0.547), ("mid_neutral", 0.752), ("leans_female", 0.960)],
    "en": [("clearly_below_female", 0.351), ("leans_male", 0.458), ("mid_neutral", 0.682), ("leans_female", 0.98)],
    "ko": [("clearly_below_female", 0.430), ("leans_male", 0.547), ("mid_neutral", 0.752), ("leans_female", 0.960)],
}
TOP_SCORE_ZONE = "at_ceiling"
THREE_ZONES = {"zh": (0.612, 0.842), "en": (0.458, 0.682), "fr": (0.547, 0.752), "ko": (0.547, 0.752)}

# --- fixed values: pitch zones (Hz) ----------------------------------------
PITCH_ZONES = [("low", 130.0), ("mid_lower", 165.0), ("mid_neutral", 200.0), ("mid_upper", 240.0)]
TOP_PITCH_ZONE = "high"
PITCH_MALE_BELOW, PITCH_FEMALE_ABOVE = 145.0, 185.0
PITCH_BAND = (80.0, 250.0)

# --- fixed values: session thresholds --------------------------------------
TIER_MINIMAL_BELOW_S, TIER_STANDARD_BELOW_S = 10.0, 30.0
TONE_CLEAR, TONE_WEAK = 0.78, 0.50
LEVEL_GOOD, LEVEL_WEAK = 0.65, 0.40
WEAKNESS_TOP_K = 3
ZONE_MIN_TOKENS, PANEL_MIN_TOKENS = 5, 2
AT_CEILING = 0.98
CLIP_LEVEL, CLIPPING_MAX, RMS_DBFS_MIN, ACTIVE_MIN, ACTIVE_TOP_DB = 0.99, 0.005, -55.0, 0.10, 30.0
LOW_PHONE_RATIO = {"zh": 0.8, "en": 1.5, "fr": 1.5, "ko": 1.5}
LOW_COVERAGE = 0.3
MIN_VOICED_S = 3.0
VOICED_FLOOR_S = 1.0

# --- fixed values: corpus duration bounds in seconds ------------------------
DURATION_BOUNDS = {"zh": (2.5, 12.0), "en": (2.5, 18.0), "fr": (5.0, 15.0), "ko": (5.0, 15.0)}

# --- fixed values: history matching ----------------------------------------
MATCH_JACCARD, PRESET_JACCARD = 0.7, 0.85
DELTA_STEP = 0.3
DIVERGENCE_SCORE, DIVERGENCE_RATIO, DIVERGENCE_MIN_ROWS = 5.0, 0.5, 4

# --- fixed values: literature F2 of female zh vowels (Hz) ------------------
LITERATURE_F2 = {"i": 2700, "y": 2300, "e": 2200, "ej": 2100, "ə": 1700, "a": 1400, "u": 800}
CANARY_VOWELS = ["i", "y", "e"]
