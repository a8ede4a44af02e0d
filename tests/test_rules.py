"""Boundary values of the scalar rules, text rules and group solvers."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrill.functions import scalar as S
from voxrill.functions import text as T
from voxrill.operators import fit as FT
from voxrill.operators import history as H
from voxrill.operators import phones as P
from voxrill.operators import sequence as Q
from voxrill.operators import sessions as SE
from voxrill.operators import stats as ST
from voxrill.plans import phone_queries as PQ
from voxrill.plans import adapters as A


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_score_zones(spark):
    rows = [("zh", 0.4899), ("zh", 0.490), ("zh", 0.98), ("fr", 0.43), ("fr", 0.960), ("en", 0.3509), ("en", 0.682), ("ko", 0.547), ("xx", 0.612), ("zh", None), ("zh", math.nan)]
    got = values(spark, rows, "lang string, v double", S.score_zone(F.col("v"), F.col("lang")))
    assert [g[0] for g in got] == [
        "clearly_below_female", "leans_male", "at_ceiling", "leans_male", "at_ceiling", "clearly_below_female", "leans_female", "mid_neutral", "mid_neutral", None, None]


def test_pitch_zones_and_sides(spark):
    hz = [(129.9,), (130.0,), (165.0,), (200.0,), (240.0,), (None,)]
    assert [g[0] for g in values(spark, hz, "v double", S.pitch_zone(F.col("v")))] == ["low", "mid_lower", "mid_neutral", "mid_upper", "high", None]
    hz = [(145.0,), (185.0,), (144.9,), (185.1,), (0.0,), (165.0,), (80.0,), (250.0,)]
    got = values(spark, hz, "v double", S.pitch_side(F.col("v")), S.pitch_side_confidence(F.col("v")))
    assert [g[0] for g in got] == ["neutral", "neutral", "male", "female", None, "neutral", "male", "female"]
    assert got[0][1] == 0 and got[5][1] == 1 and got[6][1] == 1 and got[7][1] == 1


def test_tiers_tendencies_levels(spark):
    assert [g[0] for g in values(spark, [(9.99,), (10.0,), (29.99,), (30.0,)], "v double", S.duration_tier(F.col("v")))] == ["minimal", "standard", "standard", "full"]
    rows = [("female", 0.78), ("male", 0.779), ("male", 0.5), ("female", 0.499), (None, 0.9)]
    assert [g[0] for g in values(spark, rows, "l string, m double", S.tone_tendency(F.col("l"), F.col("m")))] == [
        "leans_feminine", "weakly_masculine", "weakly_masculine", "not_clearly_leaning", "not_clearly_leaning"]
    assert [g[0] for g in values(spark, [(0.65,), (0.649,), (0.4,), (0.399,), (None,)], "v double", S.level_key(F.col("v")))] == ["good", "low", "low", "weak", None]


def test_vowels_and_labels(spark):
    rows = [("zh", "i˥"), ("zh", "a˧˨"), ("en", "IY1"), ("en", "ER0"), ("en", "S"), ("fr", "ɛ̃"), ("fr", "j"), ("ko", "eː"), ("ko", "w")]
    got = values(spark, rows, "l string, p string", S.is_vowel_by_set(F.col("l"), F.col("p")), S.is_vowel_by_letter(F.col("l"), F.col("p")), S.vowel_label(F.col("l"), F.col("p")))
    assert [g[0] for g in got] == [True, True, True, True, False, True, False, True, False]
    assert [g[1] for g in got] == [True, True, True, True, False, True, False, True, False]
    assert [g[2] for g in got][:4] == ["i", "a", "IY", "ER"]


def test_number_parsing(spark):
    got = values(spark, [("--undefined--",), ("",), ("?",), ("NaN",), ("0",), ("-3",), ("12.5",), ("x",)], "s string", S.positive_number(F.col("s")))
    assert [g[0] for g in got] == [None] * 6 + [12.5, None]


def test_holdout_bucket(spark):
    got = values(spark, [("SSB0005",)], "s string", S.speaker_holdout("v0.2.0", F.col("s"), 0.427), S.speaker_holdout("v0.2.0", F.col("s"), 0.428))
    assert got == [(False, True)]


def test_text_rules(spark):
    rows = [("你 好<unk>吗", "Don't STOP—now 99!"), ("안녕 hello 하세요", "L'été  À-demi 2x")]
    got = values(spark, rows, "a string, b string", T.clean_zh(F.col("a")), T.han_chars(F.col("a"), " "), T.clean_ko(F.col("a")), T.clean_en(F.col("b")), T.clean_fr(F.col("b")))
    assert got[0][0] == "你好吗" and got[0][1] == "你 好 吗" and got[0][3] == "Don't STOP now"
    assert got[1][2] == "안녕 하세요" and got[1][4] == "l'été à-demi x"
    rows = [("ＡＢc don't", "en-US"), ("你好abc", "zh-CN"), ("하세 x", "ko-KR"), (None, "en-US")]
    got = values(spark, rows, "t string, l string", T.match_tokens(F.col("t"), F.col("l")))
    assert [g[0] for g in got] == [["abc", "don't"], ["你", "好"], ["하", "세"], []]
    got = values(spark, [("你好吗x的", "你好的吧"), ("你x", "你")], "t string, l string", T.keep_in_lexicon(F.col("t"), F.col("l"), 2))
    assert [g[0] for g in got] == ["你好的", None]


def test_token_counts(spark):
    rows = [("zh", "你好ab"), ("ko", "안녕 하"), ("en", " a  b c ")]
    assert [g[0] for g in values(spark, rows, "l string, t string", S.token_count(F.col("l"), F.col("t")))] == [2, 3, 3]


def test_cell_weight(spark):
    got = values(spark, [("好",), ("하",), ("a",), ("possibilities",), ("",), ("morning",), (None,)], "c string", Q.cell_weight(F.col("c")))
    assert [g[0] for g in got] == [1, 1, 2, 10, 0, 7, 0]


def brute_cuts(cuts, total, n, lo, hi):
    best, key = None, (math.inf, math.inf)
    for combo in itertools.combinations(sorted(cuts), n - 1):
        e = [0.0, *combo, total]
        d = [b - a for a, b in zip(e, e[1:])]
        if min(d) < lo or max(d) > hi:
            continue
        k = (max(d), max(d) - min(d))
        if k[0] < key[0] - 1e-6 or (k[0] < key[0] + 1e-6 and k[1] < key[1]):
            best, key = list(combo), k
    if best is None and n > 2:
        return brute_cuts(cuts, total, n - 1, lo, hi)
    return best


def test_chunk_cuts_match_exhaustive_search():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.uniform(8, 60)
        cuts = sorted(rng.uniform(0.5, total - 0.5) for _ in range(rng.randint(1, 9)))
        n = min(rng.randint(2, 6), len(cuts) + 1)
        a, b = Q.best_cuts(cuts, total, n, 3.0, 20.0), brute_cuts(cuts, total, n, 3.0, 20.0)
        assert (a is None) == (b is None)
        if a is not None:
            size = lambda c: [y - x for x, y in zip([0.0, *c], [*c, total])]
            assert len(a) == len(b) and max(size(a)) == pytest.approx(max(size(b)), abs=2e-6)
            assert max(size(a)) - min(size(a)) == pytest.approx(max(size(b)) - min(size(b)), abs=4e-6)


def test_pages_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice([0, 2, 3, 10])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, weight int")
    want, load, page = {}, 0, 0
    for _, i, w in rows:
        if w == 0:
            continue
        if load and load + w > 12:
            page, load = page + 1, 0
        load += w
        want[i] = page
    for width in (7, 1000):
        got = Q.weight_pages(df, ["k"], ["i"], F.floor(F.col("i") / width), 12)
        assert {r["i"]: r["page"] for r in got.collect()} == want


def test_silence_pairing(spark):
    ev = [(0.5, False), (1.0, True), (2.0, True), (3.0, False), (3.5, False), (4.0, False), (5.0, True), (5.0, False), (6.0, False), (7.0, True)]
    df = spark.createDataFrame([("r", t, s, i) for i, (t, s) in enumerate(ev)], "r string, t double, is_start boolean, ref int")
    got = sorted((r["start"], r["end"]) for r in Q.pair_events(df, ["r"], F.floor(F.col("t") / 2)).collect())
    assert got == [(1.0, 3.0), (2.0, 3.5), (5.0, 6.0)]


def test_signal_gate(spark):
    n = 8192
    t = np.arange(n)
    waves = {
        "sine": 0.3 * np.sin(t / 10), "silence": np.zeros(n), "clipped": np.clip(3 * np.sin(t / 10), -1, 1), "quiet": 1e-4 * np.sin(t / 10),
        "short": np.where(t < 300, 0.5 * np.sin(t / 10), 0.0), "empty": np.zeros(0)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in waves.items()], "name string, x array<float>")
    got = {r["name"]: [v["code"] for v in r["violations"]] for r in SE.signal_gate(df, "x").collect()}
    assert got["sine"] == [] and got["clipped"] == ["clipping"] and got["quiet"] == ["too_quiet"]
    assert got["silence"] == ["too_quiet", "insufficient_voicing"] == got["empty"]
    keys = {r["name"]: r["violations"][0]["i18n_key"] for r in SE.signal_gate(df, "x").collect() if r["violations"]}
    assert keys["silence"] == "audioGate.silence" and keys["quiet"] == "audioGate.tooQuiet"


def test_ceiling_choice(spark):
    """Vowels cluster tightly at one ceiling only; tone-bearing labels are separate classes; few classes fall back."""
    rows = []
    rng = random.Random(1)
    for rec, good, lang, labels in (("a", 6000, "fr", "aeiou"), ("b", 4500, "fr", "aeiou"), ("c", 5000, "fr", "ae"), ("d", 4500, "ko", "eiou")):
        for hz in (4500, 5000, 5500, 6000, 6500):
            for v in labels:
                for _ in range(4):
                    noise = 0.01 if hz == good else 0.4
                    rows.append((rec, lang, v, hz, *[f * (1 + rng.uniform(-noise, noise)) for f in (500.0, 1500.0, 2800.0)]))
    df = spark.createDataFrame(rows, "r string, lang string, phone string, ceiling_hz int, f1 double, f2 double, f3 double")
    recs = df.select("r", "lang").distinct()
    got = {r["r"]: r["ceiling_hz"] for r in P.pick_ceiling(P.ceiling_scores(df, ["r"]), recs, ["r"]).collect()}
    assert got == {"a": 6000, "b": 4500, "c": 5500, "d": 5000}


def test_words_attach_at_equal_time_and_drop_before_first(spark):
    items = [("r", 0.5, False, None), ("r", 1.0, True, "w0"), ("r", 1.0, False, None), ("r", 1.2, False, None), ("r", 2.0, True, "w1"), ("r", 2.5, False, None)]
    df = spark.createDataFrame([(*x[:3], x[3], i) for i, x in enumerate(items)], "r string, t double, is_word boolean, word string, ref int")
    df = df.withColumn("is_phone", ~F.col("is_word")).withColumn("word_time", F.when(F.col("is_word"), F.col("t")))
    got = P.attach_words(df, ["r"], ["t", "is_phone", "ref"], F.floor("t"))
    assert sorted((r["ref"], r["word"], r["word_index"], r["nth"]) for r in got.collect()) == [(2, "w0", 0, 0), (3, "w0", 0, 1), (5, "w1", 1, 0)]


def test_zero_scores_count_per_vowel_but_not_in_summary(spark):
    rows = [("r", "en", "IY1", False, 100.0, 300.0, 2000.0, 2600.0, s) for s in (0.0, 0.0, 0.6, 0.8)]
    df = spark.createDataFrame(rows, "rec string, lang string, phoneme string, outlier boolean, f0 double, f1 double, f2 double, f3 double, resonance double")
    for z in ("z_f1", "z_f2", "z_f3"):
        df = df.withColumn(z, F.lit(0.1))
    assert P.recording_summary(df, ["rec"]).collect()[0]["median_resonance"] == pytest.approx(0.7)
    v = P.per_vowel(df, ["rec"]).collect()[0]
    assert (v["vowel"], v["n"], v["resonance_med"], v["is_vowel"]) == ("IY", 4, 0.3, True)


def test_more_f2_never_lowers_a_score(spark):
    d = "/root/testdata/sf0.001"
    p = A.phones(spark, d)
    stats = ST.moments(PQ.keyed(spark, d), ["lang", "phoneme"], 5)
    z = lambda q: P.attach_reference(q, P.reference_wide(stats)).withColumn("s", S.resonance([F.col("z_f1"), F.col("z_f2"), F.col("z_f3")], P.weight_columns(F.col("lang"))))
    a, b = z(p).agg(F.avg("s")).first()[0], z(p.withColumn("f2", F.col("f2") + 200)).agg(F.avg("s")).first()[0]
    assert b > a


def test_training_guard_and_defaults(spark):
    rows = [("a", 100.0 + i, 300.0 + i, 2000.0 + i, None) for i in range(6)] + [("b", 1.0, None, 3.0, 4.0)] * 6
    df = spark.createDataFrame(rows, "phoneme string, f0 double, f1 double, f2 double, f3 double")
    got = {(r["phoneme"], r["formant"]): r for r in ST.train(df, ["phoneme"], 5).collect()}
    assert {k[0] for k in got} == {"a"} and len(got) == 4
    assert tuple(got[("a", 3)])[2:] == (0, 0.0, 1.0, 0.0, 0.0, 0.0) and got[("a", 1)]["median"] == 302.5


def test_threshold_sweep_against_loop(spark):
    rng = random.Random(9)
    rows = [(rng.random() < 0.5, rng.choice([0.0, 1.0, 0.25, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    got = {r["step"]: r["acc"] for r in FT.threshold_sweep(df, [], F.col("y"), F.col("s"), 101).collect()}
    for i in range(101):
        assert got[i] == pytest.approx(np.mean([(s >= i * 0.01) == y for y, s in rows]))


def test_prior_attempt_against_loop(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(20)] for _ in range(6)]
    sess = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 900)}"
        sess.append((0 if i % 3 else 1, "fr", i, rng.randint(0, 60), "p1" if i % 40 == 0 else "custom", t if i % 29 else []))
    df = spark.createDataFrame(sess, "u int, language string, session_id long, created_at long, script_id string, tokens array<string>")
    got = {r["session_id"]: r["prior_id"] for r in H.prior_attempt(df, ["u"], F.floor(F.col("created_at") / 10)).collect()}
    by_id = {s[2]: s for s in sess}

    def sim(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a and b else 0.0

    for u, lang, i, at, script, toks in sess:
        ok = [s for s in sess if s[0] == u and s[3] < at and ((script != "custom" and s[4] == script) or sim(toks, s[5]) >= 0.7)]
        want = max((s[3] for s in ok), default=None)
        assert (by_id[got[i]][3] if got[i] is not None else None) == want


def test_windows_from_panes(spark):
    """Every window of every length against plain slicing; silent windows count, windows past the end do not."""
    import random
    import statistics

    rng = random.Random(6)
    dur = {1: 31.5, 2: 9.0, 3: 2.0}
    frames = [(r, rng.uniform(0, d), float(rng.choice([100, 150, 151, 200]))) for r, d in dur.items() for _ in range(int(3 * d)) if rng.random() < 0.6]
    frames = [f for f in frames if not 12 < f[1] < 20] + [(1, 5.0, None)]
    got = {(r.r, r.length_s, r.win): (r.n, r["median"]) for r in Q.pane_windows(
        spark.createDataFrame(frames, "r int, t double, f0 double"), spark.createDataFrame(list(dur.items()), "r int, dur double"), ["r"], [3, 5, 10], 1.0, 2).collect()}
    want = {}
    for r, d in dur.items():
        for n in (3, 5, 10):
            for w in range(int(d - n) + 1 if d >= n else 0):
                v = [f for k, t, f in frames if k == r and w <= t < w + n and f is not None]
                want[r, n, w] = (len(v), statistics.median(v) if len(v) >= 2 else None)
    assert got == want and any(n == 0 for n, _ in want.values())
    with pytest.raises(ValueError):
        Q.pane_windows(None, None, ["r"], [3], 2.0, 1)


def test_nested_advice(spark):
    """Panels by tier, warnings with parameters, no summary without a pitch zone, no resonance without scores."""
    vowels = spark.createDataFrame(
        [(1, "a", 0.2, 3, True), (1, "m", 0.1, 9, False), (1, "e", 0.35, 2, True), (1, "i", 0.7, 2, True), (1, "o", 0.3, 1, True), (2, "a", 0.99, 4, True), (3, "a", 0.5, 4, True)],
        "sid long, vowel string, resonance_med double, n long, is_vowel boolean")
    scores = spark.createDataFrame([(1, "en", 0.4, True), (2, "en", 0.9, True), (3, "en", 0.5, False), (5, "fr", None, False)], "sid long, lang string, median_resonance double, low_quality boolean")
    detail = SE.resonance_detail(vowels, scores, ["sid"])
    panel = "struct<median_hz: double, range_zone: string>"
    s = spark.createDataFrame(
        [(1, 12.5, "female", 0.9, (200.0, "high")), (2, 31.0, "male", 0.6, (None, None)), (3, 9.994, "male", 0.9, (110.5, "low")), (4, 45.0, None, 0.0, (111.5, "low")), (5, 30.0, "male", 0.2, (99.0, "low"))],
        f"sid long, recording_s double, dominant_label string, margin double, f0_panel {panel}",
    ).withColumns({f"{x}_ratio": F.lit(0.25) for x in ("female", "male", "other")})
    got = {r.sid: json.loads(r.j) for r in SE.advice(s.join(detail, "sid", "left"), ["sid"]).select("sid", F.to_json("advice", {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert list(got[1]) == ["schema_version", "gating_tier", "recording_duration_sec", "f0_panel", "tone_panel", "summary_panel", "resonance_panel", "warnings"]
    assert [got[i]["gating_tier"] for i in range(1, 6)] == ["standard", "full", "minimal", "full", "full"]
    assert got[1]["warnings"] == [{"key": "advice.warning.short_recording_standard", "params": {"duration": 12}}]
    assert got[3]["warnings"] == [{"key": "advice.warning.short_recording_minimal", "params": {"duration": None}}] and got[2]["warnings"] == []
    assert got[3]["f0_panel"]["median_hz"] == 110.5 and not any(got[3][p] for p in ("tone_panel", "summary_panel", "resonance_panel"))
    assert got[1]["summary_panel"] == {"text_key": "advice.summary.high_leans_feminine", "text_params": {"f0": 200}}
    assert got[2]["summary_panel"] is None and got[4]["summary_panel"]["text_params"] == {"f0": 112}
    assert got[2]["tone_panel"] == {"ina_label_distribution": {f"{x}_frame_ratio": 0.25 for x in ("female", "male", "other")}, "tone_tendency_key": "weakly_masculine", "caveat_key": "ina.f0_bias_caveat"}
    one = got[1]["resonance_panel"]
    assert [(w["vowel"], w["n"], w["text_key"]) for w in one["weakness_vowels"]] == [(v, n, "advice.resonance.weakness.resonance_low") for v, n in (("a", 3), ("e", 2))]
    assert [(w["level_key"], w["vowel"], w["is_vowel"]) for w in one["per_vowel"]] == [("weak", "m", False), ("weak", "a", True), ("weak", "e", True), ("good", "i", True)]
    assert one["median_resonance"] == 0.275 and one["caveat_key"] == "advice.resonance.caveat.low_alignment" and one["summary_text_key"].startswith("advice.resonance.summary.")
    assert got[2]["resonance_panel"]["caveat_key"] == "advice.resonance.caveat.score_clamp"
    assert got[4]["resonance_panel"] is None
    assert got[5]["resonance_panel"]["zone_key"] is None and got[5]["resonance_panel"]["summary_text_key"] is None and got[5]["resonance_panel"]["per_vowel"] == []
