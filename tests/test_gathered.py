"""Groups of bounded size are gathered once; larger ones, and rows of unknown size, take the steps by bucket. Results agree."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import close
from voxrill.functions import dims as D
from voxrill.operators import phones as P
from voxrill.operators import quantiles as Q
from voxrill.operators import sessions as SE
from voxrill.session import cut_lineage


def by_key(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def agree(a, b):
    x, y = by_key(a), by_key(b.select(a.columns))
    assert len(x) == len(y) > 0
    assert all(close(p, q) for p, q in zip(x, y)), [(p, q) for p, q in zip(x, y) if not close(p, q)][:3]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    odd = [None, float("nan"), -0.0, 0.0, 1.5]
    rows = [(g if g else None, odd[rng.randrange(5)] if rng.random() < 0.3 else rng.uniform(-50, 50), rng.choice([None, 1, 2, 3]))
            for g in range(7) for _ in range([3, 1, 40, 0, 25, 20, 21][g])]
    return spark.createDataFrame([*rows, (9, None, None)], "g int, a double, b int").cache()


@pytest.mark.parametrize("rule", ["linear", "nearest", "floor"])
def test_gathered_percentiles_are_those_by_bucket(values, monkeypatch, rule):
    monkeypatch.setattr(Q, "GATHER_ROWS", 20)
    sized = values.withColumn("n", F.when(F.col("g").isNotNull(), F.count("*").over(Window.partitionBy("g"))))
    metrics, probs = {"a": F.col("a"), "b": F.col("b")}, {"_lo": 0.05, "_mid": 0.5, "_hi": 0.95}
    agree(Q.quantiles(values, ["g"], metrics, probs, rule, counts=True), Q.quantiles(sized, ["g"], metrics, probs, rule, counts=True, size="n"))


@pytest.fixture(scope="module")
def phones(spark):
    rng = random.Random(4)
    rows = [(rec, rec % 3, "F" if rec % 2 else "M", "fr-FR", "fr", ph, ph, rng.choice([None, 0.0, rng.uniform(80, 300)]), rng.uniform(300, 900),
             rng.choice([None, rng.uniform(900, 2500)]), rng.uniform(2400, 3600))
            for rec in range(12) for _ in range(8 * rec + 1) for ph in [rng.choice(["a", "e", "i", "u", "s"])]]
    names = "recording_id long, speaker_id long, sex string, language string, lang string, phoneme string, expected string, f0 double, f1 double, f2 double, f3 double"
    return spark.createDataFrame(rows, names).cache()


@pytest.mark.parametrize("limit", [0, 30, 1 << 16])
def test_roll_ups_agree_whatever_is_gathered(spark, phones, monkeypatch, limit):
    from voxrill.operators import stats as ST

    keys = ["recording_id", "lang"]
    reference = ST.moments(phones, ["lang", "phoneme"], 5)
    plain = P.score_phones(phones, reference).drop(P.ROWS).cache()
    monkeypatch.setattr(Q, "GATHER_ROWS", limit)
    scored = P.score_phones(phones, reference)
    agree(P.recording_summary(plain, keys), P.recording_summary(scored, keys))
    agree(P.per_vowel(plain, keys), P.per_vowel(scored, keys))
    laid = Q.sized(phones, ["recording_id"], P.ROWS)
    agree(SE.panel_rollup(phones, ["recording_id"]), SE.panel_rollup(laid, ["recording_id"], P.ROWS))
    five = F.explode(F.array(*[F.lit(c) for c in D.CEILINGS])).alias("ceiling_hz")
    long = lambda df: df.select("*", F.col("phoneme").alias("phone"), five)
    agree(P.ceiling_scores(long(phones), ["recording_id"]), P.ceiling_scores(long(laid), ["recording_id"], P.ROWS))


def test_rows_without_a_key_are_kept(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 6.0), (None, 9.0)], "k int, v double")
    laid = Q.sized(rows, ["k"], "n")
    assert sorted(map(tuple, Q.medians(laid, ["k"], {"m": F.col("v")}, size="n").collect()), key=repr) == [(1, 3.0), (None, 7.5)]


def test_rows_laid_out_by_recording_move_once(spark, phones):
    laid = Q.sized(phones, ["recording_id"], P.ROWS)
    five = F.explode(F.array(*[F.lit(c) for c in D.CEILINGS])).alias("ceiling_hz")
    assert exchanges(P.ceiling_scores(laid.select("*", F.col("phoneme").alias("phone"), five), ["recording_id"], P.ROWS)) == 1
    assert exchanges(SE.panel_rollup(laid, ["recording_id"], P.ROWS)) == 1


def test_rows_laid_out_by_key_keep_tasks_of_bounded_rows(spark, phones, monkeypatch):
    monkeypatch.setattr(Q, "TASK_ROWS", 20)
    laid = Q.sized(phones, ["recording_id"], P.ROWS)
    assert laid.rdd.getNumPartitions() == -(-phones.count() // 20) > 8
    agree(phones, laid.drop(P.ROWS))
    monkeypatch.undo()
    assert Q.sized(phones, ["recording_id"], P.ROWS).rdd.getNumPartitions() == 8
    assert Q.sized(phones.where("false"), ["recording_id"], P.ROWS).count() == 0


def test_vowels_of_a_recording_are_read_off_one_list(spark, phones):
    from voxrill.operators import stats as ST
    from voxrill.plans import phone_queries as PQ

    keys = ["recording_id"]
    scored = P.score_phones(phones, ST.moments(phones, ["lang", "phoneme"], 5))
    vowels = cut_lineage(P.per_vowel(scored, keys))
    vowels = cut_lineage(vowels.unionByName(vowels.where("recording_id = 5").withColumn("recording_id", F.lit(None).cast("long"))))
    sessions = vowels.select("recording_id", F.lit("fr").alias("lang"), F.lit(0.5).alias("median_resonance"), F.lit(False).alias("low_quality")).distinct()
    laid = PQ.laid_vowels(vowels)
    for shown in (True, False):
        agree(SE.visible_set(vowels, keys, shown), SE.visible_set(laid, keys, shown, PQ.VOWEL_ROWS))
    agree(SE.resonance_panel(vowels, sessions, keys), SE.resonance_panel(laid, sessions, keys, PQ.VOWEL_ROWS))
    known = PQ.laid_vowels(vowels.where("recording_id IS NOT NULL"))
    assert exchanges(Q.medians(known, keys, {"m": F.col("resonance_med")}, size=PQ.VOWEL_ROWS)) == 1


@pytest.mark.parametrize("rule", ["linear", "nearest", "floor"])
def test_percentiles_inside_a_gathered_key_are_those_by_bucket(spark, values, monkeypatch, rule):
    monkeypatch.setattr(Q, "GATHER_ROWS", 20)
    rows = values.withColumns({"k": F.when(F.rand(5) < 0.8, F.floor(F.rand(6) * 3)), "s": F.when(F.rand(7) < 0.8, F.lit("x")).otherwise("ɛ̃")}).localCheckpoint()
    sized = rows.withColumn("n", F.when(F.col("g").isNotNull(), F.count("*").over(Window.partitionBy("g"))))
    metrics, probs = {"a": F.col("a"), "b": F.col("b")}, {"_lo": 0.05, "_mid": 0.5, "_hi": 0.95}
    want = Q.quantiles(rows, ["s", "g", "k"], metrics, probs, rule, counts=True)
    got = Q.quantiles(sized, ["s", "g", "k"], metrics, probs, rule, counts=True, size="n", inside="g")
    assert got.columns == want.columns
    agree(want, got)


def test_vowels_of_a_recording_are_gathered_in_one_row(spark, phones):
    from voxrill.operators import stats as ST

    scored = P.score_phones(phones, ST.moments(phones, ["lang", "phoneme"], 2))
    plan = P.per_vowel(scored, ["recording_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "MapInArrow" in plan


def test_shifted_phones_travel_once(spark, phones):
    from voxrill.operators import audit as AU
    from voxrill.operators import stats as ST

    some = phones.unionByName(phones.where("recording_id = 5").withColumn("recording_id", F.lit(None).cast("long")))
    stats = ST.moments(some, ["lang", "phoneme"], 2)
    want = P.recording_summary(P.score_phones(AU.shifted_phones(some), stats), ["recording_id", "lang", "variant"])
    scored = P.score_phones(some, stats, spread=AU.shifted_phones)
    got = P.recording_summary(scored, ["source", "recording_id", "lang", "variant"])
    agree(want, got.drop("source"))
    assert got.where("source.id IS NULL").count() == len(AU.VARIANTS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Below the last exchange of phones nothing is multiplied yet.
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(source")


def test_long_stages_of_the_catalogue_are_compiled(spark, monkeypatch):
    from voxrill.plans import registry as R

    monkeypatch.setattr(R, "QUERIES", dict(R.QUERIES))
    monkeypatch.setattr(R, "CHECK_SQL", dict(R.CHECK_SQL))
    monkeypatch.setattr(R, "COVERS", dict(R.COVERS))
    seen = R.query("limit_seen", "A1")(lambda spark, d: spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
    assert (R.QUERIES.get("limit_seen") or seen)(spark, "") == "8000"


@pytest.mark.parametrize("limit", [0, 30, 1 << 16])
def test_vowels_of_phones_laid_out_by_recording(spark, phones, monkeypatch, limit):
    from voxrill.operators import stats as ST

    stats = ST.moments(phones, ["lang", "phoneme"], 2)
    keys = ["recording_id", "speaker_id", "sex", "language", "lang"]
    plain = P.per_vowel(P.score_phones(phones, stats), keys)
    monkeypatch.setattr(Q, "GATHER_ROWS", limit)
    agree(plain, P.per_vowel(P.score_phones(phones, stats, together=True).where("f1 IS NOT NULL AND f2 IS NOT NULL"), keys))


def test_vowels_move_labels_and_formants_once(spark):
    """Scores and z-scores are worked out where the phones of a recording have met; no gathered lists travel."""
    from __spark_entry__ import SMALL
    from voxrill.plans import phone_queries as PQ

    plan = P.per_vowel(PQ.scorable(spark, SMALL), PQ.RECORDING)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(recording_id" in line]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0]


def test_shifted_phones_are_gathered_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Multiplied rows are dealt by their number and gathered without a sort of all of them; the session's settings stay."""
    from voxrill.operators import audit as AU
    from voxrill.operators import phones as PH

    rows = [(r, "en", "a", "a", 100.0 + i, 500.0 + 7 * i, 1500.0 + 3 * (i * r % 11), 2500.0 + i) for r in range(40) for i in range(6)] + [(None, "en", "a", "a", 90.0, 400.0, 1400.0, 2400.0)]
    df = spark.createDataFrame(rows, "recording_id long, lang string, phoneme string, expected string, f0 double, f1 double, f2 double, f3 double")
    stats = spark.createDataFrame([("en", "a", i, 10, 100.0 + 400 * i, 50.0) for i in range(4)], "lang string, phoneme string, formant int, n long, mean double, stdev double")
    keys, conf = ["source", "recording_id", "lang", "variant"], "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    written, before = [], spark.conf.get(conf)
    real = PH.cut_lineage

    def cut(df, *args, **kwargs):
        written.append(kwargs.get("conf") or {})
        return real(df, *args, **kwargs)

    monkeypatch.setattr(PH, "cut_lineage", cut)
    monkeypatch.setattr(PH, "SPREAD_ROWS", 50)
    shifted = PH.score_phones(df, stats, spread=AU.shifted_phones)
    assert shifted.select("recording_id").rdd.getNumPartitions() == -(-len(rows) * len(AU.VARIANTS) // 50)
    got = sorted(tuple(r) for r in PH.hold_summary(PH.recording_summary(shifted, keys), shifted).drop("source").collect())
    assert [conf in w for w in written] == [False, True] and spark.conf.get(conf) == before
    monkeypatch.setattr(PH, "bound", lambda *args: None)  # as where a recording is long
    shifted = PH.score_phones(df, stats, spread=AU.shifted_phones)
    other = sorted(tuple(r) for r in PH.hold_summary(PH.recording_summary(shifted, keys), shifted).drop("source").collect())
    assert [conf in w for w in written] == [False, True, False]
    assert len(got) == len(other) == 41 * len(AU.VARIANTS)
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in got] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in other]
