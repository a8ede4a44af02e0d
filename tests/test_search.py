"""Weight search in blocks and by counting, the refined box, recording means without zeros, and identity rows."""

import random

import pytest
from pyspark.sql import functions as F

from voxrill.operators import fit as FT
from voxrill.operators import history as H
from voxrill.operators import search as SE
from voxrill.session import cut_lineage


def _z(spark):
    rows = [(u, (u * 7 + i * 3) % 11 / 10 - 0.5, (u + i) % 7 / 10 - 0.3, (i % 5) / 10 - 0.2) for u in range(12) for i in range(9)]
    return spark.createDataFrame(rows, "utt long, z1 double, z2 double, z3 double")


def test_blocks_give_the_same_scores(spark):
    z, grid = _z(spark), FT.simplex_grid(spark, 6)
    whole = FT.search(z, "utt", grid, lambda s: s).collect()
    parts = FT.search(z, "utt", grid, lambda s: s, size=5).collect()
    key = lambda rows: sorted((r.utt, r.cand, round(r.score, 12)) for r in rows)
    assert key(whole) == key(parts) and len(whole) == 12 * grid.count()


def test_box_without_room_is_its_centre(spark):
    winner = spark.createDataFrame([(0.0, 0.0, 1.0)], "w1 double, w2 double, w3 double")
    assert {(r.w1, r.w2, r.w3) for r in FT.box_grid(winner, 3.0, 2).collect()} == {(3 / 10, 3 / 10, 4 / 10)}
    outside = spark.createDataFrame([(1.4, -0.2, 0.0)], "w1 double, w2 double, w3 double")
    got = FT.box_grid(outside, -0.5, 1).collect()
    assert all(abs(r.w1 + r.w2 + r.w3 - 1) < 1e-12 and min(r.w1, r.w2, r.w3) >= 0 for r in got) and got
    alone = FT.box_grid(spark.createDataFrame([(0.0, 0.0, 0.2)], "w1 double, w2 double, w3 double"), 0.5, 1).collect()
    assert [(r.w1, r.w2, r.w3) for r in alone] == [(0.0, 0.0, 1.0)]


def test_refined_only_if_better(spark):
    row = lambda c, m, s: spark.createDataFrame([(c, m, s)], "cand long, mean_acc double, std_acc double")
    pick = lambda a, b: FT.keep_better(row(1, *a), row(2, *b)).first().cand
    assert [pick((0.8, 0.1), x) for x in ((0.8, 0.1), (0.8, 0.05), (0.81, 0.2), (0.79, 0.0))] == [1, 2, 2, 1]


def test_pair_scores_leave_out_zeros(spark):
    z = spark.createDataFrame([(1, -2.0, None, 0.0), (1, 0.1, None, 0.0), (1, None, 0.2, 0.0), (1, 0.3, 0.1, None)], "utt long, z1 double, z2 double, z3 double")
    pairs = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.5, 0.5, 0.0)], "cand long, w1 double, w2 double, w3 double")
    got = {r.cand: round(r.score, 9) for r in FT.pair_scores(z, "utt", pairs).collect()}
    assert got == {1: round((0.6 + 0.8) / 2, 9), 2: 0.7}


def test_identity(spark):
    presets = spark.createDataFrame([("en", 0, "p0", ["a", "b", "c"]), ("en", 1, "p1", ["x"])], "language string, ord int, preset_id string, tokens array<string>")
    s = spark.createDataFrame([(1, "en", " A  b\nc "), (2, "en", "q"), (3, "en", None), (4, "fr", "a b c"), (5, "en", "!")], "id long, language string, said string")
    toks = F.filter(F.split(F.lower("said"), r"[^a-z]+"), lambda t: t != "")
    got = {r.id: (r.script_id, r.spoken_text_norm, r.spoken_text_tokens) for r in H.script_identity(s, presets, F.col("said"), toks).collect()}
    assert got == {1: ("p0", "a b c", ["a", "b", "c"]), 2: ("custom", "q", ["q"]), 3: (None, "", []), 4: ("custom", "a b c", ["a", "b", "c"]), 5: ("custom", "!", [])}


def test_preset_index_against_all_pairs(spark):
    """Many presets, near and equal ones among them; repeated tokens, rows without tokens and of no language."""
    rng = random.Random(2)
    words = ["w%d" % i for i in range(60)]
    presets = [(lang, o, f"{lang}{o}", rng.sample(words, rng.randrange(1, 25))) for lang in ("en", "fr") for o in range(40)]
    presets += [("en", 40, "copy", presets[3][3]), ("en", 41, "none", [])]
    said = []
    for _ in range(300):
        t = list(rng.choice(presets)[3])
        for _ in range(rng.randrange(3)):
            t = t[1:] if rng.random() < 0.5 else [*t, rng.choice(words)]
        said.append((rng.choice(["en", "fr", None]), t + t[:2]))
    rows = [(i, *x) for i, x in enumerate(said + [("en", []), ("xx", ["a"]), said[0], said[0]])]
    s = spark.createDataFrame(rows, "id long, language string, tokens array<string>")
    ps = spark.createDataFrame(presets, "language string, ord int, preset_id string, tokens array<string>")

    def want(lang, tokens):
        if not tokens:
            return None, None
        scores = [(len(set(tokens) & set(p)) / len(set(tokens) | set(p)), -o, name) for of, o, name, p in presets if of == lang]
        best = max((x for x in scores if x[0] >= 0.85), default=None)
        return (best[2], round(best[0], 9)) if best else ("custom", None)

    got = {r.id: (r.script_id, r.preset_score and round(r.preset_score, 9)) for r in H.best_preset(s, ps, 0.85).collect()}
    assert got == {i: want(lang, t) for i, lang, t in rows}
    assert sum(v[0] not in (None, "custom") for v in got.values()) > 50
    assert {r.script_id for r in H.best_preset(s, ps.limit(0), 0.85).collect()} == {None, "custom"}


def _owned(spark, n=90, seed=4):
    """Phones of utterances with ties, lacking values, unknown sexes and speakers of different size."""
    rng = random.Random(seed)
    phones = [(u, *(None if rng.random() < 0.05 else rng.choice([round(rng.uniform(-1, 1), 1), rng.uniform(-1, 1)]) for _ in range(3))) for u in range(n) for _ in range(rng.randrange(0, 9))]
    phones += [(u, 5.0, 5.0, 5.0) for u in range(n, n + 8)]  # scores of exactly 1
    owners = [(u, min(u % 17, 9), ["M", "F", "F", "M", None, "X"][min(u % 17, 9) % 6]) for u in range(n + 8)]
    return spark.createDataFrame(phones, "utt long, z1 double, z2 double, z3 double"), spark.createDataFrame(owners, "utt long, spk long, sex string")


@pytest.mark.parametrize("unit", ["utt", "spk"])
@pytest.mark.parametrize("buckets, few", [(256, 4096), (8, 2)])
def test_counting_equals_a_row_per_score(spark, unit, buckets, few):
    z, owners = _owned(spark)
    grid = FT.simplex_grid(spark, 7)
    units = SE.unit_rows(z, "utt", owners, unit, 3, "s")
    scores = FT.search(z, "utt", grid, lambda s: s).join(owners, "utt")
    if unit == "spk":
        scores = FT.speaker_scores(scores, "spk")
    scores = cut_lineage(scores)
    acc = F.col("correct") / F.col("total")
    got = SE.Search(units, grid, 3, buckets, few).decisions().groupBy("cand").agg(F.avg(acc).alias("mean_acc"), F.stddev_pop(acc).alias("std_acc"))
    shape = lambda df: {r.cand: (round(r.mean_acc, 9), round(r.std_acc, 9)) for r in df.collect()}
    assert shape(got) == shape(FT.kfold_accuracy(scores, unit, 3, "s"))
    fit = lambda df: {r.cand: round(r.acc, 9) for r in df.collect()}
    assert fit(SE.fitted(units, grid)) == fit(FT.full_fit_accuracy(scores))


def test_thresholds_among_very_close_scores(spark):
    """Hundreds of scores within 1e-9 of each other: buckets are split until the median can be fetched."""
    z = spark.createDataFrame([(u, u * 1e-12, 0.0, 0.0) for u in range(501)], "utt long, z1 double, z2 double, z3 double")
    owners = z.select("utt", F.lit("M").alias("sex"))
    grid = FT.simplex_grid(spark, 1)
    found = SE.Search(SE.unit_rows(z, "utt", owners, "utt", 1, "s"), grid, 1, 8, 4).thresholds()
    assert found[:, 0].tolist() == [0.5, 0.5, 0.5 + 250 * 1e-12]


def test_search_without_units_and_with_too_many_candidates(spark, monkeypatch):
    z, owners = _owned(spark)
    none = SE.unit_rows(z.limit(0), "utt", owners, "utt", 3, "s")
    assert SE.cross_validated(none, FT.simplex_grid(spark, 2), 3).count() == 0
    monkeypatch.setattr(SE, "MAX_CANDIDATES", 5)
    with pytest.raises(ValueError, match="candidates"):
        SE.Search(none, FT.simplex_grid(spark, 2), 3)


def test_what_tasks_send_does_not_grow_with_the_units(spark):
    """Ten times the utterances, the same rows behind the scoring."""
    grid = FT.simplex_grid(spark, 3)
    sent = []
    for n in (90, 900):
        z, owners = _owned(spark, n)
        units = SE.unit_rows(z, "utt", owners, "utt", 3, "s").coalesce(2)
        s = SE.Search(units, grid, 3)
        sent.append(s.decisions().count())
        assert s.k == 3 and s.thresholds().shape == (grid.count(), 3)
    assert sent[0] == sent[1] == 3 * grid.count()
