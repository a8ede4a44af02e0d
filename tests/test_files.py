"""File readers and writers on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from voxrill import schemas as SC
from voxrill.operators import stats as ST
from voxrill.sources import readers as R
from voxrill.sources import writers as W
from voxrill.streaming import progress as G

ALIGNER = """junk
Words:
0\tje
0.4\tsuis
Phonemes:
0\tj\t120.5\t300\t2000\t2600
bad\tə\t--undefined--\t400\t1500\t--undefined--
0.4\ts
0.41\ts\t--undefined--\t--undefined--\t1800\t2500
Multi-Ceiling-Formants:
# ceilings: 4500 5000 5500 6000 6500
0\tj\t120.5\t{a}
0.4\tx\t1

Extra:
9\tz\t1\t2\t3\t4
"""


def test_aligner_files(spark, tmp_path):
    cells = "\t".join(str(c) for c in [301, 2001, 2601] * 4 + ["--undefined--", 2001, -5])
    for n in ("a", "b"):
        (tmp_path / f"{n}.praat.txt").write_text(ALIGNER.replace("{a}", cells), encoding="utf-8")
    lines = R.read_lines(spark, str(tmp_path), "*.praat.txt")
    words = R.aligner_words(lines)
    assert [(r["t"], r["word"]) for r in words.where(F.col("file").endswith("a.praat.txt")).orderBy("t").collect()] == [(0.0, "je"), (0.4, "suis")]
    ph = R.aligner_phones(lines).where(F.col("file").endswith("b.praat.txt")).orderBy("pos").collect()
    assert [(r["t"], r["phone"], r["f0"], r["f3"]) for r in ph] == [(0.0, "j", 120.5, 2600.0), (None, "ə", None, None), (0.41, "s", None, 2500.0)]
    mc = R.multi_ceiling(lines).where(F.col("file").endswith("a.praat.txt")).orderBy("ceiling_hz").collect()
    assert [(r["ceiling_hz"], r["f1"], r["f3"]) for r in mc] == [(c, 301.0, 2601.0) for c in (4500, 5000, 5500, 6000)] + [(6500, None, None)]
    # The reader treats a start of 0 as undefined.
    assert {r["start"] for r in mc} == {None}


def test_dictionary_last_entry_wins(spark, tmp_path):
    (tmp_path / "d.txt").write_text("ainsi\t1\t1\t1\t1\tɛ̃ s i\nshort\t1\nainsi\t1\t1\t1\t1\ta s\n", encoding="utf-8")
    assert [tuple(r) for r in R.dictionary(R.read_lines(spark, str(tmp_path / "d.txt")), "fr").collect()] == [("ainsi", ["a", "s"])]


def test_corpus_tree(spark, tmp_path):
    (tmp_path / "AUDIO_INFO").write_text("SPEAKERID|NAME|SEX|X\n7|n|m|1\n8|n|?|1\n")
    for s in ("7", "8"):
        f = tmp_path / "train_data_01" / "3" / s
        f.mkdir(parents=True)
        (f / f"{s}_3.trans.txt").write_text(f"{s}_3_1 안녕 하세요\n\n{s}_3_2\n")
        (f / f"{s}_3_1.flac").write_bytes(b"xx")
    got = R.load_index(spark, str(tmp_path), "tree").collect()
    assert [(r["speaker_id"], r["gender"], r["utt"], r["sentence"]) for r in got] == [("7", "male", "7_3_1", "안녕 하세요")]
    assert got[0]["path"].endswith("/7/7_3_1.flac")
    clips = R.clips_from_paths(R.list_clips(spark, str(tmp_path), "*.flac").select("path"))
    assert sorted(r["speaker_id"] for r in clips.collect()) == ["7", "8"]
    with pytest.raises(ValueError):
        R.load_index(spark, str(tmp_path), "other")


def test_crowd_tsv(spark, tmp_path):
    (tmp_path / "validated.tsv").write_text('client_id\tpath\tsentence\tgender\nc1\ta.mp3\tIl dit "oui\tmale_masculine\nc2\tb.mp3\t\tfemale\nc3\tc.mp3\tx\tother\n')
    assert [tuple(r) for r in R.load_index(spark, str(tmp_path), "cv").collect()] == [("c1", "a.mp3", 'Il dit "oui', "male")]


def test_stats_json_round_trip(spark, tmp_path):
    rows = [("a", 1.0 * i, 2.0 * i, 3.0 * i, None) for i in range(1, 8)]
    s = ST.train(spark.createDataFrame(rows, "phoneme string, f0 double, f1 double, f2 double, f3 double"), ["phoneme"], 3)
    W.write_json_text(ST.nested_json(s, []), str(tmp_path / "s"))
    back = R.explode_stats(spark.read.text(str(tmp_path / "s")), "value")
    cols = ["phoneme", "formant", "mean", "stdev", "median", "max", "min"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, s.select(cols).collect()))


def test_bundles_round_trip(spark, tmp_path):
    ec = {"median_resonance": 0.5, "median_pitch_hz": 200.0, "alignment_confidence": {"low_quality": True}, "resonance_per_vowel": [{"vowel": "a", "n": 3}]}
    doc = {"export_schema_version": "1", "payload": {"sessions": [{"filename": "x", "summary": {"engine_c": ec}, "analysis": []}]}}
    f = tmp_path / "fr-FR" / "sessions" / "F"
    f.mkdir(parents=True)
    (f / "session_1.vga.json").write_text(json.dumps(doc, indent=2))
    r = R.bundle_sessions(R.read_bundles(spark, str(tmp_path))).collect()[0]
    assert (r["lang"], r["sex"], r["median_resonance"], r["low_quality"], r["vowels"][0]["n"]) == ("fr-FR", "F", 0.5, True, 3)


def test_import_limits(spark):
    def doc(n, **kw):
        return json.dumps({"export_schema_version": "1", "exported_at": "2024-01-01T00:00:00Z", "payload": {"sessions": [{"summary": {}, "analysis": [], **kw}] * n}})

    docs = {"ok": doc(100), "many": doc(101), "none": doc(0), "bad": "{", "audio": doc(1, audio={"base64": "x" * 50, "last_modified": 5})}
    df = spark.createDataFrame(list(docs.items()), "name string, text string")
    good, bad = R.check_imports(df, "text", "name", max_audio=10)
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"many": "too_many", "none": "malformed", "bad": "parse"}
    rows = good.where("name = 'audio'").collect()
    assert rows[0]["audio"] is None and rows[0]["created_at"] == 5 and good.where("name = 'ok'").count() == 100


def test_checkpoint_append_and_subset(spark, tmp_path):
    rows = spark.createDataFrame([("c", "p", "s", "male", 5)], "client_id string, path string, sentence string, gender string, duration_ms long")
    W.write_subset(rows, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t"))
    assert tuple(back.first()) == ("c", "p", "s", "male", "5")
    for _ in range(2):
        W.append_observations(rows, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_ingest_resumes_without_doubling(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    obs = "audio_path string, seq int, ts timestamp, f1 double"
    one = spark.sql("SELECT 'a' AS audio_path, 0 AS seq, timestamp'2024-01-01 00:00:00' AS ts, 1.0D AS f1")
    for _ in range(2):  # the second run brings a retry of the same observation
        one.write.mode("append").json(src)
        G.ingest_observations(spark.readStream.schema(obs).json(src), store, ck).awaitTermination()
    assert spark.read.parquet(store).count() == 1


def test_event_store(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT 1L AS task_id, timestamp'2024-01-02 00:00:00' AS ts, 'queue' AS type, 0 AS pct").write.json(src)
    G.store_events(G.read_progress(spark, src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert got["task_id"] == 1 and str(got["date"]) == "2024-01-02"
    assert SC.PROGRESS.fieldNames()[0] == "task_id"


def test_result_files_missing_broken_and_empty(spark, tmp_path):
    texts = {"a b": '{"phones":[{"phoneme":"a"}],"medianResonance":0.25}', "c": "{oops", "d": '{"phones":[]}', "e": "\n", "é": '{"phones":[{"phoneme":"x"}]}\n'}
    for name, text in {**texts, "none": ""}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    (tmp_path / "other.txt").write_text("not a result")
    m = spark.createDataFrame([(k,) for k in [*texts, "gone", "none"]], "spk string")
    got = {r.spk: (r.reason, r.result and r.result.medianResonance) for r in R.join_results(m, R.read_results(spark, str(tmp_path), "spk"), "spk", "raw").collect()}
    assert got["a b"] == (None, 0.25) and got["é"][0] is None
    assert [got[k][0] for k in ("c", "d", "e", "gone", "none")] == ["json decode", "zero phones", "json decode", "no raw json", "no raw json"] and len(got) == 7


def test_variants_are_shifted_and_scored_apart(spark):
    from voxrill.operators import audit as AU

    phones = spark.createDataFrame([(7, 100.0, 500.0, None, 2500.0)], "recording_id long, f0 double, f1 double, f2 double, f3 double")
    got = {r.variant: r for r in AU.shifted_phones(phones).collect()}
    assert len(got) == 6 and len({r.recording_id for r in got.values()}) == 6 and {r.source_id for r in got.values()} == {7}
    assert got["V1"].f0 == pytest.approx(125.992105) and got["V1"].f1 == 500.0
    assert got["V4"].f3 == pytest.approx(2500 / 1.2) and got["V4"].f2 is None and got["V3"].f1 == 600.0
