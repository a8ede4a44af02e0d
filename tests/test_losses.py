"""Rows, states and dates that must not get lost; how often timeline rows are exchanged."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from voxrill import session
from voxrill.operators import audit as AU
from voxrill.operators import history as H
from voxrill.operators import ordered as O
from voxrill.operators import phones as P
from voxrill.operators import sequence as Q
from voxrill.sources import readers as R
from voxrill.sources import writers as W
from voxrill.streaming import progress as G
from voxrill.streaming import state as ST


def test_bundles_many_to_a_file(spark, tmp_path):
    rows = [(f"s{i}", ["fr-FR", "zh-CN"][i % 2], "FM"[i % 2], f"/x/{i}.wav", "text", "p", 1.0) for i in range(12)]
    m = spark.createDataFrame(rows, "session_id string, lang string, sex string, wav string, transcript string, spk_id string, duration_sec double").coalesce(1)
    r = m.select("session_id", F.struct(F.lit(200.0).alias("median_pitch_hz"), F.lit(0.5).alias("median_resonance")).alias("engine_c"))
    W.write_bundles(W.bundle(m, r, "session_id", F.lit(1).cast("long"), F.lit("2024-01-01T00:00:00Z")), str(tmp_path / "b"))
    got = R.read_bundles(spark, str(tmp_path / "b"), "lines").select("calibration_meta.session_id", "lang", "sex").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[1], r[2]) for r in rows)
    with pytest.raises(ValueError):
        R.read_bundles(spark, str(tmp_path), "other")


def test_folder_gives_language_where_the_document_does_not(spark, tmp_path):
    f = tmp_path / "part_lang=fr-FR" / "part_sex=F"
    f.mkdir(parents=True)
    (f / "a.json").write_text('{"export_schema_version":"1"}\n{"export_schema_version":"1"}\n')
    assert [tuple(r) for r in R.read_bundles(spark, str(tmp_path), "lines").select("lang", "sex").collect()] == [("fr-FR", "F")] * 2


def _states(spark, path):
    out = G.drain(ST.task_states(G.read_progress(spark, path), late="1 day"), "states", "update")
    return {r.task_id: r.state for r in out.groupBy("task_id").agg(F.max_by("state", "epoch").alias("state")).collect()}


def test_stream_state_does_not_depend_on_arrival(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(milliseconds=2 * i), "progress") for i in range(30_000)]
    rows[29_750] = (1, start + dt.timedelta(seconds=59.5), "result")
    rows.append((1, start + dt.timedelta(seconds=1), "error"))  # arrives last, happened first
    rows += [(2, start, "queue"), (2, start + dt.timedelta(seconds=1), "progress")]
    df = spark.createDataFrame(rows, "task_id long, ts timestamp, type string").coalesce(1)
    df.write.json(str(tmp_path / "ev"))
    batch = {r.task_id: r.state for r in G.task_states(df).collect()}
    assert batch == _states(spark, str(tmp_path / "ev")) == {1: "FAILURE", 2: "STARTED"}


def test_phones_of_unknown_time_keep_the_word_before(spark):
    phones = spark.createDataFrame([(1, 0, 0.5, "a"), (1, 1, 1.5, "b"), (1, 2, None, "c"), (1, 3, 3.0, "d"), (1, 4, None, "e")], "rec long, seq int, t double, phone string")
    words = spark.createDataFrame([(1, 1.0, "w1"), (1, 2.5, "w2")], "rec long, t double, word string")
    timed = P.known_times(phones, ["rec"], ["seq"], F.floor(F.col("seq") / 2), "t")
    items = timed.where("t IS NOT NULL").select("rec", "t", F.lit(True).alias("is_phone"), "seq", "phone", F.lit(False).alias("is_word"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("word_time"))
    items = items.unionByName(words.select("rec", "t", F.lit(False).alias("is_phone"), F.lit(-1).alias("seq"), F.lit(None).cast("string").alias("phone"), F.lit(True).alias("is_word"), "word", F.col("t").alias("word_time")))
    got = P.attach_words(items, ["rec"], ["t", "is_phone", "seq"], F.floor(F.col("t"))).select("phone", "word", "nth").collect()
    assert sorted(map(tuple, got)) == [("b", "w1", 0), ("c", "w1", 1), ("d", "w2", 0), ("e", "w2", 1)]


def test_items_of_unknown_start_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, 2.0)], "rec long, seq int, start double")
    got = Q.phone_ends(df, ["rec"], ["seq"], F.lit(0)).collect()
    assert sorted((r.start, r.end) for r in got) == [(0.5, 0.6), (2.0, 2.1)]


def test_bad_export_date_counts_as_none(spark):
    doc = json.dumps({"export_schema_version": "1", "exported_at": "yesterday", "payload": {"sessions": [{"summary": {}, "analysis": []}]}})
    good, bad = R.check_imports(spark.createDataFrame([("a", doc)], "name string, text string"), "text", "name")
    assert bad.count() == 0 and good.count() == 1


def test_sessions_with_text_ids(spark):
    rows = [("u", "en", f"s{i}", i * 10, "custom", ["a", "b", "c", f"x{i % 2}"]) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id string, language string, session_id string, created_at long, script_id string, tokens array<string>")
    got = {r.session_id: r.prior_id for r in H.prior_attempt(df, ["user_id"], F.floor(F.col("created_at") / 20)).collect()}
    assert got == {"s0": None, "s1": None, "s2": "s0", "s3": "s1", "s4": "s2", "s5": "s3"}


def test_exports_are_numbered(spark):
    rows = [("k", i, f"f{i}") for i in range(25)] + [("m", 0, "g")]
    s = spark.createDataFrame(rows, "key string, idx int, filename string").select("*", F.lit(1).alias("summary"), F.lit(2).alias("analysis"), F.lit(3).alias("created_at"))
    got = W.export_payload(s, "key", F.floor(F.col("idx") / 4), 10).select("key", "file_no", F.size("payload.sessions").alias("n"), F.col("payload.sessions")[0]["filename"].alias("first")).collect()
    assert sorted(map(tuple, got)) == [("k", 0, 10, "f0"), ("k", 1, 10, "f10"), ("k", 2, 5, "f20"), ("m", 0, 1, "g")]


def test_missing_variant_fails(spark):
    runs = spark.createDataFrame([("zh", "V0", 200.0, 0.5), ("zh", "V0p", 200.1, 0.5)], "lang string, variant string, f0 double, score double")
    r = AU.compare_variants(runs).collect()[0]
    assert r["repeatable"] is True and (r["pitch_direction"], r["formant_direction"], r["formant_amplitude"]) == (False, False, False)


def test_no_private_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session(), "x")


def test_rows_are_exchanged_once(spark, capsys):
    """One exchange carries the rows' own columns, that of the window; the stitching join adds none."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 5).alias("rec"), F.col("id").alias("t"), F.col("id").cast("string").alias("payload"))
        for out in (
            O.neighbours(df, ["rec"], ["t"], F.floor(F.col("t") / 100), next={"n": F.col("t")}),
            O.scan(df, ["rec"], ["t"], F.floor(F.col("t") / 100), sums={"s": F.col("t")}),
        ):
            out.explain("formatted")
            carried = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
            assert len([x for x in carried if "payload" in x]) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
