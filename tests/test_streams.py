"""Keyed state over several triggers and restarts: states, replay, waits and growing statistics against plain versions."""

import datetime as dt
import json
import os
import random
import statistics
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrill.streaming import ingest as I
from voxrill.streaming import progress as G
from voxrill.streaming import state as ST

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return (START + dt.timedelta(seconds=seconds)).isoformat(timespec="microseconds")


def put(folder, number, events):
    """One file of (task_id, seconds, type, event_id); files are read in order of their time."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:03d}.json"
    with open(path, "w") as f:
        f.writelines(json.dumps({"task_id": t, "ts": at(s), "type": k, "event_id": i}) + "\n" for t, s, k, i in events)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


KIND = "task_id long, ts timestamp, type string, event_id long, msg_params string"


def stream(spark, src, files=1):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", files).json(src)


def newest(out, *cols):
    last = out.groupBy("task_id").agg(F.max("epoch").alias("epoch"))
    return sorted(tuple(r[c] for c in cols) for r in out.join(last, ["task_id", "epoch"]).collect())


def test_states_over_triggers_late_events_and_expiry(spark, tmp_path):
    src, keep = str(tmp_path / "in"), str(tmp_path / "run")
    put(src, 0, [(1, 5, "progress", 0), (1, 9, "result", 1), (2, 3, "queue", 2)])
    put(src, 1, [(1, 7, "error", 3), (2, 4, "progress", 4), (3, 1, "queue", 5)])

    def run():
        s = ST.task_states(stream(spark, src), late="60 seconds", ttl_s=100)
        return G.drain(s, "states", "update", keep)

    out = run()
    assert out.select("epoch").distinct().count() >= 2
    # The error happened before the result, though it came in a later trigger.
    assert newest(out, "task_id", "state", "last_ms", "events", "expired") == [
        (1, "FAILURE", 1_704_067_209_000, 3, False), (2, "STARTED", 1_704_067_204_000, 2, False), (3, "PENDING", 1_704_067_201_000, 1, False)]
    # A restart goes on from the checkpoint: the states are still there. Then time runs out for all but task 1.
    put(src, 2, [(1, 90, "progress", 6)])
    assert newest(run(), "task_id", "state", "events") == [(1, "FAILURE", 4), (2, "STARTED", 2), (3, "PENDING", 1)]
    put(src, 3, [(4, 180, "queue", 7)])
    assert newest(run(), "task_id", "state", "expired") == [(1, "FAILURE", False), (2, "STARTED", True), (3, "PENDING", True), (4, "PENDING", False)]
    # Too late for the watermark: dropped. Not late, for a task whose state has gone: a new state.
    put(src, 4, [(5, 20, "queue", 8), (2, 190, "progress", 9)])
    got = newest(run(), "task_id", "state", "events", "expired")
    assert got == [(1, "FAILURE", 4, False), (2, "STARTED", 1, False), (3, "PENDING", 1, True), (4, "PENDING", 1, False)]


def test_states_with_a_time_to_live_of_the_store(spark, tmp_path):
    """On the clock of the cluster a stream runs on; the store itself drops what was not touched for too long."""
    src = str(tmp_path / "in")
    put(src, 0, [(1, 5, "result", 0), (None, 9, "result", 1)])
    seen = []
    q = ST.task_states(stream(spark, src), ttl_s=1, clock="processing").writeStream.outputMode("update").foreachBatch(
        lambda batch, epoch: seen.extend((r.task_id, r.state, r.events) for r in batch.collect())
    ).option("checkpointLocation", str(tmp_path / "ck")).start()

    def wait(n):
        end = time.time() + 40
        while len(seen) < n and time.time() < end:
            time.sleep(0.2)

    try:
        wait(2)
        time.sleep(1.5)
        put(src, 1, [(1, 10, "progress", 2)])
        wait(3)
    finally:
        q.stop()
    assert set(seen[:2]) == {(1, "SUCCESS", 1), (None, "SUCCESS", 1)} and seen[2:3] == [(1, "STARTED", 1)]
    with pytest.raises(ValueError):
        ST.TaskStates(10, "sundial")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["queue", "progress", "result", "error", "other"])), min_size=1, max_size=12), st.integers(0, 11))
def test_partial_states_in_any_order(events, cut):
    import pandas as pd

    def fold(parts):
        now = None
        for b in parts:
            if b:
                df = pd.DataFrame({"task_id": 1, "ts": [pd.Timestamp(START) + pd.Timedelta(seconds=s) for s, _ in b], "type": [k for _, k in b]})
                now = ST.merge_states(now, tuple(ST.partial_states(df)[ST._PARTS].iloc[0]))
        return now

    whole = fold([events])
    assert fold([events[:cut], events[cut:]]) == fold([events[cut:], events[:cut]]) == whole
    ends = sorted((s, G.STATE_OF_TYPE[k]) for s, k in events if k in ("result", "error"))
    assert whole[0] == (ends[0][1] if ends else None) and whole[5] == len(events)


def test_replay_is_bounded_and_survives_a_restart(spark, tmp_path):
    src, keep = str(tmp_path / "in"), str(tmp_path / "run")
    rng = random.Random(5)
    events = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(1000) / 10, "progress", i) for i in range(300)]
    now = F.lit(at(150)).cast("timestamp")

    def run():
        return G.drain(ST.replay(stream(spark, src), late="200 seconds", keep=20, ttl_s=90), "replay", "update", keep)

    for k in range(3):
        put(src, k, events[k * 100:(k + 1) * 100])
        seen = events[:(k + 1) * 100]
        out = run()
        assert out.groupBy("task_id", "epoch").count().agg(F.max("count")).first()[0] == 20
        want = []
        for t in (1, 2, 3):
            mine = sorted((e[1], e[3]) for e in seen if e[0] == t)
            if mine and 150 - mine[-1][0] <= 90:
                want += [(t, i) for _, i in mine[-20:]]
        assert sorted((r.task_id, r.event_id) for r in ST.latest_replay(out, now, 90).collect()) == sorted(want)
    # The watermark passes everyone's time to live: nothing is left to replay, even for a subscriber of back then.
    put(src, 3, [(9, 10_000, "queue", 999)])
    assert [r.task_id for r in ST.latest_replay(run(), F.lit(at(10_000)).cast("timestamp"), 90).collect()] == [9]
    assert ST.latest_replay(run(), now, 90).where("task_id < 9").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30)), max_size=25), st.integers(1, 10), st.integers(0, 12))
def test_pairs_in_parts_equal_pairs_at_once(events, limit, late):
    """Whatever arrives up to ``late`` behind the newest time is paired as if all had been there at once."""
    rng = random.Random(1)
    arriving = sorted(events, key=lambda e: (e[1] + rng.uniform(0, late), e[1]))
    want = {}
    for is_start, t in events:
        if is_start:
            ends = [u for s, u in events if not s and u >= t]
            if ends and min(ends) - t <= limit:
                want[t] = min(ends) - t
    told, waiting, left, top = {}, [], [], 0
    for is_start, t in arriving:
        pairs, waiting, left = ST.pair_waits(waiting + [(t, -1)] * is_start, left + [t] * (not is_start), limit, top - late)
        top = max(top, t)
        for t0, t1 in pairs:
            told[t0] = min(told.get(t0, 10**9), t1 - t0)
    pairs, waiting, left = ST.pair_waits(waiting, left, limit, top + limit + 1)
    for t0, t1 in pairs:
        told[t0] = min(told.get(t0, 10**9), t1 - t0)
    assert told == want and not waiting


def test_waits_over_triggers_and_as_a_table(spark, tmp_path):
    src = str(tmp_path / "in")
    rng = random.Random(8)
    events = [(rng.choice([1, 1, 2, 3]), k + rng.random(), rng.choice(["queue", "result", "progress"]), k) for k in range(240)]
    for k in range(4):
        put(src, k, events[k * 60:(k + 1) * 60])
    want = {}
    for t, s, kind, _ in events:
        if kind == "queue":
            ends = [u for t2, u, k2, _ in events if t2 == t and k2 == "result" and u >= s]
            if ends and min(ends) - s <= 5:
                want[t, round(s, 3)] = round(min(ends) - s, 3)
    shape = lambda rows, t0: {(r.task_id, round(t0(r), 3)): round(r.wait_us / 1e6, 3) for r in rows}
    base = START.replace(tzinfo=dt.timezone.utc).timestamp()
    out = G.drain(ST.queue_waits(stream(spark, src), "5 seconds", "20 seconds"), "waits", "update")
    assert shape(ST.smallest_waits(out).collect(), lambda r: r.t0_us / 1e6 - base) == want
    table = spark.read.schema(KIND).json(src)
    rows = G.queue_waits(table, "5 seconds", "30 seconds").withColumn("t0_us", F.unix_micros("t0")).collect()
    assert len(rows) == len(want) and shape(rows, lambda r: r.t0_us / 1e6 - base) == want


def test_statistics_grow_and_do_not_double(spark, tmp_path):
    keys = {"lang": "string", "phoneme": "string"}
    rng = random.Random(2)
    rows = [(f"a{i}", 0, START + dt.timedelta(seconds=i), rng.choice(["en", None]), rng.choice("xyz"), 1e6 + rng.random(), rng.choice([None, rng.gauss(0, 3)]), 5.0, None) for i in range(400)]
    schema = "audio_path string, seq int, ts timestamp, lang string, phoneme string, f0 double, f1 double, f2 double, f3 double"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        df.where(F.col("audio_path").substr(2, 9).cast("int") % 4 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    # One file once more: its rows are known already.
    df.where(F.col("audio_path").substr(2, 9).cast("int") % 4 == 2).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    store = I.MomentStore(spark, str(tmp_path / "store"), keys)
    rows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    I.ingest_moments(rows_in, store, str(tmp_path / "ck")).awaitTermination()

    def check(rows):
        groups = {}
        for r in rows:
            for f, v in enumerate(r[5:]):
                if v is not None:
                    groups.setdefault((r[3], r[4], f), []).append(v)
        got = {(r.lang, r.phoneme, r.formant): r for r in I.statistics(store.read()).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert (got[k].n, got[k].max, got[k].min) == (len(v), max(v), min(v))
            assert got[k].mean == pytest.approx(statistics.fmean(v), rel=1e-12)
            if len(v) > 1:
                assert got[k].stdev == pytest.approx(statistics.stdev(v), rel=1e-6, abs=1e-12)

    check(rows)
    assert store.read().select("version").distinct().count() >= 3
    # A trigger that is run again writes its version as before.
    epoch = store.read().agg(F.max("version")).first()[0] + 1
    more = [(f"b{i}", 0, START, "en", "x", float(i), None, None, None) for i in range(10)]
    for _ in range(2):
        store.add(spark.createDataFrame(more, schema), epoch)
        check(rows + more)
