"""Keyed state of task progress: current states, bounded replay and queue waits, kept per task between triggers.

Each operator is a processor of ``transformWithStateInPandas``. Events are first reduced inside every Arrow
batch to what the state needs of them (``mapInPandas``), so a task that sends a third of all events sends few
rows into its group. State goes when a task's time is up: with ``clock="event"`` a timer fires once the
watermark passes the last event by the time to live, with ``clock="processing"`` the state store drops the
value that long after its last update (such a stream keeps triggering, so it is for queries that run on, not
for ones that end with what is available). A late event counts as long as its batch holds one that is not late.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxrill.streaming.progress import EVENTS_KEPT, EVENTS_TTL_S, STATE_OF_TYPE

FINAL = ("SUCCESS", "FAILURE")
_MODES = {"event": "EventTime", "processing": "ProcessingTime"}


class _Expiring(StatefulProcessor):
    """State that is forgotten ``ttl_s`` after a task's last event, by a timer or by the store itself."""

    def __init__(self, ttl_s: int, clock: str):
        if clock not in _MODES:
            raise ValueError(f"clock is one of {sorted(_MODES)}")
        self.ttl_s, self.clock = ttl_s, clock

    def _ttl(self) -> int | None:
        return self.ttl_s * 1000 if self.clock == "processing" else None

    def _touch(self, last_us: int) -> None:
        """The one timer of a task is moved behind its last event."""
        if self.clock == "event":
            due = last_us // 1000 + self.ttl_s * 1000
            for t in list(self.handle.listTimers()):
                if t != due:
                    self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass


def _in_batches(events: DataFrame, reduce_: Callable[[pd.DataFrame], pd.DataFrame], schema: str, late: str) -> DataFrame:
    """``events`` reduced batch by batch; the watermark follows the newest event that a reduced row stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield reduce_(b)

    return events.mapInPandas(run, schema).withWatermark("ts", late)


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


# --- current state -----------------------------------------------------------------------

_PARTS = ["final", "final_us", "latest", "latest_us", "last_us", "events"]
_PARTIAL = "task_id long, final string, final_us long, latest string, latest_us long, last_us long, events long, ts timestamp"


def merge_states(a: tuple | None, b: tuple) -> tuple:
    """Of two partial states (see ``_PARTS``): the earliest final state, the latest other one, the last time; in any order."""
    if a is None:
        return b
    final = min(((p[1], p[0]) for p in (a, b) if p[0] is not None), default=(0, None))
    latest = max(((p[3], p[2]) for p in (a, b) if p[2] is not None), default=(0, None))
    return final[1], final[0], latest[1], latest[0], max(a[4], b[4]), a[5] + b[5]


def partial_states(b: pd.DataFrame) -> pd.DataFrame:
    """One partial state for every task of a batch of events (task_id, ts, type)."""
    us, s = _micros(b["ts"]), b["type"].map(STATE_OF_TYPE)
    rows = pd.DataFrame({"task_id": b["task_id"], "us": us, "s": s})
    per = rows.groupby("task_id", dropna=False).agg(last_us=("us", "max"), events=("us", "size"))
    ordered = rows.dropna(subset=["s"]).sort_values(["us", "s"])
    ends = ordered["s"].isin(FINAL)
    first = ordered[ends].groupby("task_id", dropna=False).first()
    last = ordered[~ends].groupby("task_id", dropna=False).last()
    out = per.join(first.rename(columns={"s": "final", "us": "final_us"})).join(last.rename(columns={"s": "latest", "us": "latest_us"})).reset_index()
    for c in ("final_us", "latest_us"):
        out[c] = out[c].fillna(0).astype("int64")
    for c in ("final", "latest"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    out["ts"] = pd.to_datetime(out["last_us"], unit="us")
    return out[["task_id", *_PARTS, "ts"]]


class TaskStates(_Expiring):
    """PENDING, STARTED and the first final state of each task, from partial states in any order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "final string, final_us long, latest string, latest_us long, last_us long, events long", self._ttl())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        for b in rows:
            for part in b[_PARTS].itertuples(index=False, name=None):
                final, final_us, latest, latest_us, last_us, events = part
                now = merge_states(now, (final or None, int(final_us), latest or None, int(latest_us), int(last_us), int(events)))
        self.state.update(now)
        self._touch(now[4])
        yield pd.DataFrame({"task_id": [key[0]], "state": [now[0] or now[2]], "last_ms": [now[4] // 1000], "events": [now[5]], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            now = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"task_id": [key[0]], "state": [now[0] or now[2]], "last_ms": [now[4] // 1000], "events": [now[5]], "expired": [True]})


def task_states(events: DataFrame, late: str = "10 minutes", ttl_s: int = EVENTS_TTL_S, clock: str = "event") -> DataFrame:
    """Stream of (task_id, state, last_ms, events, expired): each task's state after every trigger that concerns it."""
    parts = _in_batches(events.select(F.col("task_id").cast("long"), F.col("ts"), F.col("type")), partial_states, _PARTIAL, late)
    return parts.groupBy("task_id").transformWithStateInPandas(
        TaskStates(ttl_s, clock), "task_id long, state string, last_ms long, events long, expired boolean", "Update", _MODES[clock])


# --- replay ------------------------------------------------------------------------------

_EVENT = "us long, event_id long, type string, msg_params string"


def newest(b: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The newest ``keep`` events of every task of a batch, each with the batch's last time of its task."""
    rows = pd.DataFrame({"task_id": b["task_id"], "us": _micros(b["ts"]), "event_id": b["event_id"], "type": b["type"], "msg_params": b["msg_params"], "ts": b["ts"]})
    return rows.sort_values(["us", "event_id"]).groupby("task_id", dropna=False).tail(keep)


class Replay(_Expiring):
    """The newest events of each task in a list state of bounded length."""

    def __init__(self, keep: int, ttl_s: int, clock: str):
        super().__init__(ttl_s, clock)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.events = handle.getListState("events", _EVENT, self._ttl())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        for b in rows:
            new = b[["us", "event_id", "type", "msg_params"]].itertuples(index=False, name=None)
            kept += [(int(us), int(i), t, None if p is None or p != p else p) for us, i, t, p in new]
            # Cut after every batch: the list never grows past what is kept and one batch.
            kept = sorted(kept, key=lambda e: e[:2])[-self.keep:]
        self.events.put(kept)
        self._touch(kept[-1][0])
        yield pd.DataFrame({
            "task_id": key[0], "event_id": [e[1] for e in kept], "us": [e[0] for e in kept], "type": [e[2] for e in kept],
            "msg_params": [e[3] for e in kept], "last_us": kept[-1][0],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.events.exists():
            self.events.clear()
            none = pd.Series([None], dtype="Int64")
            yield pd.DataFrame({"task_id": [key[0]], "event_id": none, "us": none, "type": [None], "msg_params": [None], "last_us": none})


def replay(events: DataFrame, late: str = "10 minutes", keep: int = EVENTS_KEPT, ttl_s: int = EVENTS_TTL_S, clock: str = "event") -> DataFrame:
    """Stream of (task_id, event_id, us, type, msg_params, last_us): after each trigger the newest events of its tasks.

    A task whose time has run out has one row without an event.
    """
    given = events.select(F.col("task_id").cast("long"), "ts", F.col("event_id").cast("long"), "type", F.col("msg_params").cast("string"))
    new = _in_batches(given, lambda b: newest(b, keep), f"task_id long, {_EVENT}, ts timestamp", late)
    return new.groupBy("task_id").transformWithStateInPandas(
        Replay(keep, ttl_s, clock), "task_id long, event_id long, us long, type string, msg_params string, last_us long", "Update", _MODES[clock])


def latest_replay(written: DataFrame, now, ttl_s: int = EVENTS_TTL_S) -> DataFrame:
    """What a subscriber gets of a drained ``replay`` stream: the last trigger's events of every task that is still alive at ``now``."""
    last = written.groupBy("task_id").agg(F.max("epoch").alias("epoch"))
    alive = F.timestamp_diff("SECOND", F.timestamp_micros("last_us"), now) <= ttl_s
    return written.join(last, ["task_id", "epoch"]).where(F.col("event_id").isNotNull() & alive).drop("epoch", "last_us")


# --- queue waits -------------------------------------------------------------------------


def pair_waits(enqueued: list[tuple[int, int]], dequeued: list[int], limit_us: int, sure_us: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """(new pairs, enqueues that are not settled, dequeues that may still be needed).

    ``enqueued`` holds (time, time of the dequeue told so far or -1). An enqueue pairs with the first dequeue
    at or after it, within the limit. A pair is told as soon as it is known and again if an earlier dequeue
    turns up; it is settled once the watermark, ``sure_us``, has passed its dequeue or the limit.
    """
    dequeued = sorted(dequeued)
    pairs, open_ = [], []
    for t0, told in sorted(enqueued):
        k = bisect_left(dequeued, t0)
        best = dequeued[k] if k < len(dequeued) and dequeued[k] - t0 <= limit_us else -1
        if told >= 0 and (best < 0 or told < best):
            best = told
        if best != told:
            pairs.append((t0, best))
        if (best if best >= 0 else t0 + limit_us) >= sure_us:
            open_.append((t0, best))
    # A dequeue is of use to enqueues that wait, and to those that have yet to arrive: not before the watermark.
    oldest = min([*(t0 for t0, _ in open_), sure_us])
    return pairs, open_, dequeued[bisect_left(dequeued, oldest):]


class QueueWaits(StatefulProcessor):
    """Open enqueues and dequeues of each task in list states; a timer settles them as the watermark passes."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.enqueued = handle.getListState("enqueued", "us long, told long")
        self.dequeued = handle.getListState("dequeued", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        enqueued, dequeued = [], []
        for b in rows:
            enqueued += [(int(us), -1) for us in b.loc[b["enqueue"], "us"]]
            dequeued += [int(us) for us in b.loc[~b["enqueue"], "us"]]
        yield from self._settle(key, timerValues, enqueued, dequeued)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues, [], [])

    def _settle(self, key, timerValues, enqueued: list, dequeued: list) -> Iterator[pd.DataFrame]:
        enqueued += [tuple(e) for e in self.enqueued.get()] if self.enqueued.exists() else []
        dequeued += [e[0] for e in self.dequeued.get()] if self.dequeued.exists() else []
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        pairs, waiting, left = pair_waits(enqueued, dequeued, self.limit_us, sure)
        for state, rows in ((self.enqueued, waiting), (self.dequeued, [(u,) for u in left])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # The next time that something is settled: a dequeue told, a limit reached, or a dequeue of no more use.
        due = [*(best if best >= 0 else t0 + self.limit_us for t0, best in waiting), *left]
        if due:
            self.handle.registerTimer(max(sure, min(due)) // 1000 + 1)
        if pairs:
            yield pd.DataFrame({"task_id": key[0], "t0_us": [a for a, _ in pairs], "wait_us": [b - a for a, b in pairs]})

    def close(self) -> None:
        pass


def queue_waits(events: DataFrame, limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream of (task_id, t0_us, wait_us): of every enqueue (type queue) the time to its first dequeue (type result).

    An enqueue has one row, and a further, smaller one if an earlier dequeue arrives late; it is never
    paired with every dequeue of its task.
    """
    limit_us = int(pd.Timedelta(limit).total_seconds() * 1e6)
    e = events.withWatermark("ts", late).where(F.col("type").isin("queue", "result"))
    rows = e.select(F.col("task_id").cast("long"), F.unix_micros("ts").alias("us"), (F.col("type") == "queue").alias("enqueue"), "ts")
    return rows.groupBy("task_id").transformWithStateInPandas(QueueWaits(limit_us), "task_id long, t0_us long, wait_us long", "Update", "EventTime")


def smallest_waits(written: DataFrame) -> DataFrame:
    """Of a drained ``queue_waits`` stream the wait of each enqueue."""
    return written.groupBy("task_id", "t0_us").agg(F.min("wait_us").alias("wait_us"))
