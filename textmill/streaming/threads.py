"""State of threads over a stream: an append-only list of what happened, counters with a budget, and freshness by event time.

Each thread has a list state that is only ever added to and a value state of counters. A timer in event time goes off when the
watermark has passed a thread's last event by longer than ``idle``: the thread is told closed, and its state goes, so what
is kept is bounded by the threads that were active within that time. State is kept by RocksDB, so use_rocksdb comes first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, event_id long, n_entries long, errors long, exhausted boolean, closed boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Thread(StatefulProcessor):
    """A row for each new event with the thread's counters after it, and one when the thread is closed."""

    def __init__(self, idle_ms: int, budget: int):
        self.idle_ms, self.budget = idle_ms, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "event_id long, event_type string, ts timestamp")
        self.counts = handle.getValueState("counts", "n long, errors long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, errors, last = self.counts.get() if self.counts.exists() else (0, 0, 0)
        before = last
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        new = pd.concat(frames).sort_values(["ts", "event_id"])
        out = []
        for event, kind in zip(new["event_id"], new["event_type"], strict=True):
            n += 1
            errors += kind == "error"
            out.append((int(key[0]), int(event), n, errors, errors >= self.budget, False))
        self.entries.appendList([(int(e), None if k is None else str(k), t.to_pydatetime()) for e, k, t in zip(new["event_id"], new["event_type"], new["ts"], strict=True)])
        last = max(last, int(new["ts"].max().timestamp() * 1000))
        self.counts.update((n, errors, last))
        if last != before:
            if before:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            _, errors, _ = self.counts.get()
            told = [e for e, *_ in self.entries.get()]
            self.entries.clear()
            self.counts.clear()
            yield _rows([(int(key[0]), told[-1], len(told), errors, errors >= self.budget, True)])

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def thread_log(events: DataFrame, idle: str = "30 days", budget: int = 3) -> DataFrame:
    """(user_id, event_id, n_entries, errors, exhausted, closed) for each event of a stream with a watermark on ts: how many
    entries and errors its thread has with it, and whether the budget of errors is used up; and a row with closed when a
    thread was idle for longer. For append mode. A thread that comes back after that begins anew."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", "event_type", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Thread(idle_ms, budget), OUT, "Append", "EventTime")


def thread_log_batch(events: DataFrame, budget: int = 3) -> DataFrame:
    """What thread_log has told of a whole table of threads that are never idle for too long, when it came in order."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL")
    errors = F.sum((F.col("event_type") == "error").cast("long")).over(order)
    told = rows.select("user_id", "event_id", F.count(F.lit(1)).over(order).alias("n_entries"), F.coalesce(errors, F.lit(0)).alias("errors"))
    return told.select("*", (F.col("errors") >= budget).alias("exhausted"), F.lit(False).alias("closed"))


class Run(StatefulProcessor):
    """A row for each newer run of a notebook, and one when the newest becomes too old."""

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else (-1, None)
        best = known
        for frame in rows:
            for ts, status in zip(frame["ts"], frame["status"], strict=True):
                best = max(best, (int(ts.timestamp() * 1000), status), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        if best != known:
            if known[0] >= 0 and known[0] != best[0]:
                self.handle.deleteTimer(known[0] + self.age_ms)
            self.newest.update(best)
            self.handle.registerTimer(best[0] + self.age_ms)
            yield pd.DataFrame({"name": [key[0]], "ms": [best[0]], "status": [best[1]], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            ms, status = self.newest.get()
            self.newest.clear()
            yield pd.DataFrame({"name": [key[0]], "ms": [ms], "status": [status], "stale": [True]})

    def close(self) -> None:
        pass


def run_freshness(runs: DataFrame, most: str = "90 days") -> DataFrame:
    """(name, ms, status, stale) over a stream of runs (name, ts, status) with a watermark: each newer run of a name, and a row
    with stale when the watermark has passed the newest one by longer than ``most``. For append mode."""
    age = int(pd.Timedelta(most).total_seconds() * 1000)
    rows = runs.filter("name IS NOT NULL AND ts IS NOT NULL").select("name", "ts", "status")
    return rows.groupBy("name").transformWithStateInPandas(Run(age), "name string, ms long, status string, stale boolean", "Append", "EventTime")
