"""Stateful streaming forms of compaction, batching, delays, quotas and completion.

Each mirrors its batch operator row for row.  Rows of a micro-batch are put in
arrival order (time, offset) and windows are closed inline; timers only flush
keys that have gone idle, because within a batch they fire after its rows.
Event time and processing time both work; with event time give the stream a
watermark first (``with_event_time``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, as these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(df: DataFrame, millis: str, delay: str = "0 seconds", name: str = "event_time") -> DataFrame:
    """``df`` with a timestamp of its epoch milliseconds and a watermark on it."""
    return df.withColumn(name, F.timestamp_millis(millis)).withWatermark(name, delay)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A micro-batch's rows of a key in order; rows without time or offset are left out."""
    pdf = pd.concat(list(rows))
    return pdf.dropna(subset=["t", "o"]).sort_values(list(by), kind="stable")


class Compaction(StatefulProcessor):
    """One survivor per window of a key: (k, w0, n, o, t). Rows have k, t, o, v; pick is latest, first or max (of v)."""

    schema = "k string, w0 bigint, n bigint, o bigint, t bigint"

    def __init__(self, linger: int, pick: str = "latest"):
        self.linger, self.pick = linger, pick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "w0 bigint, n bigint, o bigint, t bigint, v double")

    def _better(self, s: list, o: int, v: float) -> bool:
        if self.pick == "first":
            return False
        if self.pick == "latest":
            return True
        return v >= s[4] or s[4] != s[4]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "t", "o")
        s = list(self.state.get()) if self.state.exists() else None
        out = []
        for t, o, v in zip(pdf["t"], pdf["o"], pdf["v"]):
            t, o, v = int(t), int(o), float(v) if v is not None else float("nan")
            if s is None or t >= s[0] + self.linger:
                if s is not None:
                    out.append((key[0], s[0], s[1], s[2], s[3]))
                s = [t, 1, o, t, v]
            else:
                s[1] += 1
                if self._better(s, o, v):
                    s[2:] = [o, t, v]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s is not None:
            self.state.update(tuple(s))
            self.handle.registerTimer(max(s[0] + self.linger, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["k", "w0", "n", "o", "t"])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            s = self.state.get()
            out.append((key[0], s[0], s[1], s[2], s[3]))
            self.state.clear()
        yield pd.DataFrame(out, columns=["k", "w0", "n", "o", "t"])

    def close(self) -> None:
        pass


class Batching(StatefulProcessor):
    """Batches of a scope: (p, tick, batch_no, size, first_offset, last_offset, full), emitted by the arrival after them or by the tick's end.

    Numbers of a tick go on where a late row finds it closed; they are kept for
    the KEPT ticks before the newest one.
    """

    KEPT = 1000

    schema = "p int, tick bigint, batch_no bigint, size bigint, first_offset bigint, last_offset bigint, full boolean"
    names = ["p", "tick", "batch_no", "size", "first_offset", "last_offset", "full"]

    def __init__(self, capacity: int, linger: int):
        self.capacity, self.linger = capacity, linger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "tick bigint, batch_no bigint, size bigint, first bigint, last bigint")
        self.numbers = handle.getMapState("numbers", "tick bigint", "next bigint")

    def _next(self, tick: int) -> int:
        if self.numbers.containsKey((tick,)):
            return self.numbers.getValue((tick,))[0]
        for (old,) in [k for k in self.numbers.keys() if k[0] <= tick - self.KEPT]:
            self.numbers.removeKey((old,))
        return 0

    def _row(self, key: Any, s: tuple) -> tuple:
        return (key[0], s[0], s[1], s[2], s[3], s[4], s[2] == self.capacity)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "o")
        s = list(self.state.get()) if self.state.exists() else None
        out = []
        for t, o in zip(pdf["t"], pdf["o"]):
            tick, o = int(t) // self.linger, int(o)
            if s is None or tick != s[0] or s[2] >= self.capacity:
                if s is not None:
                    out.append(self._row(key, s))
                    self.numbers.updateValue((s[0],), (s[1] + 1,))
                s = [tick, self._next(tick), 1, o, o]
            else:
                s[2], s[4] = s[2] + 1, o
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s is not None:
            self.state.update(tuple(s))
            self.handle.registerTimer(max((s[0] + 1) * self.linger, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            s = self.state.get()
            out.append(self._row(key, s))
            self.numbers.updateValue((s[0],), (s[1] + 1,))
            self.state.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class Delay(StatefulProcessor):
    """Holds tasks (k, o, t, scheduled) until their scheduled time; those without one, or whose time has come, pass at once.

    Unlike a lane that sleeps, a held task does not block the ones behind it.
    """

    schema = "k string, o bigint, t bigint, scheduled bigint"
    names = ["k", "o", "t", "scheduled"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "o bigint, t bigint, scheduled bigint")

    def _now(self, timerValues) -> int:
        return max(timerValues.getCurrentWatermarkInMs(), timerValues.getCurrentProcessingTimeInMs() if self.by_clock else -(2**62))

    def __init__(self, by_clock: bool = False):
        self.by_clock = by_clock

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out, keep = self._now(timerValues), [], []
        for pdf in rows:
            pdf = pdf.dropna(subset=["t", "o"])
            for o, t, at in zip(pdf["o"], pdf["t"], pdf["scheduled"]):
                at = int(at) if at == at and at is not None else 0
                if at <= max(now, int(t)):
                    out.append((key[0], int(o), int(t), at))
                else:
                    keep.append((int(o), int(t), at))
        for k in keep:
            self.held.appendValue(k)
            self.handle.registerTimer(k[2])
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.held.get()) if self.held.exists() else []
        out = [(key[0], *r) for r in rows if r[2] <= due]
        rest = [tuple(r) for r in rows if r[2] > due]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class KeyStat(StatefulProcessor):
    """Per-key counts over a partition's current and previous window: (p, o, k, from_ms, to_ms, n). Rows have p, o, k, t.

    Counts are in map state, one entry per window slot and key; only keys of
    the micro-batch are read.
    """

    schema = "p int, o bigint, k string, from_ms bigint, to_ms bigint, n bigint"

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getValueState("windows", "cur bigint, prev bigint, slot int")
        self.counts = [handle.getMapState(f"slot{i}", "k string", "n bigint") for i in (0, 1)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "o")
        cur, prev, slot = self.windows.get() if self.windows.exists() else (None, None, 0)
        cache: list[dict] = [{}, {}]
        dropped = [False, False]

        def count(i: int, k: str) -> int:
            if k not in cache[i]:
                got = None if dropped[i] or not self.counts[i].containsKey((k,)) else self.counts[i].getValue((k,))
                cache[i][k] = got[0] if got else 0
            return cache[i][k]

        out = []
        for o, k, t in zip(pdf["o"], pdf["k"], pdf["t"]):
            t = int(t)
            if cur is None:
                cur = t
            elif t - cur >= self.width:
                prev, cur, slot = cur, t, 1 - slot
                cache[slot], dropped[slot] = {}, True
            cache[slot][k] = count(slot, k) + 1
            near = prev is not None and prev >= t - 2 * self.width
            out.append((key[0], int(o), k, prev if near else cur, t, cache[slot][k] + (count(1 - slot, k) if near else 0)))
        for i in (0, 1):
            if dropped[i]:
                self.counts[i].clear()
            for k, n in cache[i].items():
                if n:
                    self.counts[i].updateValue((k,), (n,))
        if cur is not None:
            self.windows.update((cur, prev, slot))
        yield pd.DataFrame(out, columns=["p", "o", "k", "from_ms", "to_ms", "n"])

    def close(self) -> None:
        pass


class Completion(StatefulProcessor):
    """High watermark of a partition from a stream of (p, o, kind, timeout_at): kind is received or completed.

    Emits (p, high_watermark, pending) per micro-batch and when a timeout runs
    out.  A received record whose ``timeout_at`` (-1: none) has passed when it is
    at the head is given up, or with ``extend_ms`` looked at again that much
    later.  A completion that comes before its record waits for it, and nothing
    beyond it is passed meanwhile.  State is the pending records, which
    back-pressure bounds.
    """

    schema = "p int, high_watermark bigint, pending bigint"
    names = ["p", "high_watermark", "pending"]

    def __init__(self, extend_ms: int | None = None):
        self.extend_ms = extend_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "hw bigint")
        self.open = handle.getListState("open", "o bigint, received boolean, done boolean, timeout_at bigint")

    def _load(self) -> tuple[int, dict[int, list]]:
        held = {r[0]: [r[1], r[2], r[3]] for r in self.open.get()} if self.open.exists() else {}
        return (self.mark.get()[0] if self.mark.exists() else -1), held

    def _advance(self, key: Any, hw: int, held: dict[int, list], now: int) -> pd.DataFrame:
        for o in sorted(held):
            received, done, at = held[o]
            over = received and not done and 0 <= at <= now
            if over and self.extend_ms is not None:
                held[o][2], over = now + self.extend_ms, False
            if not received or not (done or over):
                break
            hw = o
            del held[o]
        self.mark.update((hw,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.open.put([(o, *x) for o, x in sorted(held.items())])
            received, done, at = held[min(held)]
            if received and not done and at >= 0:
                self.handle.registerTimer(max(at, now + 1))
        else:
            self.open.clear()
        return pd.DataFrame([(key[0], hw, sum(x[0] for x in held.values()))], columns=self.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hw, held = self._load()
        for pdf in rows:
            pdf = pdf.dropna(subset=["o"])
            for o, kind, at in zip(pdf["o"].astype("int64").tolist(), pdf["kind"], pdf["timeout_at"].fillna(-1).astype("int64").tolist()):
                if o <= hw or kind not in ("received", "completed"):
                    continue
                x = held.setdefault(o, [False, False, -1])
                if kind == "completed":
                    x[1] = True
                elif not x[0]:
                    x[0], x[2] = True, at
        yield self._advance(key, hw, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hw, held = self._load()
        yield self._advance(key, hw, held, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """Waits of a limiter per partition: (p, o, wait) in milliseconds. Rows have p, o, t; each takes one permit.

    The batch form's closed form, carried on: state is the time of the first
    row, the permits taken since, and the greatest backlog any row left.  A rate
    of 0 lets nothing pass, a negative one or one above a million never waits.
    """

    schema = "p int, o bigint, wait double"
    names = ["p", "o", "wait"]

    def __init__(self, rate: float, burst_seconds: float = 1.0):
        self.rate, self.burst = rate, burst_seconds * 1000.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "first double, taken bigint, backlog double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "o")
        if self.rate == 0 or not len(pdf):
            yield pd.DataFrame(columns=self.names)
            return
        if self.rate < 0 or self.rate > 1_000_000:
            yield pd.DataFrame([(key[0], int(o), 0.0) for o in pdf["o"]], columns=self.names)
            return
        t = pdf["t"].to_numpy(np.float64)
        first, taken, backlog = self.state.get() if self.state.exists() else (float(t[0]), 0, -1e18)
        since = t - first
        due = (taken + np.arange(len(t))) * (1000.0 / self.rate)  # when permits without a stock would come
        left = np.maximum.accumulate(np.append(backlog, since - self.burst - due))
        wait = np.maximum(0.0, np.maximum(due, due + left[:-1]) - since)
        self.state.update((first, int(taken + len(t)), float(left[-1])))
        yield pd.DataFrame({"p": key[0], "o": pdf["o"].astype("int64"), "wait": wait})

    def close(self) -> None:
        pass


def run_stateful(df: DataFrame, by: list[str], processor: StatefulProcessor, *, event_time: bool = True, mode: str = "Append") -> DataFrame:
    """``df`` through a processor, grouped by ``by``; its ``schema`` is the result's."""
    return df.groupBy(*by).transformWithStateInPandas(processor, outputStructType=processor.schema, outputMode=mode, timeMode="EventTime" if event_time else "ProcessingTime")


def routed(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that hands every micro-batch to ``write`` (see ``sources.sinks``), which must be safe to repeat."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()
