"""Running a caller's processor over tasks: per-key order, concurrency inside a task of Spark, deferred completion.

A lane is a shuffle partition by key.  Inside it, keys run side by side on
threads (for processors that wait on I/O) while the tasks of one key run one
after the other, in order.  A processor is made once per Spark task from a
factory, so it may hold connections; ``close`` is called at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from threading import Lock, local
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Processor(Protocol):
    """``process`` returns the rows to hand on: None or [] for none, a dict for one, several dicts, or a future of these."""

    def process(self, row: dict[str, Any]) -> dict | Iterable[dict] | Future | None: ...

    def close(self) -> None: ...


OUTCOME = "completion string, error string"  # sync, deferred, failed or timed_out


class _Kept:
    """A processor that outlives the task; closing it is left to the worker's end."""

    def __init__(self, inner: Processor):
        self.process = inner.process

    def close(self) -> None:
        pass


def per_worker(name: str, factory: Callable[[], Processor]) -> Callable[[], Processor]:
    """A factory that makes one processor per Python worker and hands it to all its tasks (instead of one per task)."""

    def make() -> Processor:
        # looked up by import, for functions that travel by value bring copies of their globals
        import builtins

        kept = builtins.__dict__.setdefault("_tasklathe_processors", {})
        if name not in kept:
            kept[name] = factory()
        return _Kept(kept[name])

    return make


class _PerPartition:
    """Hands each row to the processor of its partition."""

    def __init__(self, column: str, factory: Callable[[], Processor]):
        self.column, self.factory, self.made = column, factory, {}
        self.lock = Lock()

    def process(self, row: dict[str, Any]):
        p = row[self.column]
        with self.lock:
            if p not in self.made:
                self.made[p] = self.factory()
        return self.made[p].process(row)

    def close(self) -> None:
        for x in self.made.values():
            x.close()


def per_partition(column: str, factory: Callable[[], Processor]) -> Callable[[], Processor]:
    """A factory of processors that live as long as a task's work on one partition of the log, named in ``column``: one per task and partition."""
    return lambda: _PerPartition(column, factory)


def per_thread(factory: Callable[[], Processor]) -> Callable[[], Processor]:
    """A factory of processors one per thread of a task; each is used by its thread alone, and closed with the task."""

    def make() -> Processor:
        held, every, lock = local(), [], Lock()

        class Own:
            def process(self, row: dict[str, Any]):
                if not hasattr(held, "it"):
                    held.it = factory()
                    with lock:
                        every.append(held.it)
                return held.it.process(row)

            def close(self) -> None:
                for x in every:
                    x.close()

        return Own()

    return make


def process(df: DataFrame, factory: Callable[[], Processor], schema: str, key: str, order: list[str], *, lanes: int | None = None, threads: int = 1, timeout_ms: int = -1) -> DataFrame:
    """Rows that the processor hands on, with ``completion`` and ``error``.

    A failing task doesn't fail its neighbours: it leaves one row with nulls,
    completion ``failed`` and the error.  A future that isn't done within
    ``timeout_ms`` (-1: wait) is given up as ``timed_out``.  A task that hands on
    nothing leaves no row.  Rows with a null key are spread by their order
    columns and have no order among themselves.  ``lanes`` bounds
    the parallelism (None: the session's shuffle partitions).
    """
    # a null key's lane follows from the row itself, so that a task run again gets the same rows
    by = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.xxhash64(*order).cast("string")))
    laid = df.withColumn("_lane_key", by)
    laid = (laid.repartition(lanes, "_lane_key") if lanes else laid.repartition("_lane_key")).sortWithinPartitions("_lane_key", *order)
    out = T.StructType.fromDDL(f"{schema}, {OUTCOME}")
    names = out.names

    def run_key(processor: Processor, rows: list[dict]) -> list[dict]:
        done = []
        for r in rows:
            how = "sync"
            try:
                got = processor.process(r)
                if isinstance(got, Future):
                    how = "deferred"
                    got = got.result(None if timeout_ms < 0 else timeout_ms / 1000)
                got = [] if got is None else [got] if isinstance(got, dict) else list(got)
                done += [{**g, "completion": how, "error": None} for g in got]
            except FutureTimeout:
                done.append({"completion": "timed_out", "error": "timed out"})
            except Exception as e:
                done.append({"completion": "failed", "error": f"{type(e).__name__}: {e}"})
        return done

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processor = factory()
        try:
            with ThreadPoolExecutor(threads) as pool:
                for pdf in pdfs:
                    groups: dict[str, list[dict]] = {}
                    for r in pdf.to_dict("records"):
                        groups.setdefault(r.pop("_lane_key"), []).append(r)
                    parts = list(pool.map(lambda rows: run_key(processor, rows), groups.values()))
                    yield pd.DataFrame([r for p in parts for r in p], columns=names)
        finally:
            processor.close()

    return laid.mapInPandas(run, out)
