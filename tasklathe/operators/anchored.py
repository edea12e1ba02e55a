"""Windows anchored at the first arrival: a window opens at the first row that
is not in one, and closes ``width`` later.

Where a window starts depends on all before it, so a key is a chain.  Rows are
range-partitioned by (key, time) and checkpointed, which fixes partition
numbers.  A partition's first key may continue from the partition before; for
it alone the start isn't known.  A first pass therefore sums up each leading
run as a step function (time at which the next window may open -> the same at
the end of the run), the driver follows these functions from partition to
partition, holding one at a time, and a second pass labels the rows.  A key
with a third of all rows is labelled by a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklathe.shared import shared_dir, written

FREE = -(2**63)


def starts_of(t: np.ndarray, width: int, opens: int = FREE) -> np.ndarray:
    """Starts of the windows over ascending times, the first of which may open at ``opens``."""
    out = []
    i = int(np.searchsorted(t, opens, "left")) if opens > FREE else 0
    while i < len(t):
        out.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + width, "left"))
    return np.array(out, np.int64)


def window_starts(t: np.ndarray, width: int, opens: int = FREE) -> np.ndarray:
    """The start of every row's window; rows before ``opens`` are in the window that closes then."""
    s = starts_of(t, width, opens)
    if opens > FREE:
        s = np.append(opens - width, s)
    return s[np.searchsorted(s, t, "right") - 1]


def step_function(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For a run of ascending times: (ends, outs); windows that may open at x leave outs[j], j the first with ends[j] >= x, or x itself."""
    nxt = np.searchsorted(t, t + width, "left")
    # the last window of the chain that begins at each row, by doubling the steps
    last = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while len(t) and (last[last] != last).any():
        last = last[last]
    out = t[last] + width
    edge = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return t[edge], out[edge]


def _runs(table: pa.Table) -> tuple[list[tuple[int, int]], list[str]]:
    keys = table.column("_g").combine_chunks().dictionary_encode()
    codes = keys.indices.to_numpy()
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    bounds = list(zip(edges.tolist(), np.append(edges[1:], len(codes)).tolist()))
    return bounds, [keys.dictionary[int(codes[a])].as_py() for a, _ in bounds]


def _summary(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from pyspark.taskcontext import TaskContext

    some = [b for b in batches if b.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    t = table.column("_t").to_numpy()
    bounds, keys = _runs(table)
    ends, outs = step_function(t[bounds[0][0] : bounds[0][1]], width)
    a, b = bounds[-1]
    final = int(starts_of(t[a:b], width)[-1]) + width
    row = [[TaskContext.get().partitionId()], [keys[0]], [keys[-1]], [len(keys) == 1], [ends], [outs], [final]]
    types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, types)], ["pid", "first", "last", "single", "ends", "outs", "final"])


def _label(batches: Iterator[pa.RecordBatch], width: int, opens: dict[int, int]) -> Iterator[pa.RecordBatch]:
    from pyspark.taskcontext import TaskContext

    some = [b for b in batches if b.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    t = table.column("_t").to_numpy()
    w0 = np.empty(len(t), np.int64)
    for k, (a, b) in enumerate(_runs(table)[0]):
        w0[a:b] = window_starts(t[a:b], width, opens.get(TaskContext.get().partitionId(), FREE) if k == 0 else FREE)
    yield from table.drop_columns(["_g", "_t"]).append_column("w0", pa.array(w0)).to_batches(max_chunksize=10_000)


def anchored_windows(df: DataFrame, keys: list[str], time: Column, order: list[str], width: int) -> DataFrame:
    """``df`` with ``w0``, the start of each row's window, in the unit of ``time`` (an integer).

    A row at ``w0 + width`` or later opens the next window.  Null keys share
    their windows; rows with a null time are left out.  ``width`` must be
    positive.  Rows with equal times are in the same window, so ``order`` only
    fixes the order in which they are laid out.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    named = df.withColumns({"_g": F.to_json(F.struct(*keys)), "_t": time.cast("bigint")}).filter("_t is not null")
    laid = named.repartitionByRange("_g", "_t", *order).sortWithinPartitions("_g", "_t", *order).checkpoint()
    kinds = "pid int, first string, last string, single boolean, ends array<bigint>, outs array<bigint>, final bigint"
    states = written(laid.select("_g", "_t").mapInArrow(lambda it: _summary(it, width), kinds), "chain")
    opens: dict[int, int] = {}
    held, at = None, FREE
    for r in states.orderBy("pid").toLocalIterator():
        x = at if r["first"] == held else FREE
        if x > FREE:
            opens[r["pid"]] = x
        j = int(np.searchsorted(r["ends"], x, "left")) if x > FREE else 0
        at = (r["outs"][j] if j < len(r["ends"]) else x) if r["single"] else r["final"]
        held = r["last"]
    schema = T.StructType([*df.schema.fields, T.StructField("w0", T.LongType())])
    return laid.mapInArrow(lambda it: _label(it, width, opens), schema)
