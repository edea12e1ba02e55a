"""Most frequent items among billions, by a hierarchical count-sketch.

An item is known by the 64 bits of its hash.  For prefixes of 8, 16, 24 and 32
of these bits each input partition keeps a count-sketch: ``depth`` rows of
``width`` counters, each item adding +1 or -1 by a second hash.  Sketches add
up, here along a tree of fan-in 64, so memory is bounded by the sketch and not
by the number of items.  Going down from the 256 shortest prefixes, only those
are followed whose estimate reaches half of the wanted share; at 32 bits at
most a few hundred are left.  A second scan counts exactly the items below
them.

Null items are counted in the total only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (8, 16, 24, 32)
DEPTH = 5
FAN_IN = 64

_PART = "field int, level int, salt bigint, total bigint, cells binary"


def width_for(share: float) -> int:
    """Counters a row needs: with 32 / share the noise at a prefix stays below half the wanted count."""
    return 1 << int(np.ceil(np.log2(32 / share)))


def _odd(level: int, row: int, use: int) -> tuple[np.uint64, np.uint64]:
    rng = np.random.default_rng([level, row, use, 20_240])
    a, b = rng.integers(0, 2**64, 2, dtype=np.uint64)
    return a | np.uint64(1), b


def places(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in a row, by multiply-and-shift hashing."""
    x = (prefix + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    a, b = _odd(level, row, 0)
    c, d = _odd(level, row, 1)
    at = (x * a + b) >> np.uint64(64 - int(np.log2(width)))
    sign = 1 - 2 * ((x * c + d) >> np.uint64(63)).astype(np.int64)
    return at.astype(np.int64), sign


def _add(cells: np.ndarray, hashes: np.ndarray, level: int, width: int) -> None:
    prefix, n = np.unique(hashes >> np.uint64(64 - level), return_counts=True)
    for r in range(DEPTH):
        at, sign = places(prefix, level, r, width)
        cells[r] += np.bincount(at, weights=sign * n, minlength=width).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], n_fields: int, width: int) -> Iterator[pa.RecordBatch]:
    from pyspark.taskcontext import TaskContext

    salt = TaskContext.get().partitionId()
    cells = np.zeros((n_fields, len(LEVELS), DEPTH, width), np.int64)
    total, held, size = 0, [[] for _ in range(n_fields)], 0

    def flush():
        for f in range(n_fields):
            h = np.concatenate(held[f]) if held[f] else np.empty(0, np.uint64)
            for k, level in enumerate(LEVELS):
                _add(cells[f, k], h, level, width)
            held[f] = []

    for b in batches:
        total += b.num_rows
        size += b.num_rows
        for f in range(n_fields):
            held[f].append(b.column(f).drop_null().to_numpy().view(np.uint64))
        if size >= 200_000:
            flush()
            size = 0
    flush()
    if not total:
        return
    rows = [(f, k, salt, total if not k else 0, _pack(cells[f, k])) for f in range(n_fields) for k in range(len(LEVELS))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["field", "level", "salt", "total", "cells"])


def _pack(cells: np.ndarray) -> bytes:
    """Counters in four bytes where they fit, else eight; the first byte says which."""
    small = np.abs(cells).max(initial=0) < 2**31
    return (b"\x04" if small else b"\x08") + cells.astype(np.int32 if small else np.int64).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32 if b[0] == 4 else np.int64, offset=1).astype(np.int64)


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(table.column("total").to_pylist())
    cells = None
    for b in table.column("cells"):
        x = _unpack(b.as_py())
        cells = x if cells is None else cells + x
    f, k, salt = (x.as_py() for x in key)
    return pa.table({"field": pa.array([f], pa.int32()), "level": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int64()), "total": pa.array([total], pa.int64()), "cells": pa.array([_pack(cells)], pa.binary())})


def sketch(hashes: DataFrame, width: int) -> DataFrame:
    """One row per (field, level) with the summed counters; field i is the i-th (bigint) column."""
    n = len(hashes.columns)
    merged = hashes.mapInArrow(lambda it: _sketch(it, n, width), _PART)
    for _ in range(2):
        merged = merged.withColumn("salt", F.floor(F.col("salt") / FAN_IN)).groupBy("field", "level", "salt").applyInArrow(_sum, _PART)
    return merged.withColumn("salt", F.lit(0).cast("bigint")).groupBy("field", "level", "salt").applyInArrow(_sum, _PART)


def estimate(cells: np.ndarray, prefix: np.ndarray, level: int, width: int) -> np.ndarray:
    """Median over the rows of sign * counter."""
    got = []
    for r in range(DEPTH):
        at, sign = places(prefix, level, r, width)
        got.append(cells[r][at] * sign)
    return np.median(np.array(got), axis=0)


def heavy_prefixes(levels: list[np.ndarray], at_least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the last level that are heavy at all levels, and their estimated counts."""
    prefix = np.zeros(1, np.uint64)
    est = np.zeros(1)
    for k, level in enumerate(LEVELS):
        step = level - (LEVELS[k - 1] if k else 0)
        prefix = ((prefix << np.uint64(step))[:, None] + np.arange(2**step, dtype=np.uint64)[None, :]).ravel()
        est = estimate(levels[k], prefix, level, width)
        keep = est >= at_least
        prefix, est = prefix[keep], est[keep]
    return prefix, est


def frequent(df: DataFrame, items: dict[str, Column], share: float) -> DataFrame:
    """Items with at least ``share`` of all rows: field_name, item (string), estimate, n, total.

    ``items``: the columns to look into by the name to report.  ``estimate`` is
    the sketch's count, ``n`` the exact one of the second scan.
    """
    spark = df.sparkSession
    width = width_for(share)
    names = list(items)
    hashes = df.select(*(F.when(items[c].isNotNull(), F.xxhash64(items[c])).alias(f"h{i}") for i, c in enumerate(names)))
    got = sketch(hashes, width).collect()  # len(items) * len(LEVELS) rows of a fixed size
    total = max([r["total"] for r in got], default=0)
    schema = "field_name string, item string, estimate bigint, n bigint, total bigint"
    out = None
    for i, c in enumerate(names):
        levels = {r["level"]: _unpack(bytes(r["cells"])).reshape(DEPTH, width) for r in got if r["field"] == i}
        if not levels or not total:
            continue
        prefix, est = heavy_prefixes([levels[k] for k in range(len(LEVELS))], share / 2 * total, width)
        if not len(prefix):
            continue
        h = F.shiftrightunsigned(F.xxhash64("item"), 64 - LEVELS[-1])
        wanted = df.select(items[c].alias("item")).filter(F.col("item").isNotNull()).filter(h.isin([int(p) for p in prefix]))
        exact = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share * total)
        ests = F.create_map(*(F.lit(x) for p, e in zip(prefix, est) for x in (int(p), int(e))))
        part = exact.select(F.lit(c).alias("field_name"), "item", ests[h].alias("estimate"), "n", F.lit(total).cast("bigint").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
