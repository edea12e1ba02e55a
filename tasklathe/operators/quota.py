"""Per-key rates over two rotating windows, the decision against a quota, and routing of bursts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklathe.functions.sketch import DELTA, EPSILON, CountMin
from tasklathe.operators.anchored import anchored_windows
from tasklathe.operators.scan import running

COMPLY, VIOLATE = "COMPLY", "VIOLATE"


@dataclass(frozen=True)
class QuotaConfig:
    """Settings of a quota: rate per key and second (-1: none), window, topic for bursts (default <topic>-shaping)."""

    rate: float = -1
    window_ms: int = 10_000
    shaping_topic: str | None = None

    def target(self, topic: str) -> str:
        return self.shaping_topic or f"{topic}-shaping"


def windowed_key_stat(df: DataFrame, partition: str, key: str, time: str, order: str, width: int) -> DataFrame:
    """``df`` with from_ms, to_ms and n: how often the key came in the partition's current window and the one before.

    Windows are anchored per partition, by arrival.  The window before counts
    only if it started within two widths.  ``order`` is the arrival order, along
    which ``time`` must not fall.  A null key is counted like any other here;
    ``quota_decision`` lets it pass.
    """
    w = anchored_windows(df, [partition], F.col(time), [order], width)
    counted = running(w.withColumn("_k", F.col(key)), [partition, "w0", "_k"], order, {"_mine": ("sum", F.lit(1))})
    per_window = w.groupBy(partition, "w0").agg(F.count(F.lit(1)).alias("_n"))
    # one row per window; consecutive windows are linked here
    links = per_window.select(F.col(partition).alias("_p"), F.col("w0").alias("_w"), F.lag("w0").over(Window.partitionBy(partition).orderBy("w0")).alias("_prev"))
    totals = w.groupBy(partition, "w0", F.col(key).alias("_pk")).agg(F.count(F.lit(1)).alias("_before")).withColumnsRenamed({partition: "_pp", "w0": "_pw"})
    j = counted.join(links, (F.col(partition) == F.col("_p")) & (F.col("w0") == F.col("_w")))
    j = j.join(totals, (F.col(partition) == F.col("_pp")) & (F.col("_prev") == F.col("_pw")) & F.col("_k").eqNullSafe(F.col("_pk")), "left")
    near = F.col("_prev").isNotNull() & (F.col("_prev") >= F.col(time) - 2 * width)
    out = j.withColumns(
        {
            "from_ms": F.when(near, F.col("_prev")).otherwise(F.col("w0")),
            "to_ms": F.col(time),
            "n": F.col("_mine") + F.when(near, F.coalesce("_before", F.lit(0))).otherwise(F.lit(0)),
        }
    )
    return out.drop("w0", "_k", "_mine", "_p", "_w", "_prev", "_pp", "_pw", "_pk", "_before")


def quota_decision(key: Column, rate: float, window_ms: int, from_ms: Column, to_ms: Column, n: Column) -> Column:
    """struct(type, rate): COMPLY without a key, without a quota, while less than a window was observed, or below the rate; at or above it VIOLATE."""
    seen = to_ms - from_ms
    observed = n / F.when(seen > 0, seen) * 1000
    comply = key.isNull() | F.lit(rate < 0) | (seen < window_ms) | observed.isNull() | (observed < rate)
    return F.struct(F.when(comply, COMPLY).otherwise(VIOLATE).alias("type"), F.when(~comply, observed).alias("rate"))


def decided(df: DataFrame, origin_topic: str, topic: str, key: str, config: QuotaConfig) -> DataFrame:
    """Add ``usage`` to rows with from_ms, to_ms, n; only the origin topic has a quota."""
    on = F.when(F.col(topic) == origin_topic, F.lit(True)).otherwise(False)
    d = quota_decision(F.col(key), config.rate, config.window_ms, F.col("from_ms"), F.col("to_ms"), F.col("n"))
    return df.withColumn("usage", F.when(on, d).otherwise(F.struct(F.lit(COMPLY).alias("type"), F.lit(None).cast("double").alias("rate"))))


def shaped(df: DataFrame, topic: str, config: QuotaConfig, origin_topic: str, callback: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``target``: where a row goes on. Bursts go to the shaping topic, or where ``callback`` (of the rate) says; a null target means dropped."""
    there = callback(F.col("usage.rate")) if callback else F.lit(config.target(origin_topic))
    return df.withColumn("target", F.when(F.col("usage.type") == VIOLATE, there).otherwise(F.col(topic)))


def sketch_bounds(df: DataFrame, partition: str, key: str, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """Per partition and input split, the conservative sketch's estimates against exact counts: n_keys, n_rows, under, over.

    Each input partition feeds its own sketch of its log partitions, with keys
    folded beforehand; ``under`` and ``over`` count keys estimated below the
    truth or above it by more than epsilon times the rows.
    """
    folded = df.filter(F.col(key).isNotNull() & F.col(partition).isNotNull()).groupBy(partition, key).agg(F.count(F.lit(1)).alias("n"))
    spread = folded.select(F.col(partition).alias("p"), F.xxhash64(F.col(key)).alias("h"), "n").repartition("p", F.pmod("h", F.lit(8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            p, h, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
            for q in np.unique(p):
                at = p == q
                held.setdefault(int(q), []).append((h[at], n[at]))
        rows = []
        for q, parts in held.items():
            h, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            s = CountMin(epsilon, delta)
            s.add(h, n)
            e = s.estimate(h)
            rows.append((q, len(h), int(n.sum()), int((e < n).sum()), int((e > n + epsilon * n.sum()).sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if not i else pa.int64()) for i in range(5)], ["p", "n_keys", "n_rows", "under", "over"])

    got = spread.mapInArrow(run, "p int, n_keys bigint, n_rows bigint, under bigint, over bigint")
    return got.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("n_keys", "n_rows", "under", "over")))
