"""Batching by capacity and by a free-running tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklathe.operators.scan import BLOCK, running


def batches(df: DataFrame, scope: list[str], time: str, offset: str, capacity: int, linger: int | None = None) -> DataFrame:
    """``df`` with ``tick`` and ``batch_no`` (within scope and tick).

    Ticks run from time 0 every ``linger`` (None: one endless tick).  A batch
    holds ``capacity`` tasks and is flushed by the arrival after them, or by the
    tick's end.  Both settings must be positive.
    """
    if capacity <= 0 or linger is not None and linger <= 0:
        raise ValueError("capacity and linger must be positive")
    tick = F.floor(F.col(time) / linger) if linger is not None else F.lit(0).cast("bigint")
    df = df.withColumn("tick", tick)
    numbered = running(df, [*scope, "tick"], offset, {"_seq": ("sum", F.lit(1))}, before=True)
    return numbered.withColumn("batch_no", F.floor(F.col("_seq") / capacity)).drop("_seq")


def flushed(batched: DataFrame, scope: list[str], offset: str, capacity: int, open_tick: Column | None = None) -> DataFrame:
    """One row per batch: scope, tick, batch_no, size, first and last offset, and whether its capacity was reached."""
    return batched.groupBy(*scope, "tick", "batch_no").agg(
        F.count(F.lit(1)).alias("size"), F.min(offset).alias("first_offset"), F.max(offset).alias("last_offset"), (F.count(F.lit(1)) == capacity).alias("full")
    )


def collected(batched: DataFrame, scope: list[str], offset: str, item: Column) -> DataFrame:
    """Batches with their items in order; a batch never has more than its capacity of them."""
    return batched.groupBy(*scope, "tick", "batch_no").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(offset).alias("at"), item.alias("item")))), lambda x: x["item"]).alias("items"))


def last_known_good(changes: DataFrame, scope: list[str], order: str, value: str, name: str = "effective") -> DataFrame:
    """Settings over time with invalid ones (null or not positive) replaced by the last valid one before.

    Null until a first valid one came.  Block-wise, so a long history is many tasks.
    """
    good = F.when(F.col(value) > 0, F.struct(F.col(order).cast("bigint").alias("at"), F.col(value).alias("v")))
    return running(changes, scope, order, {"_good": ("max", good)}, block=BLOCK).withColumn(name, F.col("_good.v")).drop("_good")
