"""Partitions and lanes: which records are processed by the same worker, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.functions.hashing import murmur2_column
from tasklathe.operators.scan import running

# Fixed value: what lanes put before a key, so that they don't follow the partitions.
LANE_PREFIX = "s:"


def log_partition(key: Column, n: int) -> Column:
    """The partition a producer chooses for a key (binary); null for a null key."""
    return F.pmod(murmur2_column(key).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n))


def lane_of(key: Column, n: int) -> Column:
    """The lane of a key within its partition; null for a null key, which goes round the lanes (``with_lanes``)."""
    return F.pmod(murmur2_column(F.concat(F.lit(LANE_PREFIX.encode()), key)).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n))


def round_robin(df: DataFrame, partition: str, order: str, n: int, name: str = "lane") -> DataFrame:
    """Rows of a partition in turn over ``n`` lanes; numbered block-wise, so a long partition is many tasks."""
    numbered = running(df, [partition], order, {"_rr": ("sum", F.lit(1))}, before=True)
    return numbered.withColumn(name, F.pmod(F.col("_rr").bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")).drop("_rr")


def with_lanes(df: DataFrame, key: Column, partition: str, order: str, n: int, name: str = "lane") -> DataFrame:
    """Lane by key; rows with a null key take turns, counted among themselves."""
    turn = running(df, [partition], order, {"_rr": ("sum", F.when(key.isNull(), 1).otherwise(0))}, before=True)
    return turn.withColumn(name, F.coalesce(lane_of(key, n), F.pmod(F.col("_rr"), F.lit(n))).cast("int")).drop("_rr")


def custom_lanes(df: DataFrame, lane: Column, n: int, name: str = "lane") -> DataFrame:
    """Lanes from a caller's expression; one outside 0..n-1 is an error, as it would be lost."""
    ok = (lane >= 0) & (lane < n)
    return df.withColumn(name, F.when(ok, lane).otherwise(F.raise_error(F.lit("lane out of range"))).cast("int"))


def balance(df: DataFrame, partition: str, lane: str) -> DataFrame:
    """Per partition: rows, lanes used, standard deviation of the lanes' sizes as a share of the rows."""
    sizes = df.groupBy(partition, lane).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(partition).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_lanes"), (F.stddev_pop("_n") / F.sum("_n")).alias("deviation")
    )
