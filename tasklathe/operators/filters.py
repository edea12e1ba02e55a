"""Key blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_LIST = 10_000


def ignore_keys(df: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Drop rows whose key is in ``keys``; null keys pass. An empty list changes nothing, and adds nothing to the plan."""
    return df.filter(~F.col(key).isin(*keys) | F.col(key).isNull()) if keys else df


def ignore_keys_of(df: DataFrame, key: str, blocked: DataFrame) -> DataFrame:
    """Drop rows whose key is in the one column of ``blocked``, which may change between runs. Null keys pass.

    The list is broadcast only if it is counted to be at most SMALL_LIST keys
    (of bounded length each); else the planner chooses.
    """
    name = blocked.columns[0]
    keys = blocked.filter(F.col(name).isNotNull()).select(F.col(name).alias("_blocked")).distinct()
    few = keys.limit(SMALL_LIST + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_blocked")), F.lit(0))).first()
    if few[0] <= SMALL_LIST and few[1] <= 1 << 23:
        keys = F.broadcast(keys)
    return df.join(keys, df[key] == F.col("_blocked"), "left_anti")
