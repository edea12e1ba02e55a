"""Delays and rate limits: when a task may start.

Waiting in a lane and waiting for permits are max-plus recurrences, so both
have a closed form of running sums and maxima; those run block-wise
(``scan.running``), so a lane with a third of all tasks is many tasks of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.operators.scan import running

# Fixed value: greatest rate per second that is enforced.
MAX_RATE = 1_000_000


def scheduled_start(arrival: Column, scheduled: Column) -> Column:
    """A task starts at or after its scheduled time; 0 or null: on arrival."""
    return F.greatest(arrival, F.coalesce(scheduled, F.lit(0)))


def fifo_service(df: DataFrame, lane: list[str], order: str, ready: Column, duration: Column) -> DataFrame:
    """``df`` with start and finish of tasks that a lane takes one after the other, in order: finish = max(ready, finish before) + duration."""
    df = df.withColumns({"_ready": ready, "_d": duration})
    s = running(df, lane, order, {"_s": ("sum", F.col("_d"))}, keep_blocks=True)
    m = running(s, lane, order, {"_m": ("max", F.col("_ready") - (F.col("_s") - F.col("_d")))})
    finish = F.col("_s") + F.col("_m")
    return m.withColumns({"start": finish - F.col("_d"), "finish": finish}).drop("_ready", "_d", "_s", "_m")


def token_bucket(df: DataFrame, scope: list[str], order: str, now: Column, rate: float, burst_seconds: float = 1.0, permits: Column | None = None, created: Column | None = None) -> DataFrame:
    """``df`` with ``wait`` (same unit as ``now``: milliseconds) of a limiter of ``rate`` permits a second.

    ``created``: when the limiter was made (default: at the scope's first row).
    ``permits`` per row must be positive (default 1).  A rate of 0 lets nothing
    pass (no rows); a negative one or one above MAX_RATE never waits.  ``now``
    must not fall along ``order``.
    """
    if rate == 0:
        return df.withColumn("wait", F.lit(0.0)).filter(F.lit(False))
    if rate < 0 or rate > MAX_RATE:
        return df.withColumn("wait", F.lit(0.0))
    each, burst = 1000.0 / rate, burst_seconds * 1000.0
    n = permits if permits is not None else F.lit(1)
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("permits must be positive")))
    df = df.withColumns({"_now": now.cast("double"), "_n": n.cast("bigint")})
    first = created.cast("double") if created is not None else None
    taken = {"_used": ("sum", F.col("_n"))} | ({} if first is not None else {"_t0": ("min", F.col("_now"))})
    r = running(df, scope, order, taken, keep_blocks=True)
    r = r.withColumns({"_rel": F.col("_now") - (first if first is not None else F.col("_t0")), "_used": F.col("_used") - F.col("_n")})
    # what the limiter owes when row j comes: the greatest backlog any row before it started
    r = running(r, scope, order, {"_m": ("max", F.col("_rel") - F.lit(burst) - F.col("_used") * each)}, before=True)
    free = F.greatest(F.lit(0.0), F.col("_used") * each + F.coalesce("_m", F.lit(-1e18)))
    free = F.greatest(free, F.col("_used") * each)
    return r.withColumn("wait", F.greatest(F.lit(0.0), free - F.col("_rel"))).drop("_now", "_n", "_used", "_t0", "_rel", "_m")


def token_bucket_epochs(df: DataFrame, scope: list[str], order: str, now: Column, epoch: str, rates: dict[int, float], burst_seconds: float = 1.0) -> DataFrame:
    """Limiters that are swapped: each epoch has its own rate and starts anew. Epochs without a rate don't wait."""
    out = None
    for e, rate in rates.items():
        part = token_bucket(df.filter(F.col(epoch) == e), [*scope, epoch], order, now, rate, burst_seconds)
        out = part if out is None else out.unionByName(part)
    rest = df.filter(~F.col(epoch).isin(list(rates)) | F.col(epoch).isNull()).withColumn("wait", F.lit(0.0))
    return rest if out is None else out.unionByName(rest)


def selected_rate(topic: Column, shaping_topic: Column, override: Column, per_key_rate: Column, partition_rate: Column) -> Column:
    """The rate of a topic's limiter: on the shaping topic its override or else the quota, elsewhere the partition's."""
    return F.when(topic == shaping_topic, F.coalesce(override, per_key_rate)).otherwise(partition_rate)
