"""The operational metrics as aggregates over a processed task log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.operators.scan import running

QUANTILES = (0.5, 0.9, 0.99, 0.999)


def counters(df: DataFrame, group: list[str], *, discarded: Column, error: Column, timeout: Column) -> DataFrame:
    """processed, discarded, errors and timeouts per group; a null flag counts as no."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("processed"), count(discarded).alias("discarded"), count(error).alias("errors"), count(timeout).alias("timeouts"))


def timer(df: DataFrame, group: list[str], value: Column, when: Column | None = None) -> DataFrame:
    """Count, sum, greatest and quantiles of a duration over the rows where ``when`` holds.

    Quantiles come from a fold by value with partial aggregation (counts as
    frequencies), so a hot group is folded before it is gathered.
    """
    df = df.filter(when) if when is not None else df
    folded = df.select(*group, value.alias("_v")).filter("_v is not null").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    qs = F.expr(f"percentile(_v, array({', '.join(f'{q}D' for q in QUANTILES)}), _n)")
    out = folded.groupBy(*group).agg(F.sum("_n").alias("count"), F.sum(F.col("_v") * F.col("_n")).alias("total"), F.max("_v").alias("max"), qs.alias("q"))
    return out.select(*group, "count", "total", "max", *(F.col("q")[i].alias(f"p{str(q)[2:].ljust(2, '0')}") for i, q in enumerate(QUANTILES)))


def latency_counts(sent: Column, now: Column) -> Column:
    """Is a delivery latency (or scheduling delay) measured: the time is set and not in the future?"""
    return (sent > 0) & (now >= sent)


def lane_use(df: DataFrame, group: list[str], duration: Column) -> DataFrame:
    """Time processed and tasks queued per lane."""
    return df.groupBy(*group).agg(F.sum(duration).alias("processed_time"), F.count(F.lit(1)).alias("queued"))


def islands(df: DataFrame, group: list[str], order: str, time: str, state: Column) -> DataFrame:
    """Stretches of equal state along ``order``: group, state, from_time, to_time, n.

    Block-wise like the other running forms; null states form stretches too.
    """
    df = df.withColumns({"_s": state})
    r = running(df, group, order, {"_was": ("prev", F.struct("_s"))}, keep_blocks=True)
    change = F.when(F.col("_was").isNull() | ~F.col("_was._s").eqNullSafe(F.col("_s")), 1).otherwise(0)
    r = running(r.withColumn("_c", change), group, order, {"_i": ("sum", F.col("_c"))})
    return r.groupBy(*group, F.col("_i").alias("island"), F.col("_s").alias("state")).agg(F.min(time).alias("from_time"), F.max(time).alias("to_time"), F.count(F.lit(1)).alias("n"))


def state_time(stretches: DataFrame, group: list[str]) -> DataFrame:
    """Time spent in stretches whose state is true, per group."""
    return stretches.filter("state").groupBy(*group).agg(F.sum(F.col("to_time") - F.col("from_time")).alias("time"), F.count(F.lit(1)).alias("times"))


def throughput(df: DataFrame, seq: Column, warmup: int, start: str, end: str, latency: Column) -> DataFrame:
    """Tasks per second, mean and greatest latency after the warm-up: one row."""
    span = F.max(end) - F.min(start)
    return df.filter(seq >= warmup).agg(F.count(F.lit(1)).alias("tasks"), (F.count(F.lit(1)) / span * 1000).alias("throughput"), F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"))


def retry_counts(df: DataFrame, group: list[str], retries: Column, failed: Column | None = None) -> DataFrame:
    """Tasks queued for retry and the distribution of their counts; with ``failed`` (could it not be queued?) the number of those too."""
    extra = [] if failed is None else [F.count_if(F.coalesce(failed, F.lit(False))).alias("queueing_failed")]
    return df.filter(retries > 0).groupBy(*group).agg(F.count(F.lit(1)).alias("queued"), F.sum(retries).alias("retries"), F.max(retries).alias("most"), *extra)


def shaping_counts(df: DataFrame, group: list[str], violates: Column, failed: Column) -> DataFrame:
    """Tasks of bursts that were sent on, and those that couldn't be; null flags count as no."""
    v, f = (F.coalesce(c, F.lit(False)) for c in (violates, failed))
    return df.groupBy(*group).agg(F.count_if(v & ~f).alias("queued"), F.count_if(v & f).alias("queueing_failed"))


def starved_time(served: DataFrame, lane: list[str], order: str) -> DataFrame:
    """Time a lane had nothing to do between two tasks: lane, time, times. ``served`` has start and finish (see ``schedule.fifo_service``)."""
    r = running(served, lane, order, {"_done": ("prev", F.col("finish"))})
    gap = F.col("start") - F.col("_done")
    return r.groupBy(*lane).agg(F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).cast("bigint").alias("time"), F.count_if(gap > 0).alias("times"))


# Sections of a subscription's loop and the entries of a query's progress they correspond to.
SECTIONS = {"poll": ("latestOffset", "getBatch"), "records": ("addBatch",), "reload": ("queryPlanning",), "pause": ("triggerWait",), "commit": ("walCommit", "commitOffsets")}


def section_durations(progress: DataFrame, group: list[str], durations: str = "durationMs") -> DataFrame:
    """Milliseconds per section from progress rows with a map of durations: group, section, count, total, max. Missing entries count as 0."""
    at = lambda k: F.coalesce(F.try_element_at(F.col(durations), F.lit(k)), F.lit(0))
    parts = F.array(*(F.struct(F.lit(s).alias("section"), sum((at(k) for k in ks[1:]), at(ks[0])).cast("bigint").alias("ms")) for s, ks in SECTIONS.items()))
    rows = progress.select(*group, F.inline(parts))
    return rows.groupBy(*group, "section").agg(F.count(F.lit(1)).alias("count"), F.sum("ms").alias("total"), F.max("ms").alias("max"))
