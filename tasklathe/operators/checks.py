"""Checks of what a processor guarantees, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.operators.scan import running


def lost_and_unknown(produced: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Ids produced but never processed (lost) and processed but never produced (unknown). Null ids are left out."""
    a, b = (x.select(key).filter(F.col(key).isNotNull()).distinct() for x in (produced, processed))
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("lost")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unknown")))


HOUR_NS = 3_600_000_000_000


def overlaps(df: DataFrame, key: str, start: str, end: str, block: int = HOUR_NS) -> DataFrame:
    """Tasks that began before the one before them, of the same key, had ended: key, start, end, previous_end.

    Unfinished tasks (null end) are left out; rows with a null key too.
    ``block``: span of start times that one task orders for a key.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    r = running(rows, [key], [start, end], {"previous_end": ("prev", F.col(end))}, block=block)
    return r.filter(F.col("previous_end") > F.col(start)).select(key, start, end, "previous_end")


def ordered_offsets(offsets: list[int]) -> bool:
    """Is a sequence of processed offsets in order, allowing for restarts?

    A restart goes back to any offset and repeats from there without skipping;
    at the end the last offset must have been reached again.
    """
    rank = {o: i for i, o in enumerate(sorted(set(offsets)))}
    places = [rank[o] for o in offsets]
    return not places or places[0] == 0 and places[-1] == len(rank) - 1 and all(b <= a + 1 for a, b in zip(places, places[1:]))


def order_problems(df: DataFrame, key: str, start: str, offset: str, block: int = HOUR_NS) -> DataFrame:
    """Keys whose offsets were processed out of order (see ``ordered_offsets``): key, n.

    An offset's place among the key's offsets, and each row's predecessor, are
    running values over blocks, so a key with a third of all rows is no single
    task.  Rows with a null key, start or offset are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(offset).isNotNull()).select(key, start, offset)
    places = running(rows.distinct().select(key, offset).distinct(), [key], offset, {"_place": ("sum", F.lit(1))})
    r = rows.join(places, [key, offset])
    r = running(r, [key], [start, offset], {"_was": ("prev", F.col("_place"))}, block=block)
    skip = F.coalesce(F.col("_place") > F.col("_was") + 1, F.col("_place") > 1)
    per = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(skip).alias("_skip"), F.max("_place").alias("_top"), F.max_by("_place", F.struct(start, offset)).alias("_end"))
    return per.filter(F.col("_skip") | (F.col("_end") < F.col("_top"))).select(key, "n")


def propagated(traces: DataFrame, children: DataFrame, trace: str) -> DataFrame:
    """Trace ids that were opened but never closed by any child."""
    return traces.select(trace).distinct().join(children.select(trace).distinct(), trace, "left_anti")


def child_trace(parent: Column, stage: str) -> Column:
    return F.concat(parent, F.lit(f"-{stage}"))
