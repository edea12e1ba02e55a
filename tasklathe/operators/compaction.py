"""Per-key compaction: of the tasks of a key that arrive within ``linger`` of the first, one survives.

The window opens with the first task and isn't extended by later ones.  The
compactors latest, max and first fold in Spark with partial aggregation; any
other binary compactor is folded in arrival order (``compact_with``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklathe.operators.anchored import anchored_windows

PICK_LEFT, PICK_RIGHT, PICK_EITHER = "left", "right", "either"


def compact(df: DataFrame, key: str, time: str, offset: str, linger: int, pick: str = "latest", by: Column | None = None) -> DataFrame:
    """One row per window of a key: the key, w0, n (tasks folded), and the survivor's ``offset`` and time.

    pick: latest (greatest offset), first, or max (greatest ``by``, of equal
    ones the newest).  Null keys share a window; a null ``by`` loses to any
    value.
    """
    value = by if by is not None else F.lit(0)
    w = anchored_windows(df.withColumn("_by", value), [key], F.col(time), [offset], linger)
    rank = {"latest": F.struct(offset), "first": F.struct((-F.col(offset)).alias("x")), "max": F.struct("_by", offset)}[pick]
    best = F.max_by(F.struct(offset, time), rank)
    out = w.groupBy(key, "w0").agg(F.count(F.lit(1)).alias("n"), best.alias("s"))
    return out.select(key, "w0", "n", F.col(f"s.{offset}").alias(offset), F.col(f"s.{time}").alias(time))


def fold(rows: list, compactor: Callable[[object, object], str]) -> object:
    """The survivor of tasks in arrival order; ``either`` means the newer."""
    left = rows[0]
    for right in rows[1:]:
        if compactor(left, right) != PICK_LEFT:
            left = right
    return left


def compact_with(df: DataFrame, key: str, time: str, offset: str, linger: int, compactor: Callable[[dict, dict], str], associative: bool = False) -> DataFrame:
    """Survivors (whole rows with w0) by any binary compactor, folded in arrival order.

    The rows of a window pass through one task, in order and one held at a time.
    ``associative``: the compactor gives the same survivor however the rows are
    put in brackets (as picking by a greatest value does); then each task folds
    its stretch of a window first, so that a window holding a third of all rows
    is spread over a third of the tasks, and only the stretches' survivors meet.
    """
    w = anchored_windows(df, [key], F.col(time), [offset], linger)
    schema = T.StructType(w.schema.fields)
    keyed = T.StructType([*schema.fields, T.StructField("_g", T.StringType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by (key, w0, time, offset): a window is a stretch, held as one row
        left = at = None
        for pdf in pdfs:
            done = []
            for r in pdf.to_dict("records"):
                here = (r["_g"], r["w0"])
                if here == at:
                    left = r if compactor(left, r) != PICK_LEFT else left
                else:
                    if left is not None:
                        done.append(left)
                    left, at = r, here
            yield pd.DataFrame(done, columns=keyed.names)
        if left is not None:
            yield pd.DataFrame([left], columns=keyed.names)

    laid = w.withColumn("_g", F.to_json(F.struct(key)))
    order = ["_g", "w0", time, offset]
    if associative:
        laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, keyed)
    return laid.repartition("_g", "w0").sortWithinPartitions(*order).mapInPandas(run, keyed).drop("_g")


def survivors_per_window(compacted: DataFrame) -> DataFrame:
    """Counters of compaction: windows (keys flushed) and tasks compacted away."""
    return compacted.agg(F.count(F.lit(1)).alias("flushed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("compacted"))
