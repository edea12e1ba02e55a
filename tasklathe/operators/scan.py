"""Running aggregates along offsets, spread over blocks.

A window over a whole partition of the log is one task, however long the
partition.  Here offsets are cut into blocks: a window runs inside each block,
the blocks' totals (one row each) are summed along the partition, and the sum
before a block is added to its rows.  The result equals the plain window, for
sums, counts, minima, maxima and the previous row's value.

Rows are shuffled once, by block: the block is one struct column, by which
window and join are partitioned alike (nulls inside a struct are equal).  A
chain of running aggregates over the same blocks keeps that partitioning
(``keep_blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
BLOCK_COLUMN = "_block_key"


def running(df: DataFrame, group: list[str], order: str | list[str], items: dict[str, tuple[str, Column]], *, before: bool = False, block: int = BLOCK, keep_blocks: bool = False) -> DataFrame:
    """``df`` with one column per item: the aggregate of its rows up to this one (``before``: up to the one before).

    ``items``: name -> (kind, expression), kind one of sum, max, min, prev.
    ``order``: an integer column, or several of which the first is one; rows
    equal in all of them come in any order.  A block spans ``block`` of the
    first one's values, so that is to be chosen by how dense they are.  Null
    group values form a group.  Nothing before the first row gives null, and
    for sums 0.  A frame that still has its blocks is taken to have these.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    by = [order] if isinstance(order, str) else list(order)
    if BLOCK_COLUMN not in df.columns:
        parts = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
        df = df.withColumn(BLOCK_COLUMN, F.struct(*parts, F.floor(F.col(by[0]) / block).alias("b")))
    inner = Window.partitionBy(BLOCK_COLUMN).orderBy(*by)
    frame = inner.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = {f"_l_{n}": F.lag(e).over(inner) if kind == "prev" else fold[kind](e).over(frame) for n, (kind, e) in items.items()}
    first = {"_first": F.row_number().over(inner) == 1} if any(k == "prev" for k, _ in items.values()) else {}
    totals = df.groupBy(BLOCK_COLUMN).agg(*((F.max_by(e, F.struct(*by)) if kind == "prev" else fold[kind](e)).alias(f"_t_{n}") for n, (kind, e) in items.items()))
    outer = Window.partitionBy(*(f"{BLOCK_COLUMN}.g{i}" for i in range(len(group)))).orderBy(f"{BLOCK_COLUMN}.b")
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        BLOCK_COLUMN,
        *((F.lag(f"_t_{n}").over(outer) if kind == "prev" else fold[kind](f"_t_{n}").over(past)).alias(f"_c_{n}") for n, (kind, _) in items.items()),
    )
    joined = df.withColumns(local | first).join(carried, BLOCK_COLUMN)
    out = {}
    for n, (kind, _) in items.items():
        mine, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            out[n] = F.coalesce(mine, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "prev":
            out[n] = F.when(F.col("_first"), carry).otherwise(mine)
        else:
            out[n] = (F.greatest if kind == "max" else F.least)(mine, carry)
    helpers = [*local, *first, *(f"_c_{n}" for n in items), *([] if keep_blocks else [BLOCK_COLUMN])]
    return joined.withColumns(out).drop(*helpers)
