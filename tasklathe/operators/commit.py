"""Out-of-order completion: high watermark, pending records, back-pressure, timeouts, assignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklathe.operators.scan import running

# Fixed value: offset of a partition of which nothing is complete.
NONE_YET = -1


def watermarks(df: DataFrame, group: list[str], offset: str, completed: Column) -> DataFrame:
    """Per group: high_watermark (last offset of the completed prefix, -1 if none), pending (records from the first incomplete on, complete ones too), latest.

    Two folds with partial aggregation; no window.  Null completion counts as
    incomplete; null offsets are left out.
    """
    done = F.coalesce(completed, F.lit(False))
    first_bad = df.groupBy(*group).agg(F.min(F.when(~done, F.col(offset))).alias("_bad"))
    b = first_bad.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_bad")
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    before = F.col("_bad").isNull() | (F.col(offset) < F.col("_bad"))
    return (
        df.filter(F.col(offset).isNotNull())
        .join(b, on)
        .groupBy(*group)
        .agg(
            F.coalesce(F.max(F.when(before, F.col(offset))), F.lit(NONE_YET)).cast("bigint").alias("high_watermark"),
            F.count(F.when(~before, F.lit(1))).alias("pending"),
            F.max(offset).alias("latest"),
        )
    )


def running_watermark(df: DataFrame, group: list[str], offset: str, completed: Column) -> DataFrame:
    """``df`` with ``prefix_complete``: are this record and all before it complete?"""
    ok = F.coalesce(completed, F.lit(False)).cast("int")
    return running(df, group, offset, {"_ok": ("min", ok)}).withColumn("prefix_complete", F.col("_ok") == 1).drop("_ok")


def committable(marks: DataFrame, committed: str = "last_committed", revoking: Column | None = None) -> DataFrame:
    """Add ``commit``: the position to commit, null if the watermark didn't pass the last one or the partition is being revoked."""
    moved = F.col("high_watermark") > F.col(committed)
    if revoking is not None:
        moved = moved & ~revoking
    return marks.withColumn("commit", F.when(moved, F.col("high_watermark") + 1))


def paused(pending: Column, max_pending: int = 10_000, reload: Column | None = None, rate: float = -1) -> Column:
    """Should a partition be paused: too much pending, a reload asked for, or a rate of 0?"""
    p = (pending >= max_pending) | F.lit(rate == 0)
    return p | reload if reload is not None else p


def regressions(df: DataFrame, group: list[str], arrival: str, offset: Column) -> DataFrame:
    """``df`` with ``regression``: did the offset fall behind the one that arrived before? Equal offsets are allowed."""
    return running(df.withColumn("_o", offset), group, arrival, {"_was": ("prev", F.col("_o"))}).withColumn("regression", F.coalesce(F.col("_o") < F.col("_was"), F.lit(False))).drop("_o", "_was")


GIVE_UP, EXTEND = "give_up", "extend"


def _ran_out(timeout_at: Column, now: Column) -> Column:
    return F.coalesce((timeout_at >= 0) & (timeout_at <= now), F.lit(False))


def _answer(policy: str | Callable[[], Column]) -> Column:
    return F.coalesce(policy(), F.lit(GIVE_UP)) if callable(policy) else F.lit(policy)


def after_timeout(completed: Column, timeout_at: Column, now: Column, policy: str | Callable[[], Column] = GIVE_UP) -> Column:
    """Completion of a record once its timeout was looked at.

    ``policy``: GIVE_UP completes it, EXTEND leaves it open; or a callback that
    makes a column with the answer for each row (null: GIVE_UP).  A negative or
    null timeout never runs out.
    """
    return completed | (_ran_out(timeout_at, now) & (_answer(policy) != EXTEND))


def extended_timeout(timeout_at: Column, now: Column, timeout: int, policy: str | Callable[[], Column] = GIVE_UP) -> Column:
    """The next time to look at a record that is still open."""
    return F.when(_ran_out(timeout_at, now) & (_answer(policy) == EXTEND), now + timeout).otherwise(timeout_at)


def cadence(df: DataFrame, group: list[str], offset: str, completed_at: Column, interval: int, failed: Column | None = None) -> DataFrame:
    """The commits of a group: group, tick (when), commit (position), effective (greatest position committed by then).

    A commit takes place at every multiple of ``interval`` by which the
    watermark moved since the last one; a record lies below the watermark once
    it and all before it are complete, which is a running maximum of completion
    times.  ``failed`` (of ``tick``): commits that failed; nothing is lost, as the
    next one goes beyond them.  A null time never comes.
    """
    far = F.lit(2**62)
    r = running(df.select(*group, offset, F.coalesce(completed_at, far).alias("_c")), group, offset, {"_covered": ("max", F.col("_c"))})
    tick = (F.floor(F.col("_covered") / interval) + 1) * interval
    made = r.filter(F.col("_covered") < far).groupBy(*group, tick.alias("tick")).agg((F.max(offset) + 1).alias("commit"))
    good = F.when(~failed, F.col("commit")) if failed is not None else F.col("commit")
    # a row per commit of a group, not per record
    return made.withColumn("effective", F.max(good).over(Window.partitionBy(*group).orderBy("tick")))


def over_capacity(df: DataFrame, group: list[str], offset: str, received_at: Column, completed_at: Column, max_pending: int = 10_000, max_poll: int = 100) -> DataFrame:
    """``df`` with pending (records received and not below the watermark when this one came, itself included) and ``over``: more than what may be held.

    Records arrive in the order of their offsets.  The head of the pending ones
    when a record comes is the first whose running maximum of completion times
    is later; both run along the offsets, so it is found by merging them.
    """
    at = df.withColumns({"_at": received_at.cast("bigint"), "_c": F.coalesce(completed_at, F.lit(2**62)).cast("bigint")})
    r = running(at, group, offset, {"_covered": ("max", F.col("_c")), "_n": ("sum", F.lit(1))})
    # released records, as events at the time they leave, and arrivals, merged by time: of equal times the release comes first
    out = r.select(*group, F.col("_covered").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_o"))
    come = r.select(*group, F.col("_at").alias("_t"), F.lit(1).alias("_kind"), F.col(offset).cast("bigint").alias("_o"))
    gone = running(out.filter(F.col("_t") < 2**62).unionByName(come), group, ["_t", "_kind", "_o"], {"_gone": ("sum", F.lit(1) - F.col("_kind"))}, block=3_600_000)
    left = gone.filter("_kind = 1").select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_o", "_gone")
    on = [r[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [r[offset] == F.col("_o")]
    pending = F.greatest(F.col("_n") - F.col("_gone"), F.lit(1))
    joined = r.join(left, on).withColumns({"pending": pending, "over": pending > max_pending + max_poll})
    return joined.drop("_at", "_c", "_covered", "_n", "_o", "_gone", *(f"_g{i}" for i in range(len(group))))


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions that an assignment adds and removes: the columns of both and ``change``."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
