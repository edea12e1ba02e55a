"""Percentiles per group over very many integers, by distributed multi-select.

``fold_values`` pre-aggregates to (group, value, count); that form is also what
is kept per day or partition, because such folds combine by adding up
(``combine``).  ``coarse`` bounds its size: it keeps ``bits`` leading bits of a
value, so the error is at most 2**-bits of the value and a group has at most
about 128 * 2**bits values, however many rows it has.

``multi_select`` finds every wanted quantile exactly within the folded values.
In each round every partition proposes its local medians of the ranges still
open, their weighted median becomes the pivot, one pass counts below, at and
above it, and the sides ruled out are dropped: once half of the candidates are
gone, the rest is written anew and the next rounds read only that.  What comes
down to ``FINISH`` candidates is settled in one sort; groups with no more values
than that to begin with are settled like this at once, without the driver.  Of
the others the driver holds one row per (group, quantile), ``MAX_STATES`` at a
time; more groups are written in slices, each of which reads only its own files.

The quantile q of n values is the least value that at least q * n of them do
not exceed (``quantile_disc``), q being the decimal number as it is written.
Null values are left out; a group without values has no row; a null group is a
group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklathe.shared import new_path, written

MAX_STATES = 50_000
FINISH = 512  # candidates of a (group, quantile) that one sort may settle
LO, HI = -(2**63), 2**63 - 1

_ROUND = "sid int, below bigint, at bigint, above bigint, left_mid bigint, right_mid bigint"


def coarse(value: Column, bits: int) -> Column:
    """``value`` with only its ``bits`` leading bits, at the middle of the range that shares them."""
    mag = F.abs(value)
    shift = F.greatest(F.length(F.bin(mag)) - bits, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", mag, shift), shift)
    mid = F.when(shift > 0, low + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(shift - 1, F.lit(0)))).otherwise(low)
    return F.when(value < 0, -mid).otherwise(mid)


def fold_values(df: DataFrame, group: list[str], value: Column, bits: int | None = None) -> DataFrame:
    """The columns ``group``, value (bigint) and n. ``bits``: keep so many leading bits of the values."""
    v = value.cast("bigint")
    v = coarse(v, bits) if bits else v
    return df.select(*group, v.alias("value")).filter("value is not null").groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(folded: DataFrame, group: list[str]) -> DataFrame:
    """Folds of separate days or partitions as one, over the coarser ``group``."""
    return folded.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def _mid(v: np.ndarray, cum: np.ndarray, a: int, b: int) -> int | None:
    """Weighted median of v[a:b]; cum has the weights' running sums with a leading 0."""
    if b <= a:
        return None
    return int(v[np.searchsorted(cum, (cum[a] + cum[b]) / 2, side="left").clip(a + 1, b) - 1])


def rank_of(q: float, n: int) -> int:
    """The rank of the quantile q among n values, without rounding."""
    x = Fraction(str(q))
    return max(1, -(-n * x.numerator // x.denominator))


def _gathered(batches: Iterator[pa.RecordBatch]):
    """Groups of a partition (of files of at most spark.sql.files.maxPartitionBytes): key, sorted values, running sums of their counts."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    keys = table.column("g").combine_chunks().dictionary_encode()
    codes, v, n = keys.indices.to_numpy(), table.column("value").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((v, codes))
    codes, v, n = codes[order], v[order], n[order]
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(codes))):
        yield keys.dictionary[int(codes[a])].as_py(), v[a:b], np.append(0, np.cumsum(n[a:b]))


def _count(batches: Iterator[pa.RecordBatch], states: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    rows = []
    for g, v, cum in _gathered(batches):
        for sid, lo, hi, pivot in states.get(g, ()):
            a, b = np.searchsorted(v, lo, "right") if lo > LO else 0, np.searchsorted(v, hi, "left") if hi < HI else len(v)
            if pivot is None:
                rows.append((sid, int(cum[b] - cum[a]), 0, 0, _mid(v, cum, a, b), None))
                continue
            p, q = max(a, np.searchsorted(v, pivot, "left")), min(b, np.searchsorted(v, pivot, "right"))
            rows.append((sid, int(cum[p] - cum[a]), int(cum[q] - cum[p]), int(cum[b] - cum[q]), _mid(v, cum, a, p), _mid(v, cum, q, b)))
    names = [x.split()[0] for x in _ROUND.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _open(v: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """Bounds of the values inside a range."""
    return (np.searchsorted(v, lo, "right") if lo > LO else 0), (np.searchsorted(v, hi, "left") if hi < HI else len(v))


def _kept(batches: Iterator[pa.RecordBatch], states: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows inside some range of their group that is still open."""
    for g, v, cum in _gathered(batches):
        keep = np.zeros(len(v) + 1, np.int64)
        for _, lo, hi, _ in states.get(g, ()):
            a, b = _open(v, lo, hi)
            if b > a:
                keep[a] += 1
                keep[b] -= 1
        inside = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        for c in range(0, len(inside), 65_536):
            at = inside[c : c + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(v[at]), pa.array(np.diff(cum)[at])], ["g", "value", "n"])


def _rest(batches: Iterator[pa.RecordBatch], states: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The candidates still open, of each state."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(3)], ["sid", "value", "n"])

    for g, v, cum in _gathered(batches):
        for sid, lo, hi, _ in states.get(g, ()):
            a, b = _open(v, lo, hi)
            if b > a:
                held.append((np.full(b - a, sid, np.int32), v[a:b], np.diff(cum[a : b + 1])))
                size += b - a
        if size > 50_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _select(data: DataFrame, states: dict[int, dict], finish: int) -> DataFrame:
    """Values of the states, as sid, value."""
    spark = data.sparkSession
    open_ = dict(states)
    found: dict[int, int] = {}
    whole = sum({s["g"]: s["n"] for s in open_.values()}.values())  # values that the rounds read

    def by_group(only=lambda s: True) -> dict[str, list[tuple]]:
        by: dict[str, list[tuple]] = {}
        for sid, s in open_.items():
            if only(s):
                by.setdefault(s["g"], []).append((sid, s["lo"], s["hi"], s["pivot"]))
        return by

    while any(s["left"] > finish for s in open_.values()):  # each round takes its pivot out at least
        sent = spark.sparkContext.broadcast(by_group(lambda s: s["left"] > finish))
        part = data.mapInArrow(lambda it, sent=sent: _count(it, sent.value), _ROUND)
        agg = part.groupBy("sid").agg(
            F.sum("below").alias("below"),
            F.sum("at").alias("at"),
            F.sum("above").alias("above"),
            F.floor(F.expr("percentile(left_mid, 0.5, below)")).alias("left_mid"),
            F.floor(F.expr("percentile(right_mid, 0.5, above)")).alias("right_mid"),
        )
        for r in agg.collect():  # at most MAX_STATES rows
            s = open_[r["sid"]]
            if s["pivot"] is None:
                s["left"], s["pivot"] = r["below"], r["left_mid"]
            elif s["rank"] <= r["below"]:
                s["hi"], s["left"], s["pivot"] = s["pivot"], r["below"], r["left_mid"]
            elif s["rank"] <= r["below"] + r["at"]:
                found[r["sid"]] = s["pivot"]
                del open_[r["sid"]]
            else:
                s["rank"] -= r["below"] + r["at"]
                s["lo"], s["left"], s["pivot"] = s["pivot"], r["above"], r["right_mid"]
        sent.unpersist()
        left = sum(s["left"] for s in open_.values())
        if left * 2 <= whole and any(s["left"] > finish for s in open_.values()):
            kept = spark.sparkContext.broadcast(by_group())
            data = written(data.mapInArrow(lambda it, kept=kept: _kept(it, kept.value), "g string, value bigint, n bigint"), "kept")
            kept.unpersist()
            whole = left
    done = spark.createDataFrame(list(found.items()), "sid int, value bigint")
    if not open_:
        return done
    # a state has few candidates left, whatever its group holds: one running sum finds its rank
    sent = spark.sparkContext.broadcast(by_group())  # at most MAX_STATES entries
    ranks = spark.createDataFrame([(sid, s["rank"]) for sid, s in open_.items()], "sid int, rank bigint")
    rest = data.mapInArrow(lambda it: _rest(it, sent.value), "sid int, value bigint, n bigint")
    upto = F.sum("n").over(Window.partitionBy("sid").orderBy("value"))
    at = rest.withColumn("upto", upto).join(ranks, "sid").filter("upto >= rank")
    return done.unionByName(at.groupBy("sid").agg(F.min("value").alias("value")))


def _settled(small: DataFrame, quantiles: list[float]) -> DataFrame:
    """Quantiles of groups with few values: g, quantile, value, n. A running sum over a group's values, and no driver."""
    w = Window.partitionBy("g").orderBy("value")
    summed = small.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    exact = [Fraction(str(q)) for q in quantiles]
    ranks = F.array(*(F.struct(F.lit(q).cast("double").alias("quantile"), F.greatest(F.lit(1), F.expr(f"(cast(all as decimal(20)) * {x.numerator} + {x.denominator - 1}) div {x.denominator}")).cast("bigint").alias("rank")) for q, x in zip(quantiles, exact)))
    # the value whose running sum reaches the rank, and whose predecessor's doesn't
    hit = summed.select("g", "value", "all", "upto", (F.col("upto") - F.col("n")).alias("before"), F.inline(ranks)).filter("rank <= upto and rank > before")
    return hit.select("g", "quantile", "value", F.col("all").alias("n"))


def multi_select(folded: DataFrame, group: list[str], quantiles: list[float], finish: int | None = None) -> DataFrame:
    """Quantiles of folded values: the columns ``group``, quantile, value, n (values of the group).

    ``folded`` has the columns ``group``, value, n and is written to the shared
    folder first.  With whole values the result is exact; with values folded by
    ``coarse`` it is exact among those.  ``finish``: how many candidates a sort
    may settle (default FINISH); the result is the same for any.
    """
    finish = FINISH if finish is None else finish
    spark = folded.sparkSession
    kind = T.StructType([folded.schema[c] for c in group])
    keyed = written(folded.select(F.to_json(F.struct(*group)).alias("g"), "value", "n"), "folded")
    sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    large = written(sizes.filter(F.col("m") > finish), "large")
    n_large = large.count()
    slices = max(1, -(-n_large * len(quantiles) // MAX_STATES))
    sliced = keyed.join(large.select("g", F.pmod(F.xxhash64("g"), F.lit(slices)).cast("int").alias("slice")), "g", "left")
    small = sliced.filter("slice is null").select("g", "value", "n")
    out = _settled(small, quantiles).select("g", "quantile", "value", "n")
    if n_large:
        path = new_path(spark, "slices")
        sliced.filter("slice is not null").write.partitionBy("slice").parquet(path)
        for k in range(slices):
            states: dict[int, dict] = {}
            for r in large.filter(F.pmod(F.xxhash64("g"), F.lit(slices)) == k).orderBy("g").collect():  # about MAX_STATES / len(quantiles) groups
                for q in quantiles:
                    states[len(states)] = {"g": r["g"], "q": q, "n": r["n"], "rank": rank_of(q, r["n"]), "lo": LO, "hi": HI, "left": r["n"], "pivot": None}
            if not states:
                continue
            part = spark.read.schema("g string, value bigint, n bigint").parquet(f"{path}/slice={k}")
            heads = spark.createDataFrame([(i, s["g"], float(s["q"]), s["n"]) for i, s in states.items()], "sid int, g string, quantile double, n bigint")
            out = out.unionByName(heads.join(_select(part, states, finish), "sid").select("g", "quantile", "value", "n"))
    return out.select(F.from_json("g", kind).alias("g"), "quantile", "value", "n").select("g.*", "quantile", "value", "n")
