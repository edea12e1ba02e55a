"""Filling containers of fixed capacity with texts, measured in tokens.

The plan is made over the histogram of lengths, not over documents: a text
longer than the capacity gives whole containers and a remainder, so at most
``capacity`` different lengths are left.  Best-fit decreasing runs on counts:
containers that look alike are one *class* with consecutive numbers, and
placing n items of a length splits at most one class.  The plan's cost depends
on the capacity alone.

Its *slots* say which ranks within a length go into which containers.
Documents are ranked within their length by exact offset chunking (counts per
slice, prefix sums, rank inside the slice), so a length that a third of all
documents share is ranked by many tasks, and take their slots in a join on
length and block of ranks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklathe.llm.tokens import VOCABULARY, token_counts
from tasklathe.shared import written

CAPACITY = 1024
SLICE_ROWS = 50_000  # rows of a length that one task ranks, on average
RANK_BLOCK = 65_536


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts: slots (length, rank_from, rank_to, container_from) and the number of containers.

    Rank r of a slot, from rank_from to rank_to, goes into container
    container_from + r - rank_from.  Ranks of a length start at 0.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # free space -> classes (first container, how many)
    slots: list[tuple[int, int, int, int]] = []
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                per = capacity // length
                full = -(-left // per)  # containers needed for what is left, each with up to `per` copies
                rooms.setdefault(capacity, []).append((made, full))
                made += full
                # fill them copy by copy; the last container takes what remains
                base, here = rooms[capacity].pop()
                if not rooms[capacity]:
                    del rooms[capacity]
                whole = left // per
                for copy in range(per):
                    n = whole + (1 if copy < left - whole * per else 0)
                    if n:
                        slots.append((length, rank, rank + n - 1, base))
                        rank += n
                if whole:
                    rooms.setdefault(capacity - per * length, []).append((base, whole))
                if here > whole:
                    rooms.setdefault(capacity - (left - whole * per) * length, []).append((base + whole, here - whole))
                left = 0
            else:
                classes = rooms[room]
                base, here = classes.pop()
                if not classes:
                    del rooms[room]
                n = min(left, here)
                slots.append((length, rank, rank + n - 1, base))
                rank, left = rank + n, left - n
                if room > length:
                    rooms.setdefault(room - length, []).append((base, n))
                if here > n:
                    rooms.setdefault(room, []).append((base + n, here - n))
    return slots, made


def ranked(items: DataFrame, length: str = "length", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``items`` with ``rank``, an exact rank from 0 within equal lengths; no task holds a whole hot length."""
    top = items.groupBy(length).count().agg(F.max("count")).first()[0] or 0
    n_slices = max(1, -(-top // slice_rows))
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64("id", "piece_no"), F.lit(n_slices)))
    before = Window.partitionBy(length).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(length, "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(length, "_slice").orderBy("id", "piece_no")) - 1
    return sliced.withColumn("_in", inside).join(offsets, [length, "_slice"]).withColumn("rank", F.col("_at") + F.col("_in")).drop("_slice", "_in", "_at")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers for (id, n_tokens): one row per piece with id, piece_no, token_from, length, container_no.

    An item is split only if it is longer than ``capacity``: into whole
    containers and one remainder that is packed like any other item.  Items
    without tokens need no room: they have one row with length 0 and a null
    container.  Rows with the same id are separate items; a null size counts as
    0, a negative one is an error.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    n = F.coalesce("n_tokens", F.lit(0))
    checked = F.when(n < 0, F.raise_error(F.lit("negative length"))).otherwise(n)
    sizes = written(sizes.select("id", checked.cast("bigint").alias("n_tokens")), "sizes")
    rest = sizes.select("id", F.floor(F.col("n_tokens") / capacity).alias("piece_no"), (F.col("n_tokens") % capacity).alias("length")).filter("length > 0")
    hist = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most capacity - 1 rows
    slots, made = plan(hist, capacity)
    table = spark.createDataFrame(slots, "length bigint, rank_from bigint, rank_to bigint, container_from bigint")
    blocks = F.explode(F.sequence(F.floor(F.col("rank_from") / RANK_BLOCK), F.floor(F.col("rank_to") / RANK_BLOCK)))
    table = table.withColumn("block", blocks)
    items = ranked(rest).withColumn("block", F.floor(F.col("rank") / RANK_BLOCK))
    i, s = items.alias("i"), table.alias("s")
    on = (F.col("i.length") == F.col("s.length")) & (F.col("i.block") == F.col("s.block")) & F.col("i.rank").between(F.col("s.rank_from"), F.col("s.rank_to"))
    packed = i.join(s, on).select("i.id", "i.piece_no", (F.col("i.piece_no") * capacity).alias("token_from"), "i.length", (F.col("s.container_from") + F.col("i.rank") - F.col("s.rank_from")).alias("container_no"))
    # whole pieces fill a container each; numbers go on after the planned ones
    long = sizes.filter(F.col("n_tokens") >= capacity).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_tokens") / capacity) - 1)).alias("piece_no"))
    whole = ranked(long.withColumn("length", F.lit(capacity).cast("bigint")))
    whole = whole.select("id", "piece_no", (F.col("piece_no") * capacity).alias("token_from"), "length", (F.col("rank") + made).alias("container_no"))
    none = sizes.filter("n_tokens = 0").select("id", F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("token_from"), F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("container_no"))
    return packed.unionByName(whole).unionByName(none)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` over the token counts of documents (doc_id, text)."""
    return pack(token_counts(docs, vocabulary=vocabulary), capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_tokens, unused (share of all room)."""
    placed = packed.filter("container_no is not null")
    return placed.agg(F.max("container_no").alias("last"), F.sum("length").alias("n_tokens")).select(
        (F.coalesce("last", F.lit(-1)) + 1).alias("n_containers"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.when(F.col("last").isNotNull(), 1 - F.col("n_tokens") / ((F.col("last") + 1) * capacity)).alias("unused"),
    )
