"""Processing only new or changed records: a ledger of work items.

A work item is pending, leased or done.  A lease carries a fencing token that
grows with every lease of the item and runs out at ``lease_until``; an item
whose lease ran out, failed or was rolled back is pending again.  Events are
ordered by their commit: each append takes the next number by creating its
manifest, which only one writer can.  A ``done`` event counts only with the
token of the latest lease committed before it, so a writer that was thought
dead can't overwrite its successor.  Output goes to a path that follows from
the lease, and is only read through the ledger: a retry can neither skip nor
repeat records.

``fold`` turns ledger events into states with one window over control rows;
reports of runs are replayed as such events (``events_of_reports``).
``uncovered`` finds the records that no finished work covers in their present
content.  Its cost follows the records: ranges are clipped to blocks of
offsets, made disjoint inside each block, and joined on the block, so that a
partition holding a third of all records is spread over its blocks.
"""

from __future__ import annotations

import heapq
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklathe.functions.times import zoneless_micros
from tasklathe.shared import drop_path, list_names, new_path, path_exists, write_text, written

BLOCK = 4096

# States of a run report and the events they are.
REPORT_EVENTS = {"running": "leased", "succeeded": "done", "failed": "failed"}
_FIRST = -(2**62)  # before all reports


def events_of_reports(reports: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Reports of runs as ledger events; a run is an item of its own, leased once, its number being item and owner.

    The lease comes before all reports.  A running report renews it for
    ``ttl_ms``; success is done, failure gives the item back, and a roll-back
    or an unknown state reopens it.
    """
    at = F.coalesce(_micros(reports, "reported_at"), F.lit(_FIRST + 1))
    event = F.lit("reopened")
    for state, name in REPORT_EVENTS.items():
        event = F.when(F.col("run_state") == state, F.lit(name)).otherwise(event)
    run = F.col("run_id").cast("string")
    said = reports.select(run.alias("item"), at.alias("seq"), event.alias("event"), F.coalesce(_micros(reports, "started_at"), F.lit(0)).alias("at"))
    one = lambda df, seq, event, at, until: df.select("item", seq.alias("seq"), event.alias("event"), F.lit(1).cast("bigint").alias("token"), F.col("item").alias("owner"), at.alias("at_ms"), until.alias("lease_until"), F.lit(None).cast("string").alias("path"))
    began = one(said.select("item").distinct(), F.lit(_FIRST), F.lit("leased"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return began.unionByName(one(said, F.col("seq"), F.col("event"), F.floor(F.col("at") / 1000), F.floor(F.col("seq") / 1000) + ttl_ms))


def states_of_reports(reports: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Latest state of every run, from the fold of its events: run_id, topic, partition_id, from_offset, to_offset, started_at, item_state.

    The report with the greatest reported_at decides (of equal ones the later
    started_at, then the state that sorts last); repeated reports change
    nothing.  An unknown or null state counts as pending, and so does a running
    one whose lease ran out at ``now_ms`` (None: no lease runs out).
    """
    reports = reports.filter("run_id is not null")
    latest = reports.groupBy("run_id").agg(
        F.max(F.struct("reported_at", "started_at", "run_state", "topic", "partition_id", "from_offset", "to_offset")).alias("r")
    )
    states = fold(events_of_reports(reports), now_ms if now_ms is not None else _FIRST).select(F.col("item").cast("bigint").alias("run_id"), F.col("state").alias("item_state"))
    return latest.join(states, "run_id").select("run_id", "r.topic", "r.partition_id", "r.from_offset", "r.to_offset", "r.started_at", "item_state")


def disjoint(ranges: list[tuple[int, int, int]]) -> list[list[int]]:
    """Disjoint (lo, hi, greatest start of the ranges that cover it) of (lo, hi, start), by a sweep over their edges."""
    starts = sorted(ranges)
    edges = sorted({r[0] for r in ranges} | {r[1] + 1 for r in ranges})
    rows: list[list[int]] = []
    heap: list[tuple[int, int]] = []
    i = 0
    for a, b in zip(edges, edges[1:]):
        while i < len(starts) and starts[i][0] <= a:
            heapq.heappush(heap, (-starts[i][2], starts[i][1]))
            i += 1
        while heap and heap[0][1] < a:
            heapq.heappop(heap)
        if heap:
            if rows and rows[-1][1] == a - 1 and rows[-1][2] == -heap[0][0]:
                rows[-1][1] = b - 1
            else:
                rows.append([a, b - 1, -heap[0][0]])
    return rows


def _sweep(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Disjoint ranges of each block; rows come block by block."""
    names = ["topic", "partition_id", "block", "lo", "hi", "started_at"]
    held, at = [], None
    for pdf in pdfs:
        out = []
        for t, p, b, lo, hi, start in pdf.itertuples(index=False):
            if (t, p, b) != at:
                out += [(*at, *r) for r in disjoint(held)] if held else []
                held, at = [], (t, p, b)
            held.append((lo, hi, start))
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([(*at, *r) for r in disjoint(held)], columns=names)


def covered_ranges(done: DataFrame, extent: DataFrame, block: int = BLOCK) -> DataFrame:
    """Disjoint ranges of finished work per block of offsets, with the latest start (microseconds).

    ``extent`` has the least and greatest offset per topic and partition; work
    outside it is cut off, so that a range to infinity costs nothing.  Equal
    clipped ranges are folded before the shuffle; what is left of a block is at
    most one row per distinct pair of its ``block`` offsets.
    """
    clipped = (
        done.select("topic", "partition_id", "from_offset", "to_offset", "started_at")
        .join(extent, ["topic", "partition_id"])
        .select("topic", "partition_id", "started_at", F.greatest("from_offset", "least").alias("lo"), F.least("to_offset", "greatest").alias("hi"))
        .filter("lo <= hi")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
        .withColumn("lo", F.greatest("lo", F.col("block") * block))
        .withColumn("hi", F.least("hi", F.col("block") * block + (block - 1)))
    )
    folded = clipped.groupBy("topic", "partition_id", "block", "lo", "hi").agg(F.max(_micros(done, "started_at")).alias("started_at"))
    by = ["topic", "partition_id", "block"]
    return folded.repartition(*by).sortWithinPartitions(*by).mapInPandas(_sweep, "topic string, partition_id int, block bigint, lo bigint, hi bigint, started_at bigint")


def _micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 of a time column; one without a zone is taken as it stands, whatever the session's zone."""
    if df.schema[col].dataType.simpleString() == "timestamp_ntz":
        return zoneless_micros(F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))


def uncovered(records: DataFrame, done: DataFrame, block: int = BLOCK) -> DataFrame:
    """Positions of ``records`` that still have to be processed.

    ``records``: topic, partition_id, record_offset, task_bytes, landed_at.
    ``done``: finished work with topic, partition_id, from_offset, to_offset
    (both inclusive), started_at.  A position is returned once if no work
    covers it or one of its contents (distinct task_bytes, null is one) first
    landed at or after the latest start of the work covering it.  Rows without
    a position are left out; a null landed_at counts as landed before all work;
    work with a null bound or start covers nothing.
    """
    placed = records.select("topic", "partition_id", "record_offset", "task_bytes", "landed_at").filter("topic is not null and partition_id is not null and record_offset is not null")
    contents = placed.groupBy("topic", "partition_id", "record_offset", "task_bytes").agg(F.min(_micros(records, "landed_at")).alias("landed"))
    newest = contents.groupBy("topic", "partition_id", "record_offset").agg(F.max("landed").alias("landed"))
    newest = newest.withColumn("block", F.floor(F.col("record_offset") / block))
    extent = placed.groupBy("topic", "partition_id").agg(F.min("record_offset").alias("least"), F.max("record_offset").alias("greatest"))
    whole = done.filter("topic is not null and partition_id is not null and from_offset is not null and to_offset is not null and started_at is not null")
    ranges = covered_ranges(whole, extent, block)
    n, r = newest.alias("n"), ranges.alias("r")
    on = (
        (F.col("n.topic") == F.col("r.topic"))
        & (F.col("n.partition_id") == F.col("r.partition_id"))
        & (F.col("n.block") == F.col("r.block"))
        & F.col("n.record_offset").between(F.col("r.lo"), F.col("r.hi"))
    )
    return (
        n.join(r, on, "left")
        .filter(F.col("r.started_at").isNull() | (F.col("n.landed") >= F.col("r.started_at")))
        .select("n.topic", "n.partition_id", "n.record_offset")
    )


def pending_of_reports(records: DataFrame, reports: DataFrame, block: int = BLOCK) -> DataFrame:
    """``uncovered`` against the runs whose latest report says succeeded."""
    return uncovered(records, states_of_reports(reports).filter("item_state = 'done'"), block)


def item_of(block: int = BLOCK) -> Column:
    """Name of the work item that a position belongs to."""
    return F.concat_ws("/", F.col("topic"), F.col("partition_id").cast("string"), F.floor(F.col("record_offset") / block).cast("string"))


def work_items(pending: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pending positions as ledger items, one per block of offsets: item, n, from_offset, to_offset.

    Items are folded before the shuffle and hold at most ``block`` positions,
    so a partition with most of the work is many items.
    """
    return pending.groupBy(item_of(block).alias("item")).agg(F.count(F.lit(1)).alias("n"), F.min("record_offset").alias("from_offset"), F.max("record_offset").alias("to_offset"))


def process_pending(pending: DataFrame, owner: str, now_ms: int, path: str | None = None, ttl_ms: int = 600_000, block: int = BLOCK) -> Ledger:
    """One incremental run over ``pending`` (topic, partition_id, record_offset): its items are planned, leased, written and finished.

    Returns the ledger; ``outputs`` gives what was accepted.  With the ``path``
    of an earlier run its ledger is carried on: items done before are reopened
    if they have pending positions again, leased ones stay with their holder.
    """
    spark = pending.sparkSession
    rows = written(pending.withColumn("item", item_of(block)), "pending")
    ledger = Ledger(spark, path or new_path(spark, "ledger"))
    items = rows.select("item").distinct()
    ledger.plan(items)
    if path is not None:
        ledger.reopen(items)
    ledger.run_all(owner, lambda leases: rows.join(leases.select("item"), "item"), now_ms, ttl_ms)
    return ledger


# --- the ledger itself -------------------------------------------------------

EVENTS = "item string, event string, token bigint, owner string, at_ms bigint, lease_until bigint, path string"


def _order() -> list[Column]:
    return [F.col("seq"), F.col("at_ms"), F.col("event") == "done", F.col("event")]


def accepted(events: DataFrame) -> DataFrame:
    """The events that count: all but done and failed with another token than that of the latest lease before them."""
    w = Window.partitionBy("item").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    current = F.max(F.when(F.col("event") == "leased", F.col("token"))).over(w)
    return events.withColumn("_cur", current).filter(F.col("event").isin("planned", "leased", "reopened") | (F.col("token") == F.col("_cur")))


def fold(events: DataFrame, now_ms: int) -> DataFrame:
    """State of every item: item, state, token, owner, path.

    Events: planned, leased, done, failed, reopened, with ``seq``, the order of
    their commits.  ``token`` is that of the latest lease (0 without one),
    ``path`` that of the accepted done event.  done and failed count only with
    the token of the latest lease before them; the last event that counts says
    the state. A pending item has no owner.
    """
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_order())))
    last = accepted(events).groupBy("item").agg(F.max_by(F.struct("event", "owner", "lease_until", "path"), order).alias("l"), F.max("_cur").alias("token"))
    leased = (F.col("l.event") == "leased") & ((F.col("l.lease_until") > now_ms) | F.lit(now_ms == _FIRST))
    state = F.when(F.col("l.event") == "done", "done").when(leased, "leased").otherwise("pending")
    return last.select("item", state.alias("state"), F.coalesce("token", F.lit(0)).alias("token"), F.when(state != "pending", F.col("l.owner")).alias("owner"), F.when(F.col("l.event") == "done", F.col("l.path")).alias("path"))


class Ledger:
    """An append-only ledger below ``path`` (a folder all executors share), for any number of workers.

    An append writes its events to a file and then creates the manifest with
    the next number, which names that file; the number is the events' ``seq``.
    Of several writers one gets the number, the others look again at what they
    were about to say: leases and results are decided on the state right before
    their commit.  Nothing is rewritten, so a call that dies half-way leaves the
    ledger as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int:
        return max((int(n[2:]) for n in list_names(self.spark, f"{self.path}/manifests") if n.startswith("m-") and not n.endswith(".tmp")), default=0)

    def events(self, upto: int | None = None) -> DataFrame:
        """All events committed, or those up to a number, with ``seq``."""
        top = self._version() if upto is None else upto
        schema = f"{EVENTS}, seq bigint"
        if not top:
            return self.spark.createDataFrame([], schema)
        names = self.spark.read.option("pathGlobFilter", "m-?????????").text(f"{self.path}/manifests", wholetext=True)
        said = names.select(F.regexp_extract(F.col("_metadata.file_name"), r"m-(\d+)", 1).cast("bigint").alias("seq"), F.trim("value").alias("part")).filter(F.col("seq") <= top)
        rows = self.spark.read.schema(f"{EVENTS}, part string").parquet(f"{self.path}/events")
        return rows.join(said, "part").drop("part")  # a row per append on the right

    def _append(self, make: Callable[[DataFrame], DataFrame | None]) -> tuple[DataFrame, int] | None:
        """Commit the events that ``make`` draws from the events so far; None if it draws none."""
        while True:
            seen = self._version()
            rows = make(self.events(seen))
            part = uuid.uuid4().hex
            where = f"{self.path}/events/part={part}"
            rows.selectExpr(*(f"cast({f.split()[0]} as {f.split()[1]}) {f.split()[0]}" for f in EVENTS.split(", "))).write.parquet(where)
            mine = self.spark.read.schema(EVENTS).parquet(where)
            if mine.isEmpty():
                drop_path(self.spark, where)
                return None
            try:
                write_text(self.spark, f"{self.path}/manifests/m-{seen + 1:09d}", part)
                return mine, seen + 1
            except FileExistsError:  # another commit came first
                drop_path(self.spark, where)

    def states(self, now_ms: int | None = None) -> DataFrame:
        return fold(self.events(), now_ms if now_ms is not None else int(time.time() * 1000))

    def plan(self, items: DataFrame) -> None:
        """Add items (column ``item``) that the ledger doesn't know yet; planning again changes nothing."""

        def make(events: DataFrame) -> DataFrame:
            new = items.select("item").filter("item is not null").distinct().join(events.select("item").distinct(), "item", "left_anti")
            return new.selectExpr("item", "'planned' event", "0 token", "null owner", "0 at_ms", "null lease_until", "null path")

        self._append(make)

    def reopen(self, items: DataFrame) -> None:
        """Items that are done, but whose records changed or were rolled back, are pending again."""

        def make(events: DataFrame) -> DataFrame:
            done = fold(events, 0).filter("state = 'done'").join(items.select("item").distinct(), "item", "left_semi")
            return done.selectExpr("item", "'reopened' event", "token", "null owner", "0 at_ms", "null lease_until", "null path")

        self._append(make)

    def lease(self, owner: str, now_ms: int, ttl_ms: int, limit: int | None = None) -> DataFrame:
        """Lease pending items to ``owner``: item, token, path (where to write). ``limit``: how many at most (the least items first)."""

        def make(events: DataFrame) -> DataFrame:
            free = fold(events, now_ms).filter("state = 'pending'")
            free = free.orderBy("item").limit(limit) if limit is not None else free
            until = F.lit(now_ms + ttl_ms).cast("bigint")
            return free.select("item", F.lit("leased").alias("event"), (F.col("token") + 1).alias("token"), F.lit(owner).alias("owner"), F.lit(now_ms).cast("bigint").alias("at_ms"), until.alias("lease_until"), F.lit(None).cast("string").alias("path"))

        got = self._append(make)
        if got is None:
            return self.spark.createDataFrame([], "item string, token bigint, path string")
        rows, seq = got
        return rows.select("item", "token", F.lit(self.output_path(seq)).alias("path"))

    def finish(self, leases: DataFrame, owner: str, now_ms: int, ok: bool = True) -> int:
        """Report leases (item, token, path) done or failed; how many of them counted: not those a later lease fenced off."""

        def make(events: DataFrame) -> DataFrame:
            mine = leases.select("item", "token", "path").join(fold(events, _FIRST).filter("state = 'leased'").select("item", "token"), ["item", "token"])
            path = F.col("path") if ok else F.lit(None).cast("string")
            return mine.select("item", F.lit("done" if ok else "failed").alias("event"), "token", F.lit(owner).alias("owner"), F.lit(now_ms).cast("bigint").alias("at_ms"), F.lit(None).cast("bigint").alias("lease_until"), path.alias("path"))

        got = self._append(make)
        return got[0].count() if got else 0

    def output_path(self, lease: int) -> str:
        """Where the holder of the leases of a commit writes: a retry overwrites itself, and no other lease has the path."""
        return f"{self.path}/out/lease={lease}"

    def run_all(self, owner: str, work: Callable[[DataFrame], DataFrame], now_ms: int, ttl_ms: int = 600_000, limit: int | None = None) -> int:
        """Lease items, write ``work(leases)`` in one go and report it; how many items were done.

        ``work`` makes rows with a column ``item`` for the leases' items.  If it
        fails the items are reported failed, and pending again.
        """
        leases = self.lease(owner, now_ms, ttl_ms, limit)
        first = leases.first()
        if first is None:
            return 0
        try:
            work(leases).write.mode("overwrite").parquet(first["path"])
        except Exception:
            self.finish(leases, owner, now_ms, ok=False)
            raise
        return self.finish(leases, owner, now_ms)

    def outputs(self) -> DataFrame | None:
        """The rows of accepted outputs, with ``lease``: those of an item from the paths that its accepted done events name. None before the first.

        An item that was reopened has an output of each time; of a record in
        several of them the one with the greatest ``lease`` is the latest.
        """
        if not path_exists(self.spark, f"{self.path}/out"):
            return None
        done = accepted(self.events()).filter("event = 'done'").select("item", F.regexp_extract("path", r"lease=(\d+)$", 1).cast("int").alias("lease")).distinct()
        return self.spark.read.parquet(f"{self.path}/out").join(done, ["item", "lease"], "left_semi")
