"""Messages delivered more than once: an index of identifiers seen.

The index is a set of immutable runs in the shared folder.  A run holds, per
hash prefix, one sorted array of identifier hashes beside the identifiers, and
lies in files by buckets of prefixes.  An incoming batch is folded to distinct
identifiers before any shuffle (a message copied a million times is one row per
input partition) and goes to those buckets: only the batch is shuffled, never
the index.  Each prefix of it is binary-searched in that prefix of every run,
and what is new becomes the next run.

Runs of like size are merged when ``merge_at`` of them have gathered, bucket by
bucket and again without a shuffle, so a batch looks into a number of arrays
that grows with the logarithm of the index, and an identifier is rewritten as
rarely.  When the index outgrows its prefixes it is laid out anew with longer
ones, so an array keeps its size.

Hashes only place an identifier; equality is decided on the identifier
itself, so a collision costs a comparison and not a record.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.shared import drop_path, list_names, new_path, path_exists, read_text, write_text

PREFIX_IDS = 32_768  # identifiers that a prefix of the index should hold
BUCKET_PREFIXES = 32  # prefixes that a bucket should hold: about a million identifiers
MAX_BUCKETS = 16_384  # files of a run; beyond it buckets hold more prefixes, one of which is in memory at a time
SEP = "\x1f"  # unit separator between the parts of an identifier
# What stands for a null part, the escape sign and the separator.
NULL, ESCAPED, SEPARATED = "\x1e0", "\x1e1", "\x1e2"


def identifier(*cols: str) -> Column:
    """An injective string of the columns, parted by SEP; null is its own value."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("\x1e"), F.lit(ESCAPED)), F.lit(SEP), F.lit(SEPARATED))
    return F.concat_ws(SEP, *(F.coalesce(escaped(F.col(c).cast("string")), F.lit(NULL)) for c in cols))


def split_identifier(ident: Column, types: dict[str, str]) -> list[Column]:
    """The columns that an identifier was made from, cast to their types."""
    parts = F.split(ident, SEP)
    plain = lambda c: F.replace(F.replace(c, F.lit(SEPARATED), F.lit(SEP)), F.lit(ESCAPED), F.lit("\x1e"))
    return [plain(F.nullif(parts.getItem(i), F.lit(NULL))).try_cast(t).alias(c) for i, (c, t) in enumerate(types.items())]


def prefix_bits(expected_ids: int) -> int:
    """Bits of prefix at which ``expected_ids`` identifiers give about PREFIX_IDS a prefix."""
    return max(0, min(40, math.ceil(math.log2(max(1, expected_ids / PREFIX_IDS)))))


def _search(batch: pa.Table, index: pa.Table, out: pa.Schema) -> pa.Table:
    """Mark the identifiers of one prefix that some run of the index holds."""
    h = batch.column("hash").to_numpy()
    ids = batch.column("ident")
    seen = np.zeros(len(h), bool)
    for k in range(index.num_rows):
        run = index.column("hashes")[k].values.to_numpy()
        names = index.column("idents")[k].values
        at = np.searchsorted(run, h)
        while True:
            hit = np.flatnonzero((at < len(run)) & ~seen)
            hit = hit[run[at[hit]] == h[hit]]
            if not len(hit):
                break
            same = pa.compute.equal(names.take(pa.array(at[hit])), ids.take(pa.array(hit)).combine_chunks()).to_numpy(zero_copy_only=False)
            seen[hit[same]] = True
            at[hit[~same]] += 1  # another identifier with this hash: try its neighbour
            done = np.ones(len(h), bool)
            done[hit[~same]] = False
            at[done] = len(run)
    return pa.Table.from_arrays([batch.column(f.name) if f.name != "seen" else pa.array(seen) for f in out], schema=out)


RUN = "prefix bigint, hashes array<bigint>, idents array<string>"


class IdIndex:
    """Identifiers seen so far, below the shared folder.

    What counts is the newest manifest: it names the runs and the batches taken
    in.  A batch is in the index once its manifest is written, as a whole; one
    that died before is taken in again, and one taken in again (same
    ``batch_id``) gets the result it got before.  One writer at a time: a second
    one fails on the manifest's number.
    """

    def __init__(self, spark: SparkSession, expected_ids: int, merge_at: int = 4, path: str | None = None):
        """Open the index at ``path``, or make one for about ``expected_ids`` identifiers (it grows beyond them)."""
        self.spark, self.merge_at = spark, merge_at
        self.path = path or new_path(spark, "ids")
        self.state = {"version": 0, "bits": prefix_bits(expected_ids), "generation": 0, "runs": {}, "batches": {}}
        known = [int(n.split("-")[1]) for n in list_names(spark, f"{self.path}/manifests") if n.startswith("m-") and not n.endswith(".tmp")]
        if known:
            self.state = json.loads(read_text(spark, f"{self.path}/manifests/m-{max(known):09d}"))
        self._name = f"ids_{uuid.uuid4().hex}"  # of this handle's table in the session's catalogue

    @property
    def runs(self) -> dict[str, int]:
        """Runs in force, with their numbers of identifiers."""
        return self.state["runs"]

    def _commit(self, **what) -> None:
        new = {**self.state, **what, "version": self.state["version"] + 1}
        write_text(self.spark, f"{self.path}/manifests/m-{new['version']:09d}", json.dumps(new))
        self.state = new

    def _prefix(self, bits: int | None = None) -> Column:
        bits = self.state["bits"] if bits is None else bits
        return F.shiftrightunsigned(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("bigint")

    def _buckets(self, bits: int) -> int:
        return max(1, min(MAX_BUCKETS, 2**bits // BUCKET_PREFIXES))

    def _table(self, bits: int, generation: int) -> str:
        """The runs of a generation as a bucketed table; made in the catalogue when it isn't there yet."""
        name = f"{self._name}_{generation}"
        if not self.spark.catalog.tableExists(name):
            buckets = self._buckets(bits)
            where = f"{self.path}/g-{generation}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({RUN}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (prefix) INTO {buckets} BUCKETS LOCATION '{where}'")
            if path_exists(self.spark, f"{self.path}/g-{generation}"):
                self.spark.catalog.recoverPartitions(name)
        return name

    def close(self) -> None:
        """Take this handle's table out of the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{self.state['generation']}")

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self._table(self.state["bits"], self.state["generation"])).filter(F.col("run").isin(runs))  # runs in force are few

    def _write(self, arrays: DataFrame, bits: int, generation: int) -> str:
        run = uuid.uuid4().hex
        arrays.select("prefix", F.col("a.hash").alias("hashes"), F.col("a.ident").alias("idents"), F.lit(run).alias("run")).write.insertInto(self._table(bits, generation))
        return run

    def _new_run(self, novel: DataFrame, bits: int, generation: int) -> str:
        """A run of the rows hash, ident."""
        placed = novel.select(self._prefix(bits).alias("prefix"), "hash", "ident").repartition(self._buckets(bits), "prefix")
        return self._write(placed.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("hash", "ident"))).alias("a")), bits, generation)

    def _level(self, n: int) -> int:
        return int(math.log(max(1, n), max(2, self.merge_at)))

    def _drop(self, generation: int, runs: list[str]) -> None:
        for r in runs:
            drop_path(self.spark, f"{self.path}/g-{generation}/run={r}")

    def merge(self, some: list[str]) -> None:
        """Merge runs into one; the old ones are dropped once the new manifest is there."""
        zipped = F.transform(F.arrays_zip("hashes", "idents"), lambda x: F.struct(x["hashes"].alias("hash"), x["idents"].alias("ident")))
        arrays = self._read(some).select("prefix", zipped.alias("z")).groupBy("prefix").agg(F.sort_array(F.flatten(F.collect_list("z"))).alias("a"))
        run = self._write(arrays, self.state["bits"], self.state["generation"])
        left = {r: n for r, n in self.runs.items() if r not in some} | {run: sum(self.runs[r] for r in some)}
        self._commit(runs=left)
        self._drop(self.state["generation"], some)

    def compact(self) -> None:
        """Merge all runs."""
        if len(self.runs) > 1:
            self.merge(list(self.runs))

    def _tidy(self) -> None:
        """Merge runs of like size, and lengthen the prefixes if they hold more than twice what they should."""
        total = sum(self.runs.values())
        if total > 2 * PREFIX_IDS * 2 ** self.state["bits"] and self.state["bits"] < 40:
            old, gone = self.state["generation"], list(self.runs)
            bits = prefix_bits(2 * total)
            flat = self._read(gone).select(F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("idents").alias("ident"))))
            run = self._new_run(flat, bits, old + 1)
            self._commit(bits=bits, generation=old + 1, runs={run: total})
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{old}")
            drop_path(self.spark, f"{self.path}/g-{old}")
            return
        while True:
            by: dict[int, list[str]] = {}
            for r, n in self.runs.items():
                by.setdefault(self._level(n), []).append(r)
            full = [rs for rs in by.values() if len(rs) >= self.merge_at]
            if not full:
                return
            self.merge(full[0])

    def accept(self, batch: DataFrame, ident: Column, order: Column, batch_id: str | None = None, step: Column | None = None) -> DataFrame:
        """Take in a batch; one row per distinct identifier of it.

        Columns: ident, n (its rows in the batch), first (the least ``order``
        among them, the copy to keep), seen (an earlier batch had it).  The
        result is a written table, so reading it again changes nothing.  Where
        the batch is made of several, ``step`` numbers them, and first is that
        of the least step which has the identifier.
        """
        batch_id = batch_id or uuid.uuid4().hex
        schema = "ident string, n bigint, first bigint, hash bigint, prefix bigint, seen boolean"
        if batch_id in self.state["batches"]:
            return self.spark.read.schema(schema).parquet(self.state["batches"][batch_id]).select("ident", "n", "first", "seen")
        self._tidy()  # what earlier batches left, before it is searched
        by = [ident.alias("ident")] if step is None else [ident.alias("ident"), step.alias("step")]
        local = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order).cast("bigint").alias("first"))
        local = local.withColumn("hash", F.xxhash64("ident")).withColumn("prefix", self._prefix())
        if step is not None:  # the steps of an identifier meet where its prefix of the index is
            local = local.repartition(self._buckets(self.state["bits"]), "prefix").groupBy("prefix", "hash", "ident")
            local = local.agg(F.sum("n").alias("n"), F.min_by("first", "step").alias("first")).select("ident", "n", "first", "hash", "prefix")
        if self.runs:
            from pyspark.sql.pandas.types import to_arrow_schema
            from pyspark.sql.types import StructType

            out = to_arrow_schema(StructType.fromDDL(schema))
            index = self._read(list(self.runs)).select("prefix", "hashes", "idents")
            marked = local.groupBy("prefix").cogroup(index.groupBy("prefix")).applyInArrow(lambda a, b: _search(a, b, out), schema)
        else:
            marked = local.withColumn("seen", F.lit(False))
        path = f"{self.path}/batch-{uuid.uuid4().hex}"
        marked.write.parquet(path)
        result = self.spark.read.schema(schema).parquet(path)
        novel = result.filter(~F.col("seen"))
        n = novel.count()
        runs = {**self.runs, self._new_run(novel, self.state["bits"], self.state["generation"]): n} if n else self.runs
        self._commit(runs=runs, batches={**self.state["batches"], batch_id: path})
        return result.select("ident", "n", "first", "seen")


def step_of(batch_col: str, span: int) -> Column:
    """The number of a batch's range of ``span`` values."""
    return F.floor(F.col(batch_col) / span)


def ingests(sizes: dict[int, int]) -> list[list[int]]:
    """Steps (number: rows) in order, gathered into ingests that each have at least as many rows as all before them.

    An ingest reads the whole index, as its identifiers fall on all prefixes.
    A backlog taken in by steps of one size would read it once a step; so
    gathered, all ingests together read about twice what the index holds in the
    end, and their number grows with the logarithm of the backlog.
    """
    out: list[list[int]] = []
    before, now = 0, 0
    for k in sorted(sizes):
        if not out or now >= max(1, before):
            out.append([])
            before, now = before + now, 0
        out[-1].append(k)
        now += sizes[k]
    return out


def deliver_once(df: DataFrame, id_cols: list[str], order_col: str, batch_col: str, *, span: int = 1, merge_at: int = 4, expected_ids: int = 0) -> DataFrame:
    """One row per identifier over all batches: ident, n (rows in all), first (order of the copy to keep).

    Batches are taken in in order, by steps of ``span`` numbers of ``batch_col``
    that are gathered into ``ingests``.  The copy to keep is the first of the
    earliest step that had the identifier, however steps are gathered; rows with
    a null batch come with the first step.  Without ``expected_ids`` the index
    is laid out for as many identifiers as there are rows.
    """
    spark = df.sparkSession
    step = step_of(batch_col, span)
    sizes = {k: n for k, n in df.groupBy(step.alias("k")).count().collect()}  # one row per step
    total, unknown = sum(sizes.values()), sizes.pop(None, 0)
    index = IdIndex(spark, expected_ids=expected_ids or total, merge_at=merge_at)
    taken = []
    if sizes:
        least = min(sizes)
        sizes[least] += unknown
        for ks in ingests(sizes):
            inside = (F.col(batch_col) >= ks[0] * span) & (F.col(batch_col) < (ks[-1] + 1) * span)
            part = df.filter(inside | F.col(batch_col).isNull() if ks[0] == least else inside)
            several = F.coalesce(step, F.lit(least)) if len(ks) > 1 else None
            taken.append(index.accept(part, identifier(*id_cols), F.col(order_col), f"{ks[0]}-{ks[-1]}", several))
    else:
        taken.append(index.accept(df, identifier(*id_cols), F.col(order_col), "0"))
    index.close()
    every = taken[0]
    for t in taken[1:]:
        every = every.unionByName(t)
    return every.groupBy("ident").agg(F.sum("n").alias("n"), F.min_by("first", "seen").alias("first"))
