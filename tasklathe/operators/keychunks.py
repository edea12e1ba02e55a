"""Per-key results without a straggler, by exact offset chunking.

Rows are range-partitioned by (key, order).  A key that holds a third of all
rows then spans a third of the partitions, because the order columns are part
of the range key.  Each partition

1. counts its rows per key,
2. cuts every key's run into chunks of at most ``chunk_rows`` rows, and
3. reduces a chunk to its boundary state: counts, sums, first and last row.

A window over the *states* (not the rows) turns the counts into prefix sums,
which number the rows of every chunk exactly, and joins neighbouring chunks at
their boundaries.  The hottest key contributes n / chunk_rows states.

Nulls in a key column form a key of their own.  Ties in the order columns are
broken by the columns that follow; rows equal in all of them are
interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

CHUNK_ROWS = 65_536


def _differs(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """For rows 1.. of a column: is it another value than the row before? Nulls are equal."""
    a, b = col[1:], col[:-1]
    ne = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _ints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an integer column with nulls as 0, and where it is not null."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False), pc.is_valid(col).to_numpy(zero_copy_only=False)


def _sums(v: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the pieces that begin at ``cut``; an error where one does not fit into 64 bits."""
    out = np.add.reduceat(v, cut)
    most = int(np.abs(v, dtype=np.float64).max(initial=0)) * int(np.diff(np.append(cut, len(v))).max(initial=0))
    if most >= 2**63:  # only then can a piece overflow
        exact = [sum(x.tolist()) for x in np.split(v, cut[1:])]
        if any(not -(2**63) <= x < 2**63 for x in exact):
            raise OverflowError("a sum does not fit into 64 bits")
    return out


def _reduce(batches: Iterable[pa.RecordBatch], n_keys: int, gap: int | None, nums: list[int], tails: list[int], chunk_rows: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId() if TaskContext.get() else 0
    big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    open_: dict | None = None

    def close(states: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([s["row"] for s in states], schema=out)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for i in range(n_keys):
            if n > 1:
                change[1:] |= _differs(b.column(i))
        starts = np.flatnonzero(change)
        held = 0
        if open_ is not None and all(b.column(i)[0].as_py() == open_["key"][i] for i in range(n_keys)):
            held = open_["row"]["n_rows"]
        # cut long runs so that no chunk exceeds chunk_rows, counting what the open chunk holds already
        cuts = [starts]
        ends = np.append(starts[1:], n)
        for s, e in zip(starts[(ends - starts) + np.where(starts == 0, held, 0) > chunk_rows], ends[(ends - starts) + np.where(starts == 0, held, 0) > chunk_rows]):
            cuts.append(np.arange(s + chunk_rows - (held if s == 0 else 0), e, chunk_rows))
        cut = np.unique(np.concatenate(cuts))
        cut = cut[cut < n]
        sizes = np.diff(np.append(cut, n))
        cols: dict[str, np.ndarray] = {}
        for j, i in enumerate(nums):
            v, ok = _ints(b.column(i))
            cols[f"c{j}"] = np.add.reduceat(ok.astype(np.int64), cut)
            cols[f"s{j}"] = _sums(v.astype(np.int64), cut)
            cols[f"lo{j}"] = np.minimum.reduceat(np.where(ok, v, big), cut)
            cols[f"hi{j}"] = np.maximum.reduceat(np.where(ok, v, small), cut)
        if gap is not None:
            g, _ = _ints(b.column(gap))
            d = np.empty(n, np.int64)
            d[0] = small
            d[1:] = g[1:] - g[:-1]
            d[cut] = small  # a chunk's first row has no neighbour inside it
            cols["gap"] = np.maximum.reduceat(d, cut)
            cols["first"], cols["last"] = g[cut], g[np.append(cut[1:], n) - 1]
        last_rows = np.append(cut[1:], n) - 1
        keys = [b.column(i).take(pa.array(cut)) for i in range(n_keys)]
        tail = [b.column(i).take(pa.array(last_rows)) for i in tails]
        done: list[dict] = []
        k0 = 0
        if held and sizes[0] + held <= chunk_rows and cut[0] == 0:  # the first piece goes on with the open chunk
            r = open_["row"]
            if gap is not None:
                r["max_gap"] = max([x for x in (r["max_gap"], int(cols["first"][0]) - r["last_at"], int(cols["gap"][0])) if x is not None and x != small], default=None)
                r["last_at"] = int(cols["last"][0])
            r["n_rows"] += int(sizes[0])
            for j in range(len(nums)):
                r[f"n_{j}"] += int(cols[f"c{j}"][0])
                r[f"sum_{j}"] += int(cols[f"s{j}"][0])
                r[f"min_{j}"] = min(r[f"min_{j}"], int(cols[f"lo{j}"][0]))
                r[f"max_{j}"] = max(r[f"max_{j}"], int(cols[f"hi{j}"][0]))
            for j in range(len(tails)):
                r[f"tail_{j}"] = tail[j][0].as_py()
            k0 = 1
        m = len(cut)
        if k0 < m and open_ is not None:
            done.append(open_)
        if k0 < m:
            same = np.zeros(m, bool)  # is the piece of the key of the piece before?
            same[1:] = ~change[cut[1:]]
            if held:
                same[0] = True
            chunk = open_["row"]["chunk_no"] if open_ is not None and held else 0
            # chunks of a key count up from 0, in the first key's run from where the open chunk left off
            place = np.arange(m)
            heads = np.maximum.accumulate(np.where(same, 0, place))
            nos = place - heads
            if held:
                first_run = np.cumsum(~same) == 0
                nos[first_run] = place[first_run] + chunk + (0 if k0 else 1)
            # whole pieces but the last are final: they leave as one batch built column by column
            lo, hi = k0, m - 1
            if done:
                yield close(done)
            if hi > lo:
                arrays = [k.slice(lo, hi - lo) for k in keys] + [pa.array(np.full(hi - lo, pid, np.int64)), pa.array(nos[lo:hi]), pa.array(sizes[lo:hi].astype(np.int64))]
                if gap is not None:
                    arrays += [pa.array(cols["first"][lo:hi]), pa.array(cols["last"][lo:hi]), pa.array(cols["gap"][lo:hi], mask=cols["gap"][lo:hi] == small)]
                for j in range(len(nums)):
                    arrays += [pa.array(cols[f"{x}{j}"][lo:hi]) for x in ("c", "s", "lo", "hi")]
                arrays += [t.slice(lo, hi - lo) for t in tail]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out)], schema=out)
            k = m - 1
            row = {out.field(i).name: keys[i][k].as_py() for i in range(n_keys)}
            row |= {"part_no": pid, "chunk_no": int(nos[k]), "n_rows": int(sizes[k])}
            if gap is not None:
                row |= {"first_at": int(cols["first"][k]), "last_at": int(cols["last"][k]), "max_gap": None if cols["gap"][k] == small else int(cols["gap"][k])}
            for j in range(len(nums)):
                row |= {f"n_{j}": int(cols[f"c{j}"][k]), f"sum_{j}": int(cols[f"s{j}"][k]), f"min_{j}": int(cols[f"lo{j}"][k]), f"max_{j}": int(cols[f"hi{j}"][k])}
            for j in range(len(tails)):
                row[f"tail_{j}"] = tail[j][k].as_py()
            open_ = {"key": [keys[i][k].as_py() for i in range(n_keys)], "row": row}
    if open_ is not None:
        yield close([open_])


def chunk_states(df: DataFrame, keys: list[str], order: list[str], *, gap_of: str | None = None, sums: list[str] = (), tails: list[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk of a key, in order.

    Columns: the keys, ``part_no`` and ``chunk_no`` (their order is the order of
    the rows), ``n_rows``, ``row_from``/``row_to`` (1-based row numbers in the
    key), and for every i-th column of ``sums`` (integers) ``n_i``, ``sum_i``,
    ``min_i``, ``max_i`` over its non-null values; for ``gap_of`` (an integer
    column without nulls) ``first_at``, ``last_at`` and ``max_gap``, the largest
    step between neighbouring rows inside the chunk; for ``tails`` the values
    of the chunk's last row as ``tail_i``.
    """
    sums, tails = list(sums), list(tails)
    wanted = list(dict.fromkeys([*keys, *order, *([gap_of] if gap_of else []), *sums, *tails]))
    own = {c: f"c{i}" for i, c in enumerate(wanted)}
    cols = df.select(*(F.col(f"`{c}`").alias(own[c]) for c in wanted))
    at = {c: i for i, c in enumerate(wanted)}
    by = [own[c] for c in dict.fromkeys([*keys, *order])]
    fields = [T.StructField(f"k{i}", cols.schema[own[k]].dataType) for i, k in enumerate(keys)]
    long = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    fields += long("part_no", "chunk_no", "n_rows")
    if gap_of:
        fields += long("first_at", "last_at", "max_gap")
    for j in range(len(sums)):
        fields += long(f"n_{j}", f"sum_{j}", f"min_{j}", f"max_{j}")
    fields += [T.StructField(f"tail_{j}", cols.schema[own[t]].dataType) for j, t in enumerate(tails)]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    args = (len(keys), at[gap_of] if gap_of else None, [at[c] for c in sums], [at[c] for c in tails], chunk_rows, out)
    states = cols.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _reduce(it, *args), schema)
    before = Window.partitionBy(*(f"k{i}" for i in range(len(keys)))).orderBy("part_no", "chunk_no")
    to = F.sum("n_rows").over(before.rowsBetween(Window.unboundedPreceding, 0))
    numbered = states.withColumn("row_to", to).withColumn("row_from", F.col("row_to") - F.col("n_rows") + 1)
    if gap_of:
        numbered = numbered.withColumn("max_gap", F.greatest("max_gap", F.col("first_at") - F.lag("last_at").over(before)))
    return numbered.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def per_key(df: DataFrame, keys: list[str], order: list[str], *, gap_of: str | None = None, sums: list[str] = (), tails: list[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Merge the ordered chunk states: one row per key.

    Columns: the keys, ``n_rows``, ``n_chunks``, and per ``sums`` / ``gap_of`` /
    ``tails`` the merged values under the names of :func:`chunk_states`
    (``first_at``/``last_at``: first and last row; ``tail_i``: last row of the
    key).  Sums over no value are 0 with ``n_i`` = 0 and null minimum and
    maximum; one that does not fit into 64 bits is an error.
    """
    s = chunk_states(df, keys, order, gap_of=gap_of, sums=sums, tails=tails, chunk_rows=chunk_rows)
    aggs = [F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_chunks")]
    if gap_of:
        aggs += [F.min_by("first_at", "row_from").alias("first_at"), F.max_by("last_at", "row_from").alias("last_at"), F.max("max_gap").alias("max_gap")]
    for j in range(len(sums)):
        some = F.col(f"n_{j}") > 0
        aggs += [F.sum(f"n_{j}").alias(f"n_{j}"), F.sum(f"sum_{j}").alias(f"sum_{j}"), F.min(F.when(some, F.col(f"min_{j}"))).alias(f"min_{j}"), F.max(F.when(some, F.col(f"max_{j}"))).alias(f"max_{j}")]
    aggs += [F.max_by(F.struct(f"tail_{j}"), "row_from").getField(f"tail_{j}").alias(f"tail_{j}") for j in range(len(tails))]
    return s.groupBy(*keys).agg(*aggs)


def heavy_keys(df: DataFrame, group: str, key: str, order: list[str], share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys with at least ``share`` of all rows of their group: group, key, n_rows, group_rows.

    Null and empty keys count towards the total and are never named.
    """
    counts = per_key(df, [group, key], order, chunk_rows=chunk_rows)
    # a count of rows per group folds before its shuffle; summing the counts would number the keys twice
    total = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("group_rows"))
    hot = counts.filter(F.col(key).isNotNull() & (F.length(key) > 0))
    return hot.join(total, hot[group].eqNullSafe(F.col("_g"))).filter(F.col("n_rows") >= F.lit(share) * F.col("group_rows")).select(group, key, "n_rows", "group_rows")
