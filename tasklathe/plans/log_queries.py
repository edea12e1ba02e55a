"""Queries for the log-processing operators, on the task log mapped from ``events`` and on ``processed_tasks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe import config
from tasklathe.functions.wire import METADATA_TYPE, decode_envelope, decode_metadata, encode_envelope, encode_metadata
from tasklathe.landed import table, task_id
from tasklathe.operators import batching, checks, client, commit, compaction, extract, filters, metrics, partitioner, quota, retry, schedule
from tasklathe.tasklog import LOG_SQL, task_log

HOUR = 3_600_000
BLOCKED = ["3", "7", "11", "42"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if sql.lstrip().lower().startswith("with recursive") else f"with {LOG_SQL}{sql}"
        return f

    return add


_ANCHORED = f"""
with recursive {LOG_SQL.replace('%', '%%')}, keyed as (select *, row_number() over (partition by k order by t, o) as i from tlog %(filter)s),
fold as (
  select k, o, t, value, p, i, t as w0 from keyed where i = 1
  union all
  select n.k, n.o, n.t, n.value, n.p, n.i, case when n.t >= f.w0 + %(w)d then n.t else f.w0 end
  from fold f join keyed n on n.k = f.k and n.i = f.i + 1)
"""


def _survivor(order: str, w: int = HOUR, where: str = "") -> str:
    return _ANCHORED % {"w": w, "filter": where} + f"select k, w0, count(*) as n, arg_max(o, {order}) as o, arg_max(t, {order}) as t from fold group by k, w0"


# --- filtering, compaction, counters ----------------------------------------


@query(_ANCHORED % {"w": HOUR, "filter": "where k not in ('3', '7', '11', '42')"} + """
, s as (select k, w0, count(*) as n, arg_max(p, (value, o)) as p from fold group by k, w0)
select p, count(*) as windows, cast(sum(n) as bigint) as tasks, cast(sum(n - 1) as bigint) as compacted from s group by p
""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Key-filtered log, compacted per key, counted per partition."""
    log = filters.ignore_keys(task_log(spark, d), "k", BLOCKED)
    c = compaction.compact(log, "k", "t", "o", HOUR, "max", F.col("value"))
    per = c.withColumn("p", F.pmod(F.col("k").cast("bigint"), F.lit(4)).cast("int"))
    return per.groupBy("p").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("tasks"), F.sum(F.col("n") - 1).alias("compacted"))


@query("select p, o, k from tlog where k not in ('3', '7', '11', '42')")
def key_filter(spark, d):
    return filters.ignore_keys(task_log(spark, d), "k", BLOCKED).select("p", "o", "k")


@query("select p, o, k from tlog where k not in (select k from tlog group by k having count(*) filter (where event_type = 'error') >= 20)")
def dynamic_key_filter(spark, d):
    log = task_log(spark, d)
    noisy = log.groupBy("k").agg(F.count_if(F.col("event_type") == "error").alias("n")).filter("n >= 20").select("k")
    return filters.ignore_keys_of(log, "k", noisy).select("p", "o", "k")


@query(_survivor("o"))
def compaction_latest(spark, d):
    return compaction.compact(task_log(spark, d), "k", "t", "o", HOUR)


@query(_survivor("(value, o)"))
def compaction_max(spark, d):
    return compaction.compact(task_log(spark, d), "k", "t", "o", HOUR, "max", F.col("value"))


@query(_survivor("-o", 6 * HOUR))
def compaction_pick_left(spark, d):
    return compaction.compact(task_log(spark, d), "k", "t", "o", 6 * HOUR, "first")


@query(_ANCHORED % {"w": HOUR, "filter": ""} + "select k, w0, arg_max(o, (value, o)) as o from fold group by k, w0")
def compaction_custom(spark, d):
    log = task_log(spark, d).select("k", "t", "o", "value")
    larger = lambda a, b: compaction.PICK_LEFT if a["value"] > b["value"] else compaction.PICK_EITHER
    return compaction.compact_with(log, "k", "t", "o", HOUR, larger, associative=True).select("k", "w0", "o")


@query(_ANCHORED % {"w": HOUR, "filter": ""} + ", s as (select count(*) as n from fold group by k, w0) select count(*) as flushed, cast(sum(n - 1) as bigint) as compacted from s")
def compaction_counters(spark, d):
    return compaction.survivors_per_window(compaction.compact(task_log(spark, d), "k", "t", "o", HOUR))


# --- batching ----------------------------------------------------------------


@query("""
, b as (select p, cast(0 as bigint) as tick, cast(o // 7 as bigint) as batch_no, o from tlog)
select p, tick, batch_no, count(*) as size, min(o) as first_offset, max(o) as last_offset, count(*) = 7 as "full" from b group by p, tick, batch_no
""")
def batch_capacity(spark, d):
    return batching.flushed(batching.batches(task_log(spark, d), ["p"], "t", "o", 7), ["p"], "o", 7)


_BATCHED = f"""
, s as (select *, t // {6 * HOUR} as tick, row_number() over (partition by p, t // {6 * HOUR} order by o) - 1 as seq from tlog),
b as (select *, seq // 5 as batch_no from s)
"""


@query(_BATCHED + """select p, tick, batch_no, count(*) as size, min(o) as first_offset, max(o) as last_offset, count(*) = 5 as "full" from b group by p, tick, batch_no""")
def batch_linger_capacity(spark, d):
    return batching.flushed(batching.batches(task_log(spark, d), ["p"], "t", "o", 5, 6 * HOUR), ["p"], "o", 5)


@query(_BATCHED + "select p, tick, batch_no, string_agg(k, ',' order by o) as keys from b group by p, tick, batch_no")
def batch_items(spark, d):
    got = batching.collected(batching.batches(task_log(spark, d), ["p"], "t", "o", 5, 6 * HOUR), ["p"], "o", F.col("k"))
    return got.select("p", "tick", "batch_no", F.concat_ws(",", "items").alias("keys"))


@query("""
, c as (select p, o, case when event_type = 'error' then cast(0 as bigint) when event_type = 'signup' then cast(-1 as bigint) else cast(floor(value) as bigint) end as v from tlog)
select p, o, v, last_value(case when v > 0 then v end ignore nulls) over (partition by p order by o) as effective from c
""")
def last_known_good(spark, d):
    v = F.when(F.col("event_type") == "error", F.lit(0)).when(F.col("event_type") == "signup", F.lit(-1)).otherwise(F.floor("value")).cast("bigint")
    return batching.last_known_good(task_log(spark, d).select("p", "o", v.alias("v")), ["p"], "o", "v")


# --- scheduling and rate limits ------------------------------------------------


@query("select p, o, greatest(t, scheduled) as start_ms, greatest(t, scheduled) - t as delay from tlog")
def scheduled_start(spark, d):
    start = schedule.scheduled_start(F.col("t"), F.col("scheduled"))
    return task_log(spark, d).select("p", "o", start.alias("start_ms"), (start - F.col("t")).alias("delay"))


@query("""
, s as (select p, o, d, greatest(t, scheduled) as ready, sum(d) over (partition by p order by o) as s from tlog),
m as (select *, max(ready - (s - d)) over (partition by p order by o) as m from s)
select p, o, cast(s + m - d as bigint) as start, cast(s + m as bigint) as finish from m
""")
def fifo_service(spark, d):
    log = task_log(spark, d)
    ready = schedule.scheduled_start(F.col("t"), F.col("scheduled"))
    return schedule.fifo_service(log, ["p"], "o", ready, F.col("d")).select("p", "o", "start", "finish")


def _bucket(scope: str, each: float, burst: float, permits: str = "1", source: str = "tlog", n: str = "") -> str:
    return f"""
, r{n} as (select *, {permits} as permits, t - min(t) over (partition by {scope}) as rel from {source}),
u{n} as (select *, sum(permits) over (partition by {scope} order by o) - permits as used from r{n}),
m{n} as (select *, max(rel - {burst} - used * {each}) over (partition by {scope} order by o rows between unbounded preceding and 1 preceding) as m from u{n}),
w{n} as (select *, round(greatest(0, greatest(used * {each}, used * {each} + coalesce(m, -1e18)) - rel), 3) as wait from m{n})
"""


@query(_bucket("p", 600_000.0, 3_600_000.0) + "select p, o, wait from w")
def token_bucket(spark, d):
    """One permit each ten minutes, an hour's worth of burst."""
    return schedule.token_bucket(task_log(spark, d), ["p"], "o", F.col("t"), 1 / 600, 3600).select("p", "o", F.round("wait", 3).alias("wait"))


@query(_bucket("p", 300_000.0, 3_600_000.0, "1 + (o % 4)") + "select p, o, wait from w")
def token_bucket_permits(spark, d):
    n = F.col("o") % 4 + 1
    return schedule.token_bucket(task_log(spark, d), ["p"], "o", F.col("t"), 1 / 300, 3600, permits=n).select("p", "o", F.round("wait", 3).alias("wait"))


@query(f""", e as (select *, cast((t // 86400000) % 3 as int) as epoch from tlog)
{_bucket("p, epoch", 600_000.0, 3_600_000.0, source="e where epoch = 0", n="0")}
{_bucket("p, epoch", 900_000.0, 3_600_000.0, source="e where epoch = 1")}
select p, o, epoch, wait from w0 union all select p, o, epoch, wait from w union all select p, o, epoch, 0.0::double from e where epoch = 2
""")
def token_bucket_epochs(spark, d):
    log = task_log(spark, d).withColumn("epoch", (F.floor(F.col("t") / 86400000) % 3).cast("int"))
    got = schedule.token_bucket_epochs(log, ["p"], "o", F.col("t"), "epoch", {0: 1 / 600, 1: 1 / 900}, 3600)
    return got.select("p", "o", "epoch", F.round("wait", 3).alias("wait"))


@query(", r as (select case when k % 3 = 0 then 'events-shaping' else 'events' end as topic, p, o, case when k % 2 = 0 then 50 end as override from (select p, o, cast(k as int) as k from tlog))"
       " select topic, p, o, case when topic = 'events-shaping' then coalesce(override, 20) else -1 end as rate from r")
def rate_selection(spark, d):
    k = F.col("k").cast("int")
    topic = F.when(k % 3 == 0, "events-shaping").otherwise("events")
    rate = schedule.selected_rate(F.col("topic"), F.lit("events-shaping"), F.when(k % 2 == 0, 50), F.lit(20), F.lit(-1))
    return task_log(spark, d).withColumn("topic", topic).select("topic", "p", "o", rate.alias("rate"))


# --- quotas --------------------------------------------------------------------

W6 = 6 * HOUR
_STAT = f"""
with recursive {LOG_SQL}, chain as (
  select p, o, t, k, event_type, t as w0 from tlog where o = 0
  union all
  select n.p, n.o, n.t, n.k, n.event_type, case when n.t >= c.w0 + {W6} then n.t else c.w0 end from chain c join tlog n on n.p = c.p and n.o = c.o + 1),
wins as (select p, w0, lag(w0) over (partition by p order by w0) as prev from (select distinct p, w0 from chain)),
tot as (select p, w0, k, count(*) as n from chain group by all),
j as (
  select c.*, w.prev, coalesce(q.n, 0) as before, row_number() over (partition by c.p, c.w0, c.k order by c.o) as mine
  from chain c join wins w on c.p = w.p and c.w0 = w.w0 left join tot q on q.p = c.p and q.w0 = w.prev and q.k = c.k),
stat as (
  select p, o, k, t, event_type, case when prev >= t - {2 * W6} then prev else w0 end as from_ms, t as to_ms,
         mine + case when prev >= t - {2 * W6} then before else 0 end as n from j),
verdict as (select *, n / nullif(to_ms - from_ms, 0) * 1000 as observed,
  case when k = '5' or to_ms - from_ms < {W6} or to_ms = from_ms or n / (to_ms - from_ms) * 1000 < 0.0001 then 'COMPLY' else 'VIOLATE' end as type from stat)
"""


def _stat(spark, d):
    return quota.windowed_key_stat(task_log(spark, d), "p", "k", "t", "o", W6)


@query(_STAT + "select p, o, k, from_ms, to_ms, n from stat")
def windowed_key_stat(spark, d):
    return _stat(spark, d).select("p", "o", "k", "from_ms", "to_ms", "n")


QUOTA = quota.QuotaConfig(rate=0.0001, window_ms=W6)


def _decided(spark, d):
    s = _stat(spark, d).withColumn("key", F.when(F.col("k") != "5", F.col("k")))
    return quota.decided(s, "events", "topic", "key", QUOTA)


def _decided_scope(spark, d):
    """Decisions where every third row came on the shaping topic."""
    s = _stat(spark, d).withColumn("key", F.when(F.col("k") != "5", F.col("k")))
    s = s.withColumn("topic", F.when(F.col("o") % 3 == 0, "events-shaping").otherwise("events"))
    return quota.decided(s, "events", "topic", "key", QUOTA)


@query(_STAT + "select p, o, type, round(case when type = 'VIOLATE' then observed end, 9) as rate from verdict")
def quota_decision(spark, d):
    return _decided(spark, d).select("p", "o", "usage.type", F.round("usage.rate", 9).alias("rate"))


@query(_STAT + "select p, o, case when type = 'COMPLY' then 'events' when observed >= 0.0002 then 'events-slow' else 'events-shaping' end as target from verdict")
def shaping_router(spark, d):
    callback = lambda rate: F.when(rate >= 0.0002, "events-slow").otherwise("events-shaping")
    return quota.shaped(_decided(spark, d), "topic", QUOTA, "events", callback).select("p", "o", "target")


@query(_STAT + "select case when type = 'COMPLY' then 'events' else 'events-shaping' end as target, count(*) as n from verdict group by 1")
def metric_shaping(spark, d):
    return quota.shaped(_decided(spark, d), "topic", QUOTA, "events").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("select p, count(distinct k) as n_keys, count(*) as n_rows, cast(0 as bigint) as under, cast(0 as bigint) as over from tlog group by p")
def sketch_bounds(spark, d):
    return quota.sketch_bounds(task_log(spark, d), "p", "k", 0.001, 0.001)


# --- completion ------------------------------------------------------------------

_MARKS = """
, b as (select *, min(case when not completed then o end) over (partition by p) as bad from tlog),
marks as (select p, cast(coalesce(max(case when bad is null or o < bad then o end), -1) as bigint) as high_watermark,
  count(case when bad is not null and o >= bad then 1 end) as pending, max(o) as latest from b group by p)
"""


def _marks(spark, d):
    return commit.watermarks(task_log(spark, d), ["p"], "o", F.col("completed"))


@query(_MARKS + "select * from marks")
def commit_watermark(spark, d):
    return _marks(spark, d)


@query("select p, o, min(completed::int) over (partition by p order by o) = 1 as prefix_complete from tlog")
def commit_watermark_running(spark, d):
    return commit.running_watermark(task_log(spark, d), ["p"], "o", F.col("completed")).select("p", "o", "prefix_complete")


@query(_MARKS + "select p, pending, pending >= 100 as paused from marks")
def pending_backpressure(spark, d):
    return _marks(spark, d).select("p", "pending", commit.paused(F.col("pending"), 100).alias("paused"))


@query(_MARKS + "select p, high_watermark, case when p <> 3 and high_watermark > p * 10 then high_watermark + 1 end as commit from marks")
def committed_position(spark, d):
    m = _marks(spark, d).withColumn("last_committed", F.col("p") * 10)
    return commit.committable(m, revoking=F.col("p") == 3).select("p", "high_watermark", "commit")


@query("""
, a as (select p, o, case when o % 17 = 5 then o - 3 else o end as got from tlog)
select p, o, coalesce(got < lag(got) over (partition by p order by o), false) as regression from a
""")
def offset_regression(spark, d):
    got = F.when(F.col("o") % 17 == 5, F.col("o") - 3).otherwise(F.col("o"))
    return commit.regressions(task_log(spark, d), ["p"], "o", got).select("p", "o", "regression")


_TIMEOUT = """
, x as (select *, case when event_type = 'error' then t + 60000 else -1 end as timeout_at, 1705000000000 as now from tlog),
y as (select p, o, completed or (timeout_at >= 0 and timeout_at <= now) as done from x),
z as (select *, min(case when not done then o end) over (partition by p) as bad from y)
select p, cast(coalesce(max(case when bad is null or o < bad then o end), -1) as bigint) as high_watermark,
  count(case when bad is not null and o >= bad then 1 end) as pending, max(o) as latest from z group by p
"""


@query(_TIMEOUT)
def completion_timeout(spark, d):
    at = F.when(F.col("event_type") == "error", F.col("t") + 60000).otherwise(F.lit(-1))
    done = commit.after_timeout(F.col("completed"), at, F.lit(1705000000000))
    return commit.watermarks(task_log(spark, d), ["p"], "o", done)


@query(", a as (select distinct topic, p from tlog where k::int % 3 <> 0 and p < 3), b as (select distinct topic, p from tlog where p > 0)"
       " (select *, 'added' as change from (select * from b except all select * from a)) union all (select *, 'removed' as change from (select * from a except all select * from b))")
def assignment_diff(spark, d):
    log = task_log(spark, d)
    old = log.filter((F.col("k").cast("int") % 3 != 0) & (F.col("p") < 3)).select("topic", "p").distinct()
    return commit.assignment_diff(old, log.filter("p > 0").select("topic", "p").distinct())


# --- retries -----------------------------------------------------------------------


@query(", r as (select p, o, t, k, case event_type when 'error' then 3 when 'click' then 1 else 0 end as retries from tlog), a as (select *, unnest(range(0, retries + 1)) as attempt from r)"
       " select p, o, attempt, t + attempt * 5000 as run_at from a")
def retry_expand(spark, d):
    n = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 1).otherwise(0)
    return retry.attempts(task_log(spark, d), n, F.col("t"), 5000).select("p", "o", "attempt", "run_at")


def _metadata() -> Column:
    return F.struct(
        F.col("t").alias("timestamp_millis"),
        F.concat(F.lit("app-"), F.col("event_type")).alias("source_application_id"),
        F.concat(F.lit("i-"), F.col("p").cast("string")).alias("source_instance_id"),
        F.pmod(F.col("o"), F.lit(3)).alias("retry_count"),
        F.col("scheduled").alias("scheduled_time_millis"),
    ).cast(METADATA_TYPE)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records in every format: click and view with the header, purchase as a legacy envelope, error with a broken header, signup bare."""
    log = task_log(spark, d)
    task, m = F.encode("props", "UTF-8"), _metadata()
    kind = F.col("event_type")
    none = F.array().cast(extract.HEADERS_TYPE)
    header = F.when(kind.isin("click", "view"), extract.with_header(none, encode_metadata(m))).when(kind == "error", extract.with_header(none, F.lit(b"\xff\xff"))).otherwise(none)
    value = F.when(kind == "purchase", encode_envelope(m, task)).otherwise(task)
    return log.select("topic", F.col("p").alias("partition"), F.col("o").alias("offset"), F.col("t").alias("timestamp"), F.encode("k", "UTF-8").alias("key"), "event_type", value.alias("value"), header.alias("headers"))


@query("""
select p, o, case when event_type in ('click', 'view', 'purchase', 'signup') then t end as timestamp_millis,
  case when event_type in ('click', 'view', 'purchase') then 'app-' || event_type when event_type = 'signup' then '' end as source_application_id,
  case when event_type in ('click', 'view', 'purchase') then 'i-' || p when event_type = 'signup' then '' end as source_instance_id,
  case when event_type in ('click', 'view', 'purchase') then o % 3 when event_type = 'signup' then 0 end as retry_count,
  case when event_type in ('click', 'view', 'purchase') then scheduled when event_type = 'signup' then 0 end as scheduled_time_millis, props as task
from tlog where event_type <> 'signup'
""")
def extract_default(spark, d):
    """Records of three formats read with the legacy fallback on; a broken header leaves the metadata null."""
    r = extract.default_extract(_records(spark, d).filter("event_type <> 'signup'"), legacy_fallback=True)
    return r.select(F.col("partition").alias("p"), F.col("offset").alias("o"), "metadata.*", F.decode("task_bytes", "UTF-8").alias("task"))


@query("select p, o, t as timestamp_millis, '' as source_application_id, cast(0 as bigint) as retry_count, props as task from tlog where event_type = 'signup'")
def extract_bare(spark, d):
    """Records without a header, fallback off: the record's time and defaults."""
    r = extract.default_extract(_records(spark, d).filter("event_type = 'signup'"))
    return r.select(F.col("partition").alias("p"), F.col("offset").alias("o"), "metadata.timestamp_millis", "metadata.source_application_id", "metadata.retry_count", F.decode("task_bytes", "UTF-8").alias("task"))


@query("select 'valid' as side, p, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total from tlog where event_type <> 'view' group by p"
       " union all select 'discarded', p, count(*), null from tlog where event_type = 'view' group by p")
def extract_invalid_discard(spark, d):
    """JSON tasks, those of views cut off: valid and discarded rows per partition."""
    task = F.when(F.col("event_type") == "view", F.substring("props", 1, 4)).otherwise(F.col("props"))
    r = task_log(spark, d).withColumns({"task_bytes": F.encode(task, "UTF-8"), "metadata": _metadata()})
    valid, bad = extract.split_discarded(extract.custom_extract(r, extract.json_task("k int")))
    v = valid.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("task.k").cast("bigint").alias("total")).withColumn("side", F.lit("valid"))
    b = bad.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("total")).withColumn("side", F.lit("discarded"))
    return v.unionByName(b)


@query("select p, o, 'second-' || k as got, case when o % 2 = 0 then 'x' || k end as other from tlog")
def header_last_wins(spark, d):
    h = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    two = F.array(h("dt_meta", F.concat(F.lit("first-"), F.col("k"))), h("x", F.concat(F.lit("x"), F.col("k"))), h("dt_meta", F.concat(F.lit("second-"), F.col("k"))))
    headers = F.when(F.col("o") % 2 == 0, two).otherwise(F.filter(two, lambda x: x["key"] == "dt_meta"))
    text = lambda c: F.decode(c, "UTF-8")
    return task_log(spark, d).select("p", "o", text(extract.last_header(headers)).alias("got"), text(extract.last_header(headers, "x")).alias("other"))


@query("select p, o, case when o % 3 = 0 then 'x,dt_meta' else 'dt_meta' end as names, 'new-' || k as value from tlog")
def header_write(spark, d):
    h = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    old = F.when(F.col("o") % 3 == 0, F.array(h("dt_meta", F.lit("old")), h("x", F.lit("1")))).when(F.col("o") % 3 == 1, F.array(h("dt_meta", F.lit("old"))))
    new = extract.with_header(old, F.encode(F.concat(F.lit("new-"), F.col("k")), "UTF-8"))
    return task_log(spark, d).select("p", "o", F.concat_ws(",", F.transform(new, lambda x: x["key"])).alias("names"), F.decode(extract.last_header(new), "UTF-8").alias("value"))


@query("select case when event_type in ('click', 'view', 'error') then 'header' else 'other' end as format, count(*) as n from tlog group by 1")
def metric_records_by_format(spark, d):
    return extract.records_by_format(_records(spark, d))


@query("select p, o, case when k::int % 2 = 0 then t else 1700000000000 end as timestamp_millis, 'app' as source_application_id, 'host' as source_instance_id, cast(0 as bigint) as retry_count,"
       " case when scheduled > 0 then scheduled else 0 end as scheduled_time_millis from tlog")
def client_put_metadata(spark, d):
    m = client.filled_metadata("app", "host", 1700000000000, F.when(F.col("k").cast("int") % 2 == 0, F.col("t")), F.when(F.col("scheduled") > 0, F.col("scheduled")))
    return task_log(spark, d).select("p", "o", m.alias("m")).select("p", "o", "m.*")


@query("select 'tasks' as topic, k as key, props as task, t as timestamp_millis, 'app-' || event_type as source_application_id from tlog")
def client_records(spark, d):
    """Records written and read again."""
    log = task_log(spark, d)
    r = client.to_records(log, "tasks", F.col("k"), F.encode("props", "UTF-8"), _metadata())
    m = decode_metadata(extract.last_header(F.col("headers")))
    return r.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("task"), m["timestamp_millis"].alias("timestamp_millis"), m["source_application_id"].alias("source_application_id"))


@query("select p, o, props as task, t as timestamp_millis, o % 3 as retry_count from tlog")
def legacy_envelope(spark, d):
    e = decode_envelope(encode_envelope(_metadata(), F.encode("props", "UTF-8")))
    got = task_log(spark, d).select("p", "o", e.alias("e")).select("p", "o", F.decode("e.task", "UTF-8").alias("task"), decode_metadata(F.col("e.metadata")).alias("m"))
    return got.select("p", "o", "task", "m.timestamp_millis", "m.retry_count")


@query("select p, o, topic || '-' || p || '-' || o as id, 'topic=' || topic || ' partition=' || p || ' offset=' || o as request from tlog")
def put_result_id(spark, d):
    c = (F.col("topic"), F.col("p"), F.col("o"))
    return task_log(spark, d).select("p", "o", client.put_result_id(*c).alias("id"), client.request_id(*c).alias("request"))


@query(r"""
, c as (select p, o, case o % 4 when 0 then k when 1 then k || chr(9) when 2 then k || 'é' end as key from tlog)
select p, o, key is null or regexp_full_match(key, '[\x20-\x7E]*') as ok from c
""")
def ascii_key_check(spark, d):
    k = F.when(F.col("o") % 4 == 0, F.col("k")).when(F.col("o") % 4 == 1, F.concat("k", F.lit("\t"))).when(F.col("o") % 4 == 2, F.concat("k", F.lit("é")))
    return task_log(spark, d).select("p", "o", client.is_ascii_key(k).alias("ok"))


@query("select p, o, 'events-retry' as topic, k as key, o % 3 + 1 as retry_count, t + 7000 as scheduled_time_millis, t as timestamp_millis from tlog where event_type = 'error'")
def retry_records(spark, d):
    log = task_log(spark, d).filter("event_type = 'error'")
    none = F.array().cast(extract.HEADERS_TYPE)
    # the key carries the position here, to tell the rows apart
    tagged = log.select("topic", F.encode(F.concat_ws("/", "p", "o", "k"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("task_bytes"), none.alias("headers"), _metadata().alias("metadata"), "t")
    got = retry.retry_records(tagged, F.col("t"), 7000)
    m = decode_metadata(extract.last_header(F.col("headers")))
    at = F.split(F.decode("key", "UTF-8"), "/")
    return got.select(at[0].cast("int").alias("p"), at[1].cast("bigint").alias("o"), "topic", at[2].alias("key"), m["retry_count"].alias("retry_count"), m["scheduled_time_millis"].alias("scheduled_time_millis"), m["timestamp_millis"].alias("timestamp_millis"))


@query("select p, o, cast(json_extract(props, '$.k') as int) as task_k, case when event_type = 'error' then o % 3 + 1 else 0 end as retry_count from tlog where event_type in ('error', 'signup')")
def retry_topic_extract(spark, d):
    """Retried tasks (wrapped again) and origin tasks (plain) through the same JSON extractor; the outer count wins."""
    log = task_log(spark, d).filter("event_type in ('error', 'signup')")
    none = F.array().cast(extract.HEADERS_TYPE)
    again = F.col("event_type") == "error"
    m = retry.retried_metadata(_metadata(), F.col("t"), 7000)
    r = log.select(
        F.when(again, "events-retry").otherwise("events").alias("topic"),
        F.col("p"),
        F.col("o"),
        F.col("t").alias("timestamp"),
        F.encode("props", "UTF-8").alias("value"),
        F.when(again, extract.with_header(none, encode_metadata(m))).otherwise(none).alias("headers"),
    )
    got = extract.retry_extract(r, "events-retry", extract.json_task("k int"))
    return got.select("p", "o", F.col("task.k").alias("task_k"), "metadata.retry_count")


@query("select p, count(*) as queued, cast(sum(o % 3) as bigint) as retries, max(o % 3) as most from tlog where o % 3 > 0 group by p")
def metric_retry(spark, d):
    return metrics.retry_counts(task_log(spark, d), ["p"], F.pmod(F.col("o"), F.lit(3)))


# --- lanes ----------------------------------------------------------------------


@query("select p, o, cast(o % 5 as int) as lane from tlog")
def round_robin_lane(spark, d):
    return partitioner.round_robin(task_log(spark, d), "p", "o", 5).select("p", "o", "lane")


def _murmur(name: str, text: str, source: str) -> str:
    """SQL steps of the producers' hash for ASCII texts of up to 11 characters; the last step has the column h."""
    m, low = "1540483477::ubigint", "4294967295::ubigint"
    byte = lambda i: f"ord(substr(s, {i}, 1))::ubigint"
    out = f"{name}0 as (select *, {text} as s, length({text}) as n, xor(2538058380::ubigint, length({text})::ubigint) as h0 from {source})"
    for b in (0, 1):
        word = " + ".join(f"({byte(4 * b + i + 1)} << {8 * i})" for i in range(4))
        out += f""", {name}{b}a as (select *, case when n >= {4 * b + 4} then (({word}) * {m}) & {low} end as w from {name}{b}),
{name}{b}b as (select * exclude w, (xor(w, w >> 24) * {m}) & {low} as w from {name}{b}a),
{name}{b + 1} as (select * exclude (w, h{b}), case when n >= {4 * b + 4} then xor((h{b} * {m}) & {low}, w) else h{b} end as h{b + 1} from {name}{b}b)"""
    at = lambda i: f"ord(substr(s, (n - n % 4 + {i})::int, 1))::ubigint"
    tail = f"case n % 4 when 3 then {at(1)} + ({at(2)} << 8) + ({at(3)} << 16) when 2 then {at(1)} + ({at(2)} << 8) when 1 then {at(1)} end"
    return out + f""", {name}t as (select * exclude h2, case when n % 4 > 0 then (xor(h2, {tail}) * {m}) & {low} else h2 end as h3 from {name}2),
{name}u as (select * exclude h3, (xor(h3, h3 >> 13) * {m}) & {low} as h4 from {name}t),
{name} as (select * exclude (h4, s, n), xor(h4, h4 >> 15) & 2147483647 as h from {name}u)"""


@query(f"""
, {_murmur("lanes", "'s:' || k", "tlog")}, {_murmur("parts", "k", "tlog")},
turn as (select p, o, row_number() over (partition by p order by o) - 1 as i from tlog where event_type = 'error')
select l.p, l.o, l.k, cast(coalesce(turn.i % 16, l.h % 16) as int) as lane, case when l.event_type <> 'error' then cast(q.h % 8 as int) end as log_partition
from lanes l join parts q on l.p = q.p and l.o = q.o left join turn on turn.p = l.p and turn.o = l.o
""")
def murmur2_lane(spark, d):
    """Bit-exact lanes and partitions by the producers' hash; keys of errors are null and take turns."""
    log = task_log(spark, d).withColumn("key", F.when(F.col("event_type") != "error", F.encode("k", "UTF-8")))
    got = partitioner.with_lanes(log, F.col("key"), "p", "o", 16)
    return got.select("p", "o", "k", "lane", partitioner.log_partition(F.col("key"), 8).alias("log_partition"))


_LANES = """
, s as (select p, (k::int // 4) % 8 as lane, count(*) as n from tlog group by all)
"""


@query(_LANES + "select p, cast(sum(n) as bigint) as n_rows, count(*) as n_lanes, round(stddev_pop(n) / sum(n), 9) as deviation from s group by p")
def lane_balance(spark, d):
    lanes = partitioner.custom_lanes(task_log(spark, d), F.floor(F.col("k").cast("int") / 4).cast("int") % 8, 8)
    return partitioner.balance(lanes, "p", "lane").withColumn("deviation", F.round("deviation", 9))


@query(", l as (select *, cast(o % 5 as int) as lane from tlog) select p, lane, cast(sum(d) as bigint) as processed_time, count(*) as queued from l group by p, lane")
def metric_lane_utilisation(spark, d):
    return metrics.lane_use(partitioner.round_robin(task_log(spark, d), "p", "o", 5), ["p", "lane"], F.col("d"))


# --- checks -----------------------------------------------------------------------

_IDS = "select distinct case when json_valid(decode(task_bytes)) then json_extract_string(decode(task_bytes), '$.id') end as task_id from task_log"


@query(f", a as (select task_id from ({_IDS}) where task_id is not null), b as (select distinct task_id from processed_tasks where task_id is not null)"
       " select task_id, 'lost' as problem from a where task_id not in (select task_id from b) union all select task_id, 'unknown' from b where task_id not in (select task_id from a)")
def at_least_once(spark, d):
    made = table(spark, d, "task_log").select(task_id(F.col("task_bytes")).alias("task_id"))
    return checks.lost_and_unknown(made, table(spark, d, "processed_tasks"), "task_id")


@query("""
, l as (select *, lag(end_ns) over (partition by task_key order by start_ns, end_ns) as previous_end from processed_tasks where end_ns is not null and start_ns is not null and task_key is not null)
select decode(task_key) as task_key, start_ns, end_ns, previous_end from l where previous_end > start_ns
""")
def serial_processing(spark, d):
    return checks.overlaps(table(spark, d, "processed_tasks"), "task_key", "start_ns", "end_ns").withColumn("task_key", F.decode("task_key", "UTF-8"))


@query("""
, r as (select decode(task_key) as k, start_ns as s, cast(substr(task_id, 2) as bigint) as o from processed_tasks where task_key is not null and start_ns is not null),
pl as (select k, o, row_number() over (partition by k order by o) as place from (select distinct k, o from r)),
j as (select r.*, place, lag(place) over (partition by r.k order by s, r.o) as was from r join pl on r.k = pl.k and r.o = pl.o),
per as (select k, count(*) as n, bool_or(coalesce(place > was + 1, place > 1)) as skip, max(place) as top, arg_max(place, (s, o)) as last from j group by k)
select k as task_key, n from per where skip or last < top
""")
def ordering(spark, d):
    rows = table(spark, d, "processed_tasks").select(F.decode("task_key", "UTF-8").alias("task_key"), "start_ns", F.substring("task_id", 2, 30).try_cast("bigint").alias("o"))
    return checks.order_problems(rows, "task_key", "start_ns", "o")


@query(", a as (select distinct 'trace-' || p || '-' || o as trace from tlog), b as (select distinct 'trace-' || p || '-' || o as trace from tlog where event_type <> 'error')"
       " select trace from a where trace not in (select trace from b)")
def trace_propagation(spark, d):
    """Traces left open, of all partitions. An offset repeats over partitions, so the id holds both."""
    log = task_log(spark, d).withColumn("trace", F.concat_ws("-", F.lit("trace"), F.col("p").cast("string"), F.col("o").cast("string")))
    return checks.propagated(log, log.filter("event_type <> 'error'"), "trace")


# --- metrics -------------------------------------------------------------------------


@query("select p, count(*) as processed, count(*) filter (where event_type = 'signup') as discarded, count(*) filter (where event_type = 'error') as errors, count(*) filter (where not completed) as timeouts from tlog group by p")
def metric_counters(spark, d):
    return metrics.counters(task_log(spark, d), ["p"], discarded=F.col("event_type") == "signup", error=F.col("event_type") == "error", timeout=~F.col("completed"))


def _timer_sql(value: str, where: str, source: str = "tlog") -> str:
    q = ", ".join(f"round(quantile_cont({value}, {x}), 6) as {n}" for x, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p999")))
    return f"select p, count(*) as count, cast(sum({value}) as bigint) as total, max({value}) as max, {q} from {source} where {where} group by p"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p99", "p999")})


@query(", x as (select *, t - (d % 100000) + 20000 as sent from tlog) " + _timer_sql("t - sent", "sent > 0 and t >= sent", "x"))
def metric_latency_quantiles(spark, d):
    log = task_log(spark, d).withColumn("sent", F.col("t") - F.col("d") % 100000 + 20000)
    return _rounded(metrics.timer(log, ["p"], F.col("t") - F.col("sent"), metrics.latency_counts(F.col("sent"), F.col("t"))))


@query(_timer_sql("d", "true"))
def metric_process_duration(spark, d):
    return _rounded(metrics.timer(task_log(spark, d), ["p"], F.col("d")))


@query(", x as (select *, t + d % 9000 as now from tlog) " + _timer_sql("now - scheduled", "scheduled > 0 and now >= scheduled", "x"))
def metric_scheduled_delay(spark, d):
    log = task_log(spark, d).withColumn("now", F.col("t") + F.col("d") % 9000)
    return _rounded(metrics.timer(log, ["p"], F.col("now") - F.col("scheduled"), metrics.latency_counts(F.col("scheduled"), F.col("now"))))


@query(_bucket("p", 600_000.0, 3_600_000.0) + "select p, round(sum(wait), 1) as throttled, count(*) filter (where wait > 0) as delayed from w group by p")
def metric_throttled(spark, d):
    w = schedule.token_bucket(task_log(spark, d), ["p"], "o", F.col("t"), 1 / 600, 3600).withColumn("wait", F.round("wait", 3))
    return w.groupBy("p").agg(F.round(F.sum("wait"), 1).alias("throttled"), F.count_if(F.col("wait") > 0).alias("delayed"))


@query(_timer_sql("greatest(t, scheduled) - t", "true"))
def metric_scheduling_delay(spark, d):
    delay = schedule.scheduled_start(F.col("t"), F.col("scheduled")) - F.col("t")
    return _rounded(metrics.timer(task_log(spark, d), ["p"], delay))


_ISLANDS = """
, s as (select p, o, t, value > 100 as state from tlog),
c as (select *, case when lag(state) over w is distinct from state or lag(o) over w is null then 1 else 0 end as c from s window w as (partition by p order by o)),
i as (select *, sum(c) over (partition by p order by o) as island from c),
st as (select p, cast(island as bigint) as island, state, min(t) as from_time, max(t) as to_time, count(*) as n from i group by p, island, state)
"""


@query(_ISLANDS + "select * from st")
def metric_paused_islands(spark, d):
    return metrics.islands(task_log(spark, d), ["p"], "o", "t", F.col("value") > 100)


@query(_ISLANDS + "select p, cast(sum(to_time - from_time) as bigint) as time, count(*) as times from st where state group by p")
def metric_paused_time(spark, d):
    return metrics.state_time(metrics.islands(task_log(spark, d), ["p"], "o", "t", F.col("value") > 100), ["p"])


@query(_MARKS + "select p, pending, pending >= 100 as paused, high_watermark + 1 as last_committed, latest as latest_consumed from marks")
def metric_gauges(spark, d):
    return _marks(spark, d).select("p", "pending", commit.paused(F.col("pending"), 100).alias("paused"), (F.col("high_watermark") + 1).alias("last_committed"), F.col("latest").alias("latest_consumed"))


@query(", x as (select *, t + d as fin from tlog) select count(*) as tasks, round(count(*) / (max(fin) - min(t)) * 1000, 9) as throughput, round(avg(d), 6) as avg_latency, max(d) as max_latency from x where o >= 100")
def bench_throughput(spark, d):
    log = task_log(spark, d).withColumn("fin", F.col("t") + F.col("d"))
    return metrics.throughput(log, F.col("o"), 100, "t", "fin", F.col("d")).withColumns({"throughput": F.round("throughput", 9), "avg_latency": F.round("avg_latency", 6)})


# --- sources and settings ----------------------------------------------------------------


@query("select 'events' as topic, p, o from tlog where event_type <> 'error' union all select 'events-retry', p, o from tlog where event_type = 'error'"
       " union all select 'events-shaping', p, o from tlog where event_type = 'view' and value > 100")
def topic_union(spark, d):
    """Origin, retry and shaping topics as one source."""
    from tasklathe.sources.log import union_topics

    log = task_log(spark, d)
    return union_topics(
        {"events": log.filter("event_type <> 'error'"), "events-retry": log.filter("event_type = 'error'"), "events-shaping": log.filter("event_type = 'view' and value > 100")}
    ).select("topic", "p", "o")


@query("select p, o, 'events' as dt_topic, cast(o as varchar) as dt_offset, k as dt_task_key, 'sub' as dt_subscription_id from tlog")
def logging_context(spark, d):
    m = extract.logging_context("sub")
    log = task_log(spark, d).select("p", "o", "topic", F.col("p").alias("partition"), F.col("o").alias("offset"), F.col("k").alias("key"))
    keys = ("dt_topic", "dt_offset", "dt_task_key", "dt_subscription_id")
    return log.select("p", "o", m.alias("m")).select("p", "o", *(F.col("m")[k].alias(k) for k in keys))


_SUPPLIED = [("partition.concurrency", 0, "8"), ("partition.concurrency", 1, "4"), ("max.pending.records", 2, "500"), ("ignore.keys", 1, None), ("processing.rate.per.partition", 3, "100"), ("processing.rate.per.partition", 2, "50")]


@query("""
, s as (select * from (values ('partition.concurrency', 0, '8'), ('partition.concurrency', 1, '4'), ('max.pending.records', 2, '500'), ('ignore.keys', 1, null),
  ('processing.rate.per.partition', 3, '100'), ('processing.rate.per.partition', 2, '50')) v(name, priority, value)),
defaults as (select * from (values ('ignore.keys', '[]'), ('processing.rate.per.partition', '-1'), ('partition.concurrency', '1'), ('max.pending.records', '10000'),
  ('commit.interval.ms', '1000'), ('group.rebalance.timeout.ms', '1000'), ('processing.shutdown.timeout.ms', '0'), ('logging.mdc.enabled', 'true'),
  ('client.metrics.micrometer.bound', 'false'), ('deferred.complete.timeout.ms', '-1'), ('per.key.quota.processing.rate', '-1'),
  ('processor.threads.termination.timeout.ms', '9223372036854775807'), ('retry.task.in.legacy.format', 'false'), ('legacy.parse.fallback.enabled', 'false')) v(name, value)),
best as (select name, arg_min(value, priority) as value from s where value is not null group by name)
select d.name, coalesce(b.value, d.value) as value, b.value is not null as supplied from defaults d left join best b on b.name = d.name
""")
def property_precedence(spark, d):
    return config.effective(spark.createDataFrame(_SUPPLIED, "name string, priority int, value string"), spark)


# --- streaming forms, run over the whole log as a bounded stream --------------------------------


def _streamed(spark: SparkSession, log: DataFrame, by: list[str], processor) -> DataFrame:
    """The rows a stateful processor makes of ``log``, read as a stream and written to the shared folder."""
    from tasklathe.shared import new_path
    from tasklathe.streaming.processors import run_stateful, use_rocksdb, with_event_time

    use_rocksdb(spark)
    base = new_path(spark, "stream")
    log.write.parquet(f"{base}/in")
    stream = with_event_time(spark.readStream.schema(log.schema).parquet(f"{base}/in"), "t")
    out = run_stateful(stream, by, processor)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(_STAT + "select p, o, k, from_ms, to_ms, n from stat")
def stream_key_stat(spark, d):
    from tasklathe.streaming.processors import KeyStat

    return _streamed(spark, task_log(spark, d).select("p", "o", "k", "t"), ["p"], KeyStat(W6))


@query(_MARKS + "select p, max(high_watermark) as high_watermark from marks group by p")
def stream_completion(spark, d):
    """Watermarks reached by a stream of received and completed records."""
    from tasklathe.streaming.processors import Completion

    log = task_log(spark, d)
    got = log.select("p", "o", "t", F.lit("received").alias("kind"), F.lit(-1).cast("bigint").alias("timeout_at"))
    done = log.filter("completed").select("p", "o", "t", F.lit("completed").alias("kind"), F.lit(-1).cast("bigint").alias("timeout_at"))
    return _streamed(spark, got.unionByName(done), ["p"], Completion()).groupBy("p").agg(F.max("high_watermark").alias("high_watermark"))
