"""Queries for what surrounds the processing of a log: processors, commits, limits, failures, settings, streams."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe import config
from tasklathe.functions.sketch import dimensions
from tasklathe.functions.wire import decode_envelope, decode_metadata
from tasklathe.operators import checks, client, commit, extract, metrics, quota, retry, runtime, schedule
from tasklathe.plans.log_queries import _STAT, HOUR, _bucket, _decided_scope, _metadata, _records, _rounded, _timer_sql, query
from tasklathe.plans.pipeline import Subscription
from tasklathe.tasklog import task_log

# --- processors ----------------------------------------------------------------


class _ByKind:
    """A processor for the queries: errors fail, clicks are completed later, signups hand nothing on, purchases hand on two rows, views never complete."""

    def process(self, row):
        kind, got = row["event_type"], {"p": row["p"], "o": row["o"]}
        if kind == "error":
            raise ValueError("no good")
        if kind in ("click", "view"):
            later = Future()
            if kind == "click":
                later.set_result(got)
            return later
        return None if kind == "signup" else [got, got] if kind == "purchase" else got

    def close(self):
        pass


@query("""
, r as (select case event_type when 'error' then 'failed' when 'click' then 'deferred' when 'purchase' then 'sync' when 'view' then 'timed_out' end as completion,
  case event_type when 'error' then 'ValueError: no good' when 'view' then 'timed out' end as error, case when event_type = 'purchase' then 2 else 1 end as n
  from tlog where event_type in ('error', 'click', 'purchase') or (event_type = 'view' and k = '1'))
select completion, error, cast(sum(n) as bigint) as n from r group by completion, error
""")
def processor_outcomes(spark, d):
    """A caller's processor: failures, deferred completions, several rows and none, and tasks given up (views of one key)."""
    log = task_log(spark, d).select("p", "o", "k", "event_type").filter("event_type <> 'view' or k = '1'")
    got = runtime.process(log, _ByKind, "p int, o bigint", "k", ["p", "o"], threads=4, timeout_ms=1)
    return got.groupBy("completion", "error").agg(F.count(F.lit(1)).alias("n"))


class _Last:
    """Hands on each task with the number of tasks its key had before, which shows that a key's tasks come one by one and in order."""

    def __init__(self):
        self.seen = {}

    def process(self, row):
        n = self.seen[row["k"]] = self.seen.get(row["k"], -1) + 1
        return {"k": row["k"], "o": row["o"], "before": n}

    def close(self):
        pass


@query("select k, o, row_number() over (partition by k order by o) - 1 as before from tlog")
def processor_key_order(spark, d):
    """Tasks of a key run one after the other, in order, on threads that work side by side."""
    log = task_log(spark, d).select("k", "o")
    return runtime.process(log, _Last, "k string, o bigint, before bigint", "k", ["o"], threads=8).select("k", "o", "before")


def _subscription() -> Subscription:
    return (
        Subscription("sub", "events")
        .overriding(**{"ignore.keys": ["3", "7"], "legacy.parse.fallback.enabled": True})
        .consuming(extract.json_task("k int"))
        .then(lambda df: df.filter("task.k % 5 <> 0"), lambda df: df.withColumn("retry", F.col("task.k") % 7 == 0))
        .then(lambda df: df.withColumn("error", F.when(F.col("task.k") % 11 == 0, "bad")))
        .enable_retry(5000)
    )


@query("""
, s as (select *, cast(json_extract(props, '$.k') as int) as x from tlog where k not in ('3', '7') and event_type in ('click', 'view', 'purchase')),
u as (select * from s where x % 5 <> 0)
select 'processed' as what, p, count(*) as n from u group by p union all select 'failed', p, count(*) from u where x % 11 = 0 group by p
union all select 'discarded', p, count(*) from tlog where k not in ('3', '7') and event_type in ('error', 'signup') group by p
""")
def subscription_stages(spark, d):
    """A declared subscription over records of every format: chained stages, blocked keys, failures, what can't be read."""
    r = _subscription().run(_records(spark, d), F.lit(0).cast("bigint"))
    parts = {"processed": r.processed, "failed": r.failed, "discarded": r.discarded}
    out = None
    for what, df in parts.items():
        n = df.groupBy(F.col("partition").alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
        out = n if out is None else out.unionByName(n)
    return out


@query("""
, s as (select *, cast(json_extract(props, '$.k') as int) as x from tlog where k not in ('3', '7') and event_type in ('click', 'view', 'purchase'))
select 'events-retry' as topic, k as key, o % 3 + 1 as retry_count, cast(5000 as bigint) as scheduled_time_millis, count(*) as n from s where x % 5 <> 0 and x % 7 = 0 group by all
""")
def subscription_retries(spark, d):
    """The records that the subscription puts again."""
    r = _subscription().run(_records(spark, d), F.lit(0).cast("bigint")).retries
    m = decode_metadata(extract.last_header(F.col("headers")))
    got = r.select("topic", F.decode("key", "UTF-8").alias("key"), m["retry_count"].alias("retry_count"), m["scheduled_time_millis"].alias("scheduled_time_millis"))
    return got.groupBy("topic", "key", "retry_count", "scheduled_time_millis").agg(F.count(F.lit(1)).alias("n"))


@query(_bucket("p", 200.0, 1000.0) + """
select p, count(*) as n, count(*) filter (where wait > 0) as waiting, round(sum(wait), 1) as waited, cast(min(o % 4) as int) as least_lane, cast(max(o % 4) as int) as top_lane from w group by p
""")
def subscription_pace(spark, d):
    """The pace that a subscription's properties set: five tasks a second and partition, four lanes (taken in turn, as keys are null here)."""
    log = task_log(spark, d)
    none = F.array().cast(extract.HEADERS_TYPE)
    records = log.select("topic", F.col("p").alias("partition"), F.col("o").alias("offset"), F.col("t").alias("timestamp"), F.lit(None).cast("binary").alias("key"), F.encode("props", "UTF-8").alias("value"), none.alias("headers"))
    sub = Subscription("sub", "events").overriding(**{"processing.rate.per.partition": 5, "partition.concurrency": 4}).consuming(extract.json_task("k int"))
    got = sub.run(records).processed.withColumn("wait_ms", F.round("wait_ms", 3))
    return got.groupBy(F.col("partition").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("wait_ms") > 0).alias("waiting"), F.round(F.sum("wait_ms"), 1).alias("waited"), F.min("lane").alias("least_lane"), F.max("lane").alias("top_lane")
    )


@query("select 'events-retry' as topic, p, o, k as key, props as task, o % 3 + 1 as retry_count, t + 7000 as scheduled_time_millis, true as bare from tlog where event_type = 'error'")
def legacy_retry(spark, d):
    """Retries in the legacy format: an envelope as the value, and no metadata header."""
    log = task_log(spark, d).filter("event_type = 'error'")
    old = extract.with_header(F.array().cast(extract.HEADERS_TYPE), F.lit(b"old"))
    tagged = log.select("topic", F.encode(F.concat_ws("/", "p", "o", "k"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("task_bytes"), old.alias("headers"), _metadata().alias("metadata"), "t")
    got = retry.retry_records(tagged, F.col("t"), 7000, legacy=True)
    e = got.select("topic", F.split(F.decode("key", "UTF-8"), "/").alias("at"), decode_envelope(F.col("value")).alias("e"), extract.last_header(F.col("headers")).isNull().alias("bare"))
    m = decode_metadata(F.col("e.metadata"))
    return e.select(
        "topic", F.col("at")[0].cast("int").alias("p"), F.col("at")[1].cast("bigint").alias("o"), F.col("at")[2].alias("key"), F.decode("e.task", "UTF-8").alias("task"),
        m["retry_count"].alias("retry_count"), m["scheduled_time_millis"].alias("scheduled_time_millis"), "bare",
    )


@query("select p, o, 'tasks' as topic, k as key, props as task from tlog where o % 4 <> 1")
def put_ascii_keys(spark, d):
    """Puts whose keys are printable ASCII, as records; the others are in ``put_errors``."""
    log = task_log(spark, d)
    key = F.when(F.col("o") % 4 == 1, F.concat("k", F.lit("\t"))).otherwise(F.concat_ws("/", "p", "o", "k"))
    good, _ = client.put_or_error(log, "tasks", key, F.encode("props", "UTF-8"), _metadata())
    at = F.split(F.decode("key", "UTF-8"), "/")
    return good.select(at[0].cast("int").alias("p"), at[1].cast("bigint").alias("o"), "topic", at[2].alias("key"), F.decode("value", "UTF-8").alias("task"))


@query("select p, o, 'illegal character in key: ' || k || chr(9) as error from tlog where o % 4 = 1")
def put_errors(spark, d):
    """Puts that fail each on its own, with the error."""
    log = task_log(spark, d)
    key = F.when(F.col("o") % 4 == 1, F.concat("k", F.lit("\t"))).otherwise(F.col("k"))
    return client.put_or_error(log, "tasks", key, F.encode("props", "UTF-8"), _metadata())[1].select("p", "o", "error")


@query("select * from (values ('acks', 'all', 'put'), ('max.in.flight.requests.per.connection', '5', 'put'), ('acks', 'all', 'retry'), ('max.in.flight.requests.per.connection', '1', 'retry'), ('linger.ms', '100', 'retry')) v(name, value, producer)")
def producer_defaults(spark, d):
    """What a broker's writers are set to: presets, and on the first one a setting of the user's on top."""
    from tasklathe.sources.sinks import broker_options

    some = {"put": broker_options("b:1", {"max.in.flight.requests.per.connection": "5"}), "retry": broker_options("b:1", retries=True)}
    rows = [(k.removeprefix("kafka."), v, who) for who, o in some.items() for k, v in o.items() if k not in ("kafka.bootstrap.servers", "includeHeaders")]
    return spark.createDataFrame(rows, "name string, value string, producer string")


# --- limits -----------------------------------------------------------------------


@query("select r.rate, count(*) as n, cast(0 as double) as waited from tlog, (values (-1.0::double), (-7.0), (1000001.0)) r(rate) group by r.rate")
def rate_unlimited(spark, d):
    """Rates that don't limit (negative ones and those above a million) and the rate 0, which lets nothing pass."""
    log = task_log(spark, d)
    out = None
    for rate in (-1.0, -7.0, 1_000_001.0, 0.0):
        got = schedule.token_bucket(log, ["p"], "o", F.col("t"), rate).withColumn("rate", F.lit(rate))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("rate").agg(F.count(F.lit(1)).alias("n"), F.sum("wait").alias("waited"))


@query(_bucket("p", 1.0, 1000.0) + "select p, count(*) as n, count(*) filter (where wait > 0) as delayed from w group by p")
def rate_default_burst(spark, d):
    """A thousand permits a second with a second's burst."""
    got = schedule.token_bucket(task_log(spark, d), ["p"], "o", F.col("t"), 1000).withColumn("wait", F.round("wait", 3))
    return got.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wait") > 0).alias("delayed"))


@query("""
, e as (select * from (values (0.00005::double, 0.00001::double), (0.001, 0.001), (0.01, 0.05), (0.9, 0.9), (0.000000001, 0.00001)) v(epsilon, delta))
select epsilon, delta, cast(greatest(1, ceil(ln(1 / delta))) as bigint) as depth, cast(least(1048576, power(2, ceil(log2(exp(1) / epsilon)))) as bigint) as width from e
""")
def sketch_parameters(spark, d):
    """Rows and counters of the key sketch for an error and a confidence; the first ones are the defaults."""
    some = [(e, p, *dimensions(e, p)) for e, p in ((0.00005, 0.00001), (0.001, 0.001), (0.01, 0.05), (0.9, 0.9), (1e-9, 0.00001))]
    return spark.createDataFrame(some, "epsilon double, delta double, depth bigint, width bigint")


_SCOPE = _STAT + """
, scoped as (select *, case when o % 3 = 0 then 'events-shaping' else 'events' end as topic from verdict)
"""


@query(_SCOPE + "select topic, case when topic = 'events' then type else 'COMPLY' end as type, count(*) as n from scoped group by 1, 2")
def quota_scope(spark, d):
    """Only the origin topic has a quota; bursts that come back on the shaping topic comply."""
    return _decided_scope(spark, d).groupBy("topic", "usage.type").agg(F.count(F.lit(1)).alias("n"))


@query(_SCOPE + "select case when topic = 'events' and type = 'VIOLATE' then 'bursts' else topic end as target, count(*) as n from scoped group by 1")
def quota_custom_topic(spark, d):
    """A shaping topic of the user's choice."""
    config_ = quota.QuotaConfig(rate=0.0001, window_ms=6 * HOUR, shaping_topic="bursts")
    return quota.shaped(_decided_scope(spark, d), "topic", config_, "events").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(_SCOPE + "select p, count(*) filter (where v and o % 10 <> 0) as queued, count(*) filter (where v and o % 10 = 0) as queueing_failed from (select *, topic = 'events' and type = 'VIOLATE' as v from scoped) group by p")
def metric_shaping_failures(spark, d):
    """Bursts sent on and bursts that couldn't be (every tenth write fails here)."""
    return metrics.shaping_counts(_decided_scope(spark, d), ["p"], F.col("usage.type") == quota.VIOLATE, F.col("o") % 10 == 0)


@query("select p, count(*) as queued, cast(sum(o % 3) as bigint) as retries, max(o % 3) as most, count(*) filter (where o % 10 = 0) as queueing_failed from tlog where o % 3 > 0 group by p")
def metric_retry_failures(spark, d):
    return metrics.retry_counts(task_log(spark, d), ["p"], F.pmod(F.col("o"), F.lit(3)), F.col("o") % 10 == 0)


# --- completion and commits ----------------------------------------------------------

_DONE_AT = """
, c as (select *, case when event_type = 'error' and o % 50 = 0 then null else t + d + case when o % 5 = 0 then 40000 else 0 end end as done_at from tlog),
cov as (select *, max(coalesce(done_at, 4611686018427387904)) over (partition by p order by o) as covered from c)
"""


def _done_at(log: DataFrame):
    late = F.when(F.col("o") % 5 == 0, 40_000).otherwise(0)
    return F.when((F.col("event_type") == "error") & (F.col("o") % 50 == 0), F.lit(None)).otherwise(F.col("t") + F.col("d") + late)


@query(_DONE_AT + f"""
, m as (select p, (covered // {HOUR} + 1) * {HOUR} as tick, max(o) + 1 as "commit" from cov where covered < 4611686018427387904 group by all)
select p, tick, "commit", max(case when (tick // {HOUR}) % 7 <> 0 then "commit" end) over (partition by p order by tick) as effective from m
""")
def commit_cadence(spark, d):
    """Commits once an hour; those of every seventh hour fail, and the next one goes beyond them."""
    log = task_log(spark, d)
    return commit.cadence(log, ["p"], "o", _done_at(log), HOUR, failed=F.floor(F.col("tick") / HOUR) % 7 == 0)


@query(_DONE_AT + """
, ev as (select p, covered as tm, 0 as kind, null as o from cov where covered < 4611686018427387904 union all select p, t, 1, o from cov),
s as (select *, sum(1 - kind) over (partition by p order by tm, kind, o rows unbounded preceding) as gone from ev)
select p, o, greatest(cast(o + 1 - gone as bigint), 1) as pending, greatest(o + 1 - gone, 1) > 12 as over from s where kind = 1
""")
def pending_capacity(spark, d):
    """Records held when each one comes, and whether that is more than fits."""
    log = task_log(spark, d)
    return commit.over_capacity(log, ["p"], "o", F.col("t"), _done_at(log), max_pending=10, max_poll=2).select("p", "o", "pending", "over")


@query("""
, x as (select *, case when event_type = 'error' then t + 60000 else -1 end as timeout_at, 1705000000000 as now from tlog),
y as (select p, o, case when not completed and timeout_at between 0 and now and o % 100 = 0 then now + 30000 else timeout_at end as next_look,
  completed or (timeout_at between 0 and now and o % 100 <> 0) as done from x)
select p, o, next_look, done from y
""")
def completion_timeout_callback(spark, d):
    """A callback answers for each record whose time ran out: those at every hundredth offset are given more time, the others given up."""
    policy = lambda: F.when(F.col("o") % 100 == 0, commit.EXTEND)
    at = F.when(F.col("event_type") == "error", F.col("t") + 60000).otherwise(F.lit(-1).cast("bigint"))
    log, now = task_log(spark, d).withColumn("at", at), F.lit(1705000000000)
    open_ = F.when(F.col("completed"), F.lit(-1).cast("bigint")).otherwise(F.col("at"))
    later = F.when(F.col("completed"), F.col("at")).otherwise(commit.extended_timeout(open_, now, 30000, policy))
    return log.select("p", "o", later.alias("next_look"), commit.after_timeout(F.col("completed"), F.col("at"), now, policy).alias("done"))


@query("select p, o, true as stopped, o % 100 >= 90 or o % 7 = 0 as held from tlog")
def pause_all(spark, d):
    """A rate of 0 pauses every partition; otherwise those with too much pending or a reload asked for."""
    pending, reload = F.col("o") % 100, F.col("o") % 7 == 0
    return task_log(spark, d).select("p", "o", commit.paused(pending, 90, rate=0).alias("stopped"), commit.paused(pending, 90, reload).alias("held"))


@query("""
, s as (select p, o, t, d, sum(d) over (partition by p order by o) as s from tlog),
m as (select *, max(t - (s - d)) over (partition by p order by o) as m from s),
f as (select p, o, s + m - d as start, s + m as finish from m),
g as (select *, start - lag(finish) over (partition by p order by o) as gap from f)
select p, cast(coalesce(sum(case when gap > 0 then gap end), 0) as bigint) as time, count(*) filter (where gap > 0) as times from g group by p
""")
def metric_starved_time(spark, d):
    log = task_log(spark, d)
    return metrics.starved_time(schedule.fifo_service(log, ["p"], "o", F.col("t"), F.col("d")), ["p"], "o")


@query(_DONE_AT + _timer_sql("done_at - t", "done_at is not null", "c"))
def metric_complete_duration(spark, d):
    """Time from arrival to completion, deferred ones included."""
    log = task_log(spark, d).withColumn("done_at", _done_at(None))
    return _rounded(metrics.timer(log, ["p"], F.col("done_at") - F.col("t"), F.col("done_at").isNotNull()))


@query("""
, s as (select p, unnest(['poll', 'records', 'reload', 'pause', 'commit']) as section,
  unnest([o % 7 + case when o % 2 = 0 then o % 11 else 0 end, d, 0, o % 3, 2 * (o % 5)]) as ms from tlog)
select p, section, count(*) as count, cast(sum(ms) as bigint) as total, max(ms) as max from s group by p, section
""")
def metric_section_durations(spark, d):
    """Sections of a subscription's loop, from maps of durations as a query's progress has them."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("bigint").alias("value"))
    o = F.col("o")
    every = F.array(entry("latestOffset", o % 7), entry("addBatch", F.col("d")), entry("triggerWait", o % 3), entry("walCommit", o % 5), entry("commitOffsets", o % 5))
    both = F.when(o % 2 == 0, F.concat(every, F.array(entry("getBatch", o % 11)))).otherwise(every)
    return metrics.section_durations(task_log(spark, d).select("p", F.map_from_entries(both).alias("durationMs")), ["p"])


# --- checks -------------------------------------------------------------------------------


@query("""
, l as (select k, t as start, t + d as finish, lag(t + d) over (partition by k order by t, t + d) as previous_end from tlog)
select k, start, finish, previous_end from l where previous_end > start
""")
def serial_overlaps(spark, d):
    """Tasks of a key that began before the one before had ended; unlike processed_tasks this log has such."""
    log = task_log(spark, d).select("k", F.col("t").alias("start"), (F.col("t") + F.col("d")).alias("finish"))
    return checks.overlaps(log, "k", "start", "finish", block=HOUR)


@query("""
select p, o, case when o % 3 > 0 then 'tr-' || p || '-' || o end as trace_id,
  case when o % 3 > 0 then 'tr-' || p || '-' || o || ',tr-' || p || '-' || o || '-extract,tr-' || p || '-' || o || '-process' end as spans from tlog
""")
def trace_spans(spark, d):
    """Traces taken from a record's header, with a child per stage."""
    mark = F.encode(F.concat_ws("-", F.lit("tr"), "p", "o"), "UTF-8")
    none = F.array().cast(extract.HEADERS_TYPE)
    log = task_log(spark, d).withColumn("headers", F.when(F.col("o") % 3 > 0, extract.with_header(none, mark, "trace")).otherwise(none))
    got = extract.with_trace(log, "trace", ["extract", "process"])
    return got.select("p", "o", "trace_id", F.when(F.col("spans").isNotNull(), F.concat_ws(",", "spans")).alias("spans"))


# --- settings -----------------------------------------------------------------------------


@query("""
, v as (select p, o, cast(floor(value) as bigint) as v from tlog where value >= 1 and value <= 1000000),
l as (select p, o, coalesce(lag(v) over (partition by p order by o), 10000) as old, v as new from v)
select p, o, old, new from l where old <> new
""")
def property_changes(spark, d):
    """Values set over time as the changes that listeners hear: invalid and equal ones are none."""
    log = task_log(spark, d).select("p", "o", F.when(F.col("value") <= 1_000_000, F.floor("value")).cast("bigint").alias("v"))
    return config.changes(log, ["p"], "o", "v", config.BY_NAME["max.pending.records"])


_LONG = 2**63 - 1


@query(f"""
select * from (values
  ('ignore.keys', 'array', null::bigint, null::bigint, '[]'), ('processing.rate.per.partition', 'integer', -1, 1000000, '-1'), ('partition.concurrency', 'integer', 1, null, '1'),
  ('max.pending.records', 'integer', 1, null, '10000'), ('commit.interval.ms', 'integer', 0, null, '1000'), ('group.rebalance.timeout.ms', 'integer', 0, null, '1000'),
  ('processing.shutdown.timeout.ms', 'integer', 0, null, '0'), ('logging.mdc.enabled', 'boolean', null, null, 'true'), ('client.metrics.micrometer.bound', 'boolean', null, null, 'false'),
  ('deferred.complete.timeout.ms', 'integer', null, null, '-1'), ('per.key.quota.processing.rate', 'integer', -1, 1000000, '-1'),
  ('processor.threads.termination.timeout.ms', 'integer', 0, null, '{_LONG}'), ('retry.task.in.legacy.format', 'boolean', null, null, 'false'),
  ('legacy.parse.fallback.enabled', 'boolean', null, null, 'false')) v(name, type, minimum, maximum, default_value)
""")
def property_schema(spark, d):
    """The JSON schema of a property file, a row per property."""
    return config.schema_rows(spark)


# --- streams --------------------------------------------------------------------------------


@query("select 'events-retry' as topic, count(*) as n, count(distinct k) as keys from tlog where event_type = 'error' union all select 'events', count(*), count(distinct k) from tlog where event_type <> 'error'")
def poll_loop(spark: SparkSession, d: str) -> DataFrame:
    """Records of a topic polled in bounded micro-batches, routed to two topics, and read back from there."""
    from tasklathe.shared import new_path
    from tasklathe.sources.log import RECORD, read_batch, read_stream
    from tasklathe.sources.sinks import folder_writer
    from tasklathe.streaming.processors import routed

    base = new_path(spark, "poll")
    log = task_log(spark, d)
    none = F.array().cast(extract.HEADERS_TYPE)
    topic = F.when(F.col("event_type") == "error", "events-retry").otherwise("events")
    records = log.select(
        topic.alias("topic"), F.col("p").alias("partition"), F.col("o").alias("offset"), F.timestamp_millis("t").alias("timestamp"), F.lit(0).alias("timestampType"),
        F.encode("k", "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"), none.alias("headers"),
    )
    records.repartitionByRange(6, "partition", "offset").write.parquet(f"{base}/in/log")
    stream = read_stream(spark, ["log"], folder=f"{base}/in", max_per_trigger=2)
    q = routed(stream, folder_writer(f"{base}/out", ["events", "events-retry"], 4), f"{base}/state", availableNow=True)
    q.awaitTermination()
    back = read_batch(spark, ["events", "events-retry"], folder=f"{base}/out")
    assert set(back.columns) == {f.split()[0] for f in RECORD.split(", ")}
    return back.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))
