"""Queries on the landed task log and its companions: problems 1, 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.landed import positions, table, task_id, with_position
from tasklathe.operators import dedup, drift, keychunks, ledger
from tasklathe.shared import new_path

HOT_SHARE = 0.05


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    layout = drift.layouts(drift.profiles(table(spark, d, "envelope_files")))
    return drift.changes(layout).select("stream_no", "file_no", "field_path", "change_kind")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Every change with what it led to: the new path and type (the old type of a removed field)."""
    return drift.changes(drift.layouts(drift.profiles(table(spark, d, "envelope_files"))))


def p1_layouts(spark: SparkSession, d: str) -> DataFrame:
    layout = drift.layouts(drift.profiles(table(spark, d, "envelope_files")))
    paths = F.transform("fields", lambda f: F.struct(F.concat_ws(".", f["parent"], f["name"]).alias("field_path"), f["type"].alias("json_type")))
    return layout.select("stream_no", "file_no", "n_lines", "n_bad", F.inline(paths))


def _unified(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "envelope_files")
    layout = drift.layouts(drift.profiles(lines))
    return drift.unified(lines, drift.changes(layout), layout)


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).withColumn("extra", F.to_json("extra"))


def p1_unified_lines(spark: SparkSession, d: str) -> DataFrame:
    """Which lines are in the unified table."""
    return _unified(spark, d).select("stream_no", "file_no", "line_no")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The lines that aren't, with the reason."""
    return drift.rejects(table(spark, d, "envelope_files")).select("stream_no", "file_no", "line_no", "reason")


def p1_top_changes(spark: SparkSession, d: str) -> DataFrame:
    """Top-level names that went, came or changed type between files, renames taken as both: the part of the report that needs no matching."""
    every = drift.changes(drift.layouts(drift.profiles(table(spark, d, "envelope_files"))))
    one = lambda where, path, what: every.filter(where).select("stream_no", "file_no", F.col(path).alias("field_path"), F.lit(what).alias("what"))
    parts = one("change_kind in ('removed', 'renamed')", "field_path", "gone").unionByName(one("change_kind in ('added', 'renamed')", "new_path", "came"))
    return parts.unionByName(one("change_kind = 'type_changed'", "field_path", "type_changed")).filter(~F.contains("field_path", F.lit(".")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    log = positions(table(spark, d, "task_log"), "task_key", "log_id").filter("topic is not null")
    hot = keychunks.heavy_keys(log, "topic", "task_key", ["log_id"], HOT_SHARE)
    return hot.select("topic", F.decode("task_key", "UTF-8").alias("task_key"))


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Counts, latest task, delays, longest pause and copies of every key of every topic."""
    log = with_position(table(spark, d, "task_log"))
    sent = F.col("metadata.timestamp_millis")
    rows = log.select(
        "topic", "task_key", "record_timestamp", "log_id", task_id(F.col("task_bytes")).alias("task_id"), F.when(sent > 0, F.col("record_timestamp") - sent).alias("delay")
    )
    per = keychunks.per_key(rows, ["topic", "task_key"], ["record_timestamp", "log_id"], gap_of="record_timestamp", sums=["delay"], tails=["log_id", "task_id"])
    return per.select(
        "topic",
        F.decode("task_key", "UTF-8").alias("task_key"),
        "n_rows",
        F.col("first_at").alias("first_ms"),
        F.col("last_at").alias("last_ms"),
        "max_gap",
        F.col("n_0").alias("n_delays"),
        F.col("sum_0").alias("sum_delay"),
        F.col("min_0").alias("min_delay"),
        F.col("max_0").alias("max_delay"),
        F.col("tail_0").alias("latest_log_id"),
        F.col("tail_1").alias("latest_task_id"),
    )


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    log = positions(table(spark, d, "task_log"), "task_key", "log_id")
    s = keychunks.chunk_states(log, ["topic", "task_key"], ["log_id"], tails=["log_id"])
    return s.groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest"), F.max("row_to").alias("hottest_key"))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a topic and of its hottest key, added up from the chunks; ``p3_chunk_sizes`` has the chunks themselves."""
    return _chunks(spark, d).select("topic", "n_rows", "hottest_key")


def p3_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks a topic's keys are cut into, and the largest chunk: at most CHUNK_ROWS, however long a key. Both depend on the partitions."""
    return _chunks(spark, d).select("topic", "n_rows", "hottest_key", "n_chunks", "largest")


def _pending(spark: SparkSession, d: str) -> DataFrame:
    records = positions(table(spark, d, "task_log"), "task_bytes", "landed_at")
    return ledger.pending_of_reports(records, table(spark, d, "consume_runs"))


RUN_AT = 1_800_000_000_000  # when the runs of these queries take place


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions of one incremental run: planned as items of a ledger, leased, written, and read back through the ledger."""
    led = ledger.process_pending(_pending(spark, d), "p5", RUN_AT)
    got = led.outputs()
    return _pending(spark, d).limit(0) if got is None else got.select("topic", "partition_id", "record_offset")


def p5_work_items(spark: SparkSession, d: str) -> DataFrame:
    """What is pending as work items for a ledger: blocks of offsets of a partition."""
    return ledger.work_items(_pending(spark, d))


def p5_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after a worker stopped: its leases ran out, another worker took half of the items and finished them, and the late results were refused."""
    pending = ledger.work_items(_pending(spark, d))
    led = ledger.Ledger(spark, new_path(spark, "ledger"))
    led.plan(pending)
    n = led.states(RUN_AT).count()
    stopped = led.lease("stopped", RUN_AT, 1000)
    other = led.lease("other", RUN_AT + 5000, 1000, limit=-(-n // 2))
    led.finish(stopped.join(other.select("item"), "item", "left_semi"), "stopped", RUN_AT + 5500)
    led.finish(other, "other", RUN_AT + 6000)
    return led.states(RUN_AT + 7000).select("item", "state", "token", "owner")


def p5_run_states(spark: SparkSession, d: str) -> DataFrame:
    return ledger.states_of_reports(table(spark, d, "consume_runs"))


BATCHES_A_DAY = 96  # landing batches come every quarter of an hour; whole days of them are taken in at a time


def _once(spark: SparkSession, d: str) -> DataFrame:
    log = positions(table(spark, d, "task_log"), "log_id", "batch_id").filter("topic is not null and partition_id is not null and record_offset is not null")
    return dedup.deliver_once(log, ["topic", "partition_id", "record_offset"], "log_id", "batch_id", span=BATCHES_A_DAY)


POSITION = {"topic": "string", "partition_id": "int", "record_offset": "bigint"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d).filter("n > 1").select(*dedup.split_identifier(F.col("ident"), POSITION))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The row of each position that stays: of the first day it came in, the one that landed first."""
    return _once(spark, d).select(*dedup.split_identifier(F.col("ident"), POSITION), F.col("first").alias("log_id"), "n")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_layouts, p1_unified, p1_unified_lines, p1_rejects, p1_top_changes, p3_found, p3_per_key, p3_chunks, p3_chunk_sizes, p5_found, p5_work_items, p5_ledger, p5_run_states, p6_found, p6_kept)}

PLACED = r"""
placed as (
  select * replace (
    coalesce(topic, nullif(regexp_extract(record_ref, '^(topic=)?(.*?)( partition=|-)(\d+)( offset=|-)(\d+)$', 2), '')) as topic,
    coalesce(partition_id, try_cast(nullif(regexp_extract(record_ref, '^(topic=)?(.*?)( partition=|-)(\d+)( offset=|-)(\d+)$', 4), '') as int)) as partition_id,
    coalesce(record_offset, try_cast(nullif(regexp_extract(record_ref, '^(topic=)?(.*?)( partition=|-)(\d+)( offset=|-)(\d+)$', 6), '') as bigint)) as record_offset)
  from task_log)
"""

RUNS = """
runs as (
  select run_id, last.topic as topic, last.partition_id as partition_id, last.from_offset as from_offset, last.to_offset as to_offset,
         last.started_at as started_at,
         case last.run_state when 'running' then 'leased' when 'succeeded' then 'done' else 'pending' end as item_state
  from (select run_id, arg_max(struct_pack(topic, partition_id, from_offset, to_offset, started_at, run_state), reported_at) as last
        from consume_runs group by run_id))
"""

PENDING = f"""
with {PLACED}, {RUNS},
contents as (select topic, partition_id, record_offset, task_bytes, min(landed_at) as landed from placed
             where topic is not null and partition_id is not null and record_offset is not null group by all),
newest as (select topic, partition_id, record_offset, max(landed) as landed from contents group by all),
covered as (
  select n.topic, n.partition_id, n.record_offset, any_value(n.landed) as landed, max(r.started_at) as started
  from newest n left join runs r on r.item_state = 'done' and r.topic = n.topic and r.partition_id = n.partition_id
       and n.record_offset between r.from_offset and r.to_offset
  group by n.topic, n.partition_id, n.record_offset)
select topic, partition_id, record_offset from covered where started is null or landed >= started
"""

LAYOUTS = """
with parsed as (
  select stream_no, file_no, case when json_valid(line) and json_type(line) = 'OBJECT' then line end as j from envelope_files),
heads as (select stream_no, file_no, count(j) as n_lines, count(*) - count(j) as n_bad from parsed group by all),
tops as (
  select stream_no, file_no, cast(null as varchar) as parent, unnest(json_keys(j)) as name, j from parsed where j is not null),
vals as (
  select stream_no, file_no, parent, name, json_extract(j, '$."' || name || '"') as v from tops),
subs as (
  select stream_no, file_no, name as parent, unnest(json_keys(v)) as name, v from vals where json_type(v) = 'OBJECT'),
every as (
  select stream_no, file_no, parent, name, json_type(v) as t from vals
  union all
  select stream_no, file_no, parent, name, json_type(json_extract(v, '$."' || name || '"')) from subs),
kinds as (
  select stream_no, file_no, parent, name,
         case t when 'VARCHAR' then 'string' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number'
                when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' end as kind, count(*) as n
  from every where t <> 'NULL' group by all),
layout as (
select k.stream_no, k.file_no, any_value(n_lines) as n_lines, any_value(n_bad) as n_bad, concat_ws('.', k.parent, k.name) as field_path, any_value(k.parent) as nested,
       arg_max(kind, n) as json_type
from kinds k join heads h on k.stream_no = h.stream_no and k.file_no = h.file_no
group by k.stream_no, k.file_no, k.parent, k.name
having sum(n) * 2 > any_value(n_lines)
)
"""

SQL = {
    "p1_layouts": f"{LAYOUTS} select * exclude nested from layout",
    "p1_unified_lines": "select stream_no, file_no, line_no from envelope_files where json_valid(line) and json_type(line) = 'OBJECT'",
    "p1_rejects": """
select stream_no, file_no, line_no, case when line is null then 'null' when trim(line, ' ' || chr(9) || chr(10) || chr(13)) = '' then 'empty' when json_valid(line) then 'no object' else 'broken' end as reason
from envelope_files where line is null or not json_valid(line) or json_type(line) <> 'OBJECT'
""",
    "p1_top_changes": f"""
{LAYOUTS}, files as (select stream_no, file_no, lag(file_no) over (partition by stream_no order by file_no) as prev_no from (select distinct stream_no, file_no from heads where n_lines > 0)),
tops_of as (select stream_no, file_no, field_path, json_type from layout where nested is null),
a as (select f.stream_no, f.file_no, t.field_path, t.json_type from files f join tops_of t on t.stream_no = f.stream_no and t.file_no = f.prev_no),
b as (select f.stream_no, f.file_no, t.field_path, t.json_type from files f join tops_of t on t.stream_no = f.stream_no and t.file_no = f.file_no where f.prev_no is not null)
select coalesce(a.stream_no, b.stream_no) as stream_no, coalesce(a.file_no, b.file_no) as file_no, coalesce(a.field_path, b.field_path) as field_path,
       case when b.field_path is null then 'gone' when a.field_path is null then 'came' else 'type_changed' end as what
from a full join b on a.stream_no = b.stream_no and a.file_no = b.file_no and a.field_path = b.field_path
where a.json_type is distinct from b.json_type
""",
    "p3_found": f"""
with {PLACED}, n as (select topic, task_key, count(*) as n from placed where topic is not null group by all)
select topic, decode(task_key) as task_key
from (select *, sum(n) over (partition by topic) as total from n)
where task_key is not null and octet_length(task_key) > 0 and n >= 0.05 * total
""",
    "p3_per_key": f"""
with {PLACED}, r as (
  select topic, task_key, record_timestamp as t, log_id, case when metadata.timestamp_millis > 0 then record_timestamp - metadata.timestamp_millis end as delay,
         case when json_valid(decode(task_bytes)) then json_extract_string(decode(task_bytes), '$.id') end as task_id
  from placed),
g as (select *, t - lag(t) over (partition by topic, task_key order by t, log_id) as gap from r)
select topic, decode(task_key) as task_key, count(*) as n_rows, min(t) as first_ms, max(t) as last_ms, max(gap) as max_gap,
       count(delay) as n_delays, cast(coalesce(sum(delay), 0) as bigint) as sum_delay, min(delay) as min_delay, max(delay) as max_delay,
       arg_max(log_id, (t, log_id)) as latest_log_id, arg_max(struct_pack(x := task_id), (t, log_id)).x as latest_task_id
from g group by topic, task_key
""",
    "p3_chunks": f"""
with {PLACED}, n as (select topic, task_key, count(*) as n from placed group by all)
select topic, cast(sum(n) as bigint) as n_rows, max(n) as hottest_key from n group by topic
""",
    "p5_found": PENDING,
    "p5_work_items": f"""
select topic || '/' || partition_id || '/' || (record_offset // 4096) as item, count(*) as n, min(record_offset) as from_offset, max(record_offset) as to_offset
from ({PENDING}) group by topic, partition_id, record_offset // 4096
""",
    "p5_ledger": f"""
with i as (select distinct topic || '/' || partition_id || '/' || (record_offset // 4096) as item from ({PENDING})),
r as (select item, row_number() over (order by item) as place, count(*) over () as n from i)
select item, case when place * 2 <= n + 1 then 'done' else 'pending' end as state, cast(case when place * 2 <= n + 1 then 2 else 1 end as bigint) as token,
       case when place * 2 <= n + 1 then 'other' end as owner from r
""",
    "p5_run_states": f"with {RUNS} select * from runs",
    "p6_found": f"""
with {PLACED} select topic, partition_id, record_offset from placed where topic is not null
group by topic, partition_id, record_offset having count(*) > 1
""",
    "p6_kept": f"""
with {PLACED}
select topic, partition_id, record_offset, arg_min(log_id, (batch_id // 96, log_id)) as log_id, count(*) as n
from placed where topic is not null group by topic, partition_id, record_offset
""",
}
