"""Queries of problems 2, 4, 7, 8 and 9, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.landed import table, with_position
from tasklathe.llm import frequent, leakage, linespam, packing, percentiles
from tasklathe.plans.landed_queries import PLACED
from tasklathe.shared import written

QUANTILES = [0.5, 0.9, 0.99, 0.999]
SHARE = 0.005
BITS = 7


def _delays(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "task_log")
    sent = F.col("metadata.timestamp_millis")
    return log.select(
        F.col("metadata.source_application_id").alias("source_application_id"),
        F.date_from_unix_date(F.floor(F.col("record_timestamp") / 86_400_000).cast("int")).cast("string").alias("day"),  # of UTC
        "topic",
        "partition_id",
        "record_offset",
        "record_ref",
        F.when(sent != 0, F.col("record_timestamp") - sent).alias("delay"),
    )


GRAINS = {"all": [], "day": ["day"], "partition": ["topic", "partition_id"], "day and partition": ["day", "topic", "partition_id"]}


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the delay per application: over all rows, per day, per partition, and per both.

    The folds of days and partitions are made once; the coarser grains are
    their combinations.
    """
    parts = ["day", "topic", "partition_id"]
    finest = written(percentiles.fold_values(with_position(_delays(spark, d)), ["source_application_id", *parts], F.col("delay")), "folds")
    every = None
    for grain, kept in GRAINS.items():
        f = finest.select("source_application_id", F.lit(grain).alias("grain"), *(F.col(c) if c in kept else F.lit(None).cast(finest.schema[c].dataType).alias(c) for c in parts), "value", "n")
        f = f if len(kept) == len(parts) else percentiles.combine(f, ["source_application_id", "grain", *parts])
        every = f if every is None else every.unionByName(f)
    return percentiles.multi_select(every, ["source_application_id", "grain", *parts], QUANTILES).withColumnRenamed("value", "delay_ms")


def p2_selected(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per application by the rounds alone: nothing is left to a sort."""
    folded = percentiles.fold_values(_delays(spark, d), ["source_application_id"], F.col("delay"))
    return percentiles.multi_select(folded, ["source_application_id"], QUANTILES, finish=0).withColumnRenamed("value", "delay_ms")


def p2_folds(spark: SparkSession, d: str) -> DataFrame:
    """The form that is kept and combined: delays of an application, day and partition folded to values of 7 leading bits."""
    placed = with_position(_delays(spark, d))
    return percentiles.fold_values(placed, ["source_application_id", "day", "topic", "partition_id"], F.col("delay"), bits=BITS)


def p2_combined_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from folds of bounded size per application, day and partition, combined afterwards; error at most 1/128 of the value."""
    placed = with_position(_delays(spark, d))
    folded = percentiles.fold_values(placed, ["source_application_id", "day", "topic", "partition_id"], F.col("delay"), bits=BITS)
    group = ["source_application_id"]
    return percentiles.multi_select(percentiles.combine(folded, group), group, QUANTILES).withColumnRenamed("value", "delay_ms")


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "task_log").select("task_key", F.col("metadata.source_instance_id").alias("source_instance_id"))
    # empty items are no cases, but stay in the total
    items = {"task_key": F.nullif(F.decode("task_key", "UTF-8"), F.lit("")), "source_instance_id": F.nullif(F.col("source_instance_id"), F.lit(""))}
    return frequent.frequent(log, items, SHARE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("field_name", "item")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Verified counts of the most frequent values."""
    return _frequent(spark, d).select("field_name", "item", "n", "total")


def p4_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's own counts beside the verified ones."""
    return _frequent(spark, d)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_texts(table(spark, d, "documents"))
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack_texts(table(spark, d, "documents")))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every document: all its tokens are placed, it is split only where it must be, and no container it lies in is too full."""
    docs = table(spark, d, "documents")
    packed = written(packing.pack_texts(docs), "packed")
    loads = packed.filter("container_no is not null").groupBy("container_no").agg((F.sum("length") <= packing.CAPACITY).alias("fits"))
    per = packed.join(loads, "container_no", "left").groupBy("id").agg(F.sum("length").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.bool_and(F.coalesce("fits", F.lit(True))).alias("fits"))
    n = F.col("n_tokens")
    return packing.token_counts(docs).join(per, "id").select(
        F.col("id").alias("doc_id"), (n > 0).alias("has_tokens"), (n == F.col("placed")).alias("kept"), (F.col("pieces") == F.greatest(F.lit(1), F.ceil(n / packing.CAPACITY))).alias("unsplit"), "fits"
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return linespam.spam_pages(table(spark, d, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return linespam.page_shares(table(spark, d, "documents"))


_QUERIES = (
    p2_percentiles,
    p2_combined_percentiles,
    p2_selected,
    p2_folds,
    p4_found,
    p4_counts,
    p4_estimates,
    p7_containers,
    p7_fill,
    p7_documents,
    p8_found,
    p8_paraphrases,
    p9_found,
    p9_shares,
)

_DELAYS = """
delays as (
  select metadata.source_application_id as source_application_id, topic, partition_id, strftime(epoch_ms(record_timestamp), '%Y-%m-%d') as day,
         record_timestamp - metadata.timestamp_millis as delay
  from placed where metadata.timestamp_millis <> 0 and record_timestamp is not null)
"""


def _quantiles(group: str, source: str) -> str:
    return f"""
select {group}, q as quantile, cast(value as bigint) as delay_ms, n from (
  select {group}, count(*) as n, unnest([0.5, 0.9, 0.99, 0.999]::double[]) as q,
         unnest(quantile_disc(delay, [0.5, 0.9, 0.99, 0.999])) as value
  from {source} group by {group})
"""


_COARSE = f"""
with {PLACED}, {_DELAYS}, s as (select *, greatest(length(bin(abs(delay))) - {BITS}, 0) as k from delays),
coarse as (select source_application_id, day, topic, partition_id, (case when delay < 0 then -1 else 1 end)
  * (((abs(delay) >> k) << k) + case when k > 0 then 1::bigint << (k - 1) else 0 end) as delay from s)
"""


_COUNTS = """
with v as (
  select 'task_key' as field_name, decode(task_key) as item from task_log
  union all select 'source_instance_id', metadata.source_instance_id from task_log),
n as (select field_name, item, count(*) as n from v group by all),
t as (select count(*) as total from task_log)
select field_name, item, n, total from n, t where item is not null and item <> '' and n >= 0.005 * total
"""


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_percentiles": f"""
with {PLACED}, {_DELAYS}, g as (
  select source_application_id, day, topic, partition_id, grouping(day) as no_day, grouping(topic) as no_part, count(*) as n,
         quantile_disc(delay, [0.5, 0.9, 0.99, 0.999]) as v
  from delays group by grouping sets ((source_application_id), (source_application_id, day), (source_application_id, topic, partition_id),
                                      (source_application_id, day, topic, partition_id)))
select source_application_id, case when no_day = 1 and no_part = 1 then 'all' when no_part = 1 then 'day' when no_day = 1 then 'partition'
         else 'day and partition' end as grain, day, topic, partition_id, unnest([0.5, 0.9, 0.99, 0.999]::double[]) as quantile, unnest(v) as delay_ms, n
from g
""",
        "p2_combined_percentiles": _COARSE + _quantiles("source_application_id", "coarse"),
        "p2_selected": f"with {PLACED}, {_DELAYS} " + _quantiles("source_application_id", "delays"),
        "p2_folds": _COARSE + "select source_application_id, day, topic, partition_id, delay as value, count(*) as n from coarse group by all",
        "p7_documents": "select doc_id, coalesce(text, '') <> '' as has_tokens, true as kept, true as unsplit, true as fits from documents",
        "p4_found": f"select field_name, item from ({_COUNTS})",
        "p4_counts": _COUNTS,
    }
