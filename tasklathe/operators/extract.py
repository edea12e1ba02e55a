"""From log records to tasks: metadata from the header, the legacy envelope or the record.

Records have topic, partition, offset, timestamp (epoch ms), key, value
(binary) and headers (array of key, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.functions.wire import METADATA_TYPE, decode_envelope, decode_metadata

# Fixed value: the header that holds the metadata.
METADATA_HEADER = "dt_meta"
HEADERS_TYPE = "array<struct<key:string,value:binary>>"


def last_header(headers: Column, name: str = METADATA_HEADER) -> Column:
    """Value of the last header of that name; null without one."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(-1))["value"]


def with_header(headers: Column, value: Column, name: str = METADATA_HEADER) -> Column:
    """Headers with every one of that name taken out and one put at the end; null headers count as none."""
    rest = F.coalesce(F.filter(headers, lambda h: h["key"] != name), F.array().cast(HEADERS_TYPE))
    return F.concat(rest, F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))))


def empty_metadata(timestamp: Column) -> Column:
    zero, no = F.lit(0).cast("bigint"), F.lit("")
    return F.struct(
        timestamp.cast("bigint").alias("timestamp_millis"),
        no.alias("source_application_id"),
        no.alias("source_instance_id"),
        zero.alias("retry_count"),
        zero.alias("scheduled_time_millis"),
    ).cast(METADATA_TYPE)


def default_extract(df: DataFrame, legacy_fallback: bool = False) -> DataFrame:
    """Add ``metadata`` and ``task_bytes``.

    With a metadata header the value is the task.  Without one, the value is
    read as a legacy envelope if ``legacy_fallback``, else it is the task and
    the metadata has the record's timestamp and defaults.  What can't be read
    gives nulls (see ``split_discarded``).
    """
    raw = last_header(F.col("headers"))
    df = df.withColumn("_h", raw).withColumn("_m", decode_metadata(F.col("_h")))
    if legacy_fallback:
        df = df.withColumn("_e", decode_envelope(F.when(F.col("_h").isNull(), F.col("value"))))
        bare, task = decode_metadata(F.col("_e.metadata")), F.col("_e.task")
    else:
        bare, task = empty_metadata(F.col("timestamp")), F.col("value")
    has = F.col("_h").isNotNull()
    out = df.withColumns({"metadata": F.when(has, F.col("_m")).otherwise(bare), "task_bytes": F.when(has, F.col("value")).otherwise(task)})
    return out.drop("_h", "_m", "_e")


def custom_extract(df: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """Add ``task`` by a caller's expression on ``task_bytes``; it should give null where it fails (from_json, try_cast)."""
    return df.withColumn("task", extract(F.col("task_bytes")))


def json_task(schema: str) -> Callable[[Column], Column]:
    """An extractor for JSON tasks: broken JSON gives null."""
    marked = f"{schema}, _broken string"

    def run(raw: Column) -> Column:
        got = F.from_json(F.decode(raw, "UTF-8"), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        return F.when(got["_broken"].isNull() & raw.isNotNull(), got.dropFields("_broken"))

    return run


def retry_extract(df: DataFrame, retry_topic: str, extract: Callable[[Column], Column], legacy_fallback: bool = False) -> DataFrame:
    """Extract with the user's extractor on both the origin and the retry topic.

    On the retry topic the record was rewrapped, so its own metadata (with the
    retry count) is the outer one: it is read first and wins.
    """
    outer = default_extract(df, legacy_fallback)
    on_retry = F.col("topic") == retry_topic
    task = F.when(on_retry, F.col("task_bytes")).otherwise(F.col("value"))
    plain = empty_metadata(F.col("timestamp"))
    return outer.withColumns({"metadata": F.when(on_retry, F.col("metadata")).otherwise(plain), "task_bytes": task}).withColumn("task", extract(F.col("task_bytes")))


def split_discarded(df: DataFrame, task: str = "task") -> tuple[DataFrame, DataFrame]:
    """(valid, discarded): a row without task, metadata or bytes is discarded; its offset still counts as done."""
    bad = F.col(task).isNull() | F.col("metadata").isNull() | F.col("task_bytes").isNull()
    return df.filter(~bad), df.filter(bad)


def records_by_format(df: DataFrame) -> DataFrame:
    """Records with the metadata header and without: format, n."""
    kind = F.when(last_header(F.col("headers")).isNotNull(), "header").otherwise("other")
    return df.groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("n"))


def with_trace(df: DataFrame, header: str, stages: list[str]) -> DataFrame:
    """Add ``trace_id`` from a header and ``spans``: the trace itself and one child per stage; nulls without the header."""
    trace = F.decode(last_header(F.col("headers"), header), "UTF-8")
    df = df.withColumn("trace_id", trace)
    spans = F.array(F.col("trace_id"), *(F.concat(F.col("trace_id"), F.lit(f"-{s}")) for s in stages))
    return df.withColumn("spans", F.when(F.col("trace_id").isNotNull(), spans))


def logging_context(subscription: str, enabled: bool = True) -> Column:
    """Diagnostic map of a row; empty when switched off."""
    if not enabled:
        return F.create_map().cast("map<string,string>")
    text = lambda c: F.col(c).cast("string")
    return F.create_map(
        *(x for k, v in {"dt_offset": text("offset"), "dt_topic": text("topic"), "dt_partition": text("partition"), "dt_task_key": text("key"), "dt_subscription_id": F.lit(subscription)}.items() for x in (F.lit(k), v))
    )
