"""Retries: tasks put again under a later scheduled time, with their count raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.functions.wire import encode_envelope, encode_metadata
from tasklathe.operators.extract import METADATA_HEADER, with_header

RETRY_SUFFIX = "-retry"


def retry_topic(topic: Column, custom: str | None = None) -> Column:
    return F.lit(custom) if custom else F.concat(topic, F.lit(RETRY_SUFFIX))


def retried_metadata(metadata: Column, now: Column, backoff: int) -> Column:
    """The metadata of a task put again: count + 1, scheduled after the backoff, all else kept."""
    return metadata.withField("retry_count", metadata["retry_count"] + 1).withField("scheduled_time_millis", (now + backoff).cast("bigint"))


def retry_records(failed: DataFrame, now: Column, backoff: int, custom_topic: str | None = None, legacy: bool = False) -> DataFrame:
    """Records to write for tasks to retry: same key and headers, the metadata header replaced (legacy: an envelope and no header)."""
    m = retried_metadata(F.col("metadata"), now, backoff)
    if legacy:
        value = encode_envelope(m, F.col("task_bytes"))
        headers = F.filter("headers", lambda h: h["key"] != METADATA_HEADER)
    else:
        value, headers = F.col("task_bytes"), with_header(F.col("headers"), encode_metadata(m))
    return failed.select(retry_topic(F.col("topic"), custom_topic).alias("topic"), "key", value.alias("value"), headers.alias("headers"), m.alias("metadata"))


def attempts(df: DataFrame, retries: Column, time: Column, backoff: int) -> DataFrame:
    """One row per attempt of a task: ``attempt`` from 0 to ``retries``, run_at its earliest time."""
    n = F.greatest(F.coalesce(retries, F.lit(0)), F.lit(0)).cast("bigint")
    return df.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), n))).withColumn("run_at", time + F.col("attempt") * backoff)
