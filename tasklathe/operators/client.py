"""Putting tasks: metadata, headers, keys and the ids of results."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.functions.wire import METADATA_TYPE, encode_envelope, encode_metadata
from tasklathe.operators.extract import HEADERS_TYPE, with_header

# What producers are set to unless told otherwise.
PRODUCER_DEFAULTS = {"acks": "all", "max.in.flight.requests.per.connection": "1"}
RETRY_PRODUCER_DEFAULTS = {"linger.ms": "100"}
PRINTABLE = r"^[\x20-\x7E]*$"


def producer_options(user: dict[str, str], preset: dict[str, str] = PRODUCER_DEFAULTS) -> dict[str, str]:
    """Presets with the user's settings on top."""
    return {**preset, **user}


def filled_metadata(application: str, instance: str, now_ms: int | None = None, timestamp: Column | None = None, scheduled: Column | None = None) -> Column:
    """Metadata of a task to put: the caller's times where given, else the clock's and none."""
    now = F.lit(now_ms if now_ms is not None else int(time.time() * 1000)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return F.struct(
        (F.coalesce(timestamp, now) if timestamp is not None else now).alias("timestamp_millis"),
        F.lit(application).alias("source_application_id"),
        F.lit(instance).alias("source_instance_id"),
        zero.alias("retry_count"),
        (F.coalesce(scheduled, zero) if scheduled is not None else zero).alias("scheduled_time_millis"),
    ).cast(METADATA_TYPE)


def ascii_key(key: Column) -> Column:
    """Key bytes of a string of printable ASCII; null stays null, any other character is an error."""
    return F.when(key.rlike(PRINTABLE), F.encode(key, "US-ASCII")).when(key.isNull(), F.lit(None).cast("binary")).otherwise(F.raise_error(F.concat(F.lit("illegal character in key: "), key)))


def is_ascii_key(key: Column) -> Column:
    return key.isNull() | key.rlike(PRINTABLE)


def to_records(df: DataFrame, topic: str, key: Column, task_bytes: Column, metadata: Column, partition: Column | None = None, legacy: bool = False) -> DataFrame:
    """Records to write: topic, partition, key, value, headers.

    Normally the metadata goes into a header and the value is the task;
    ``legacy`` writes an envelope as the value and no header.
    """
    none = F.array().cast(HEADERS_TYPE)
    value, headers = (encode_envelope(metadata, task_bytes), none) if legacy else (task_bytes, with_header(none, encode_metadata(metadata)))
    return df.select(
        F.lit(topic).alias("topic"),
        (partition if partition is not None else F.lit(None)).cast("int").alias("partition"),
        ascii_key(key).alias("key"),
        value.alias("value"),
        headers.alias("headers"),
    )


def put_or_error(df: DataFrame, topic: str, key: Column, task_bytes: Column, metadata: Column, partition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records to write, rows that can't be put with their ``error``), instead of failing all for a key that isn't printable ASCII."""
    ok = is_ascii_key(key)
    error = F.concat(F.lit("illegal character in key: "), key)
    return to_records(df.filter(ok), topic, key, task_bytes, metadata, partition), df.filter(~ok).withColumn("error", error)


def put_result_id(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws("-", topic, partition.cast("string"), offset.cast("string"))


def request_id(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat(F.lit("topic="), topic, F.lit(" partition="), partition.cast("string"), F.lit(" offset="), offset.cast("string"))
