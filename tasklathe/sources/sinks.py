"""Writing records to topics, on a broker or as Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklathe.operators.client import PRODUCER_DEFAULTS, RETRY_PRODUCER_DEFAULTS, producer_options
from tasklathe.operators.extract import HEADERS_TYPE
from tasklathe.operators.partitioner import log_partition
from tasklathe.operators.scan import running

Writer = Callable[[DataFrame, int], None]


def folder_writer(folder: str, topics: list[str], n_partitions: int = 1) -> Writer:
    """Writes each topic's records (topic, key, value, headers) of a micro-batch to ``folder``/<topic>/b-<batch id>.

    Partitions follow from the keys as a producer's would, null keys go to
    partition 0; offsets go up with the batch and, in it, an order that follows
    from key and value alone, numbered in blocks by many tasks.  A batch written again
    replaces itself.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for t in topics:
                rows = df.filter(F.col("topic") == t)
                headers = F.col("headers") if "headers" in df.columns else F.array().cast(HEADERS_TYPE)
                part = F.coalesce(log_partition(F.col("key"), n_partitions), F.lit(0)).cast("int")
                placed = rows.select("topic", part.alias("partition"), "key", "value", headers.alias("headers"))
                order = F.xxhash64("key", "value")
                placed = running(placed.withColumn("_h", order), ["partition"], ["_h", "key", "value"], {"_n": ("sum", F.lit(1))}, block=2**58)
                at = F.col("_n")
                placed.select(
                    "topic",
                    "partition",
                    (F.lit(batch_id).cast("bigint") * 1_000_000_000 + at).alias("offset"),
                    F.current_timestamp().alias("timestamp"),
                    F.lit(0).alias("timestampType"),
                    "key",
                    "value",
                    "headers",
                ).write.mode("overwrite").parquet(f"{folder}/{t}/b-{batch_id}")
        finally:
            df.unpersist()

    return write


def broker_options(servers: str, options: dict[str, str] | None = None, retries: bool = False) -> dict[str, str]:
    """What a broker's writer is set to: the producers' presets (``retries``: those of the retry producer too), the user's settings on top."""
    preset = PRODUCER_DEFAULTS | (RETRY_PRODUCER_DEFAULTS if retries else {})
    return {f"kafka.{k}": v for k, v in producer_options(options or {}, preset).items()} | {"kafka.bootstrap.servers": servers, "includeHeaders": "true"}


def broker_writer(servers: str, options: dict[str, str] | None = None, retries: bool = False) -> Writer:
    """Writes records (topic, key, value, headers) to a broker; delivery is at least once. ``options``: the producer's settings."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.select("topic", "key", "value", "headers").write.format("kafka").options(**broker_options(servers, options, retries)).save()

    return write
