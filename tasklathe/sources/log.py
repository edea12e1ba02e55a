"""Log records from files or a broker, and from several topics at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "topic string, partition int, offset bigint, timestamp timestamp, timestampType int, key binary, value binary,"
    " headers array<struct<key:string,value:binary>>"
)


def union_topics(topics: dict[str, DataFrame]) -> DataFrame:
    """Records of several topics as one source, each row with its ``topic``; no topics are an error."""
    if not topics:
        raise ValueError("no topics")
    return reduce(DataFrame.unionByName, (df.withColumn("topic", F.lit(t)) for t, df in topics.items()))


def subscribed(topic: str, retry: bool = False, shaping: list[str] | None = None) -> list[str]:
    """The topics a subscription reads: origin, retry, shaping."""
    return list(dict.fromkeys([topic, *([f"{topic}-retry"] if retry else []), *(shaping or [])]))


def read_stream(spark: SparkSession, topics: list[str], *, servers: str | None = None, folder: str | None = None, max_per_trigger: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A stream of records: from a broker (``servers``; needs Spark's kafka package) or from Parquet files below ``folder``/<topic>.

    ``max_per_trigger`` bounds a micro-batch: offsets of a broker, files of a folder.
    """
    if (servers is None) == (folder is None):
        raise ValueError("give servers or folder")
    if servers is not None:
        r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true")
        if max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        return r.options(**(options or {})).load()
    streams = []
    for t in topics:
        r = spark.readStream.schema(RECORD).option("recursiveFileLookup", "true")
        if max_per_trigger:
            r = r.option("maxFilesPerTrigger", max_per_trigger)
        streams.append(r.options(**(options or {})).parquet(f"{folder}/{t}"))
    return reduce(DataFrame.unionByName, streams)


def read_batch(spark: SparkSession, topics: list[str], *, servers: str | None = None, folder: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The same records as a bounded table."""
    if servers is not None:
        r = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true")
        return r.options(**(options or {})).load()
    return reduce(DataFrame.unionByName, (spark.read.schema(RECORD).option("recursiveFileLookup", "true").options(**(options or {})).parquet(f"{folder}/{t}") for t in topics))
