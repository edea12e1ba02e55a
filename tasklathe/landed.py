"""The landed task log: one row per landing of a record.

``with_position`` gives every row its position (topic, partition_id,
record_offset), parsing ``record_ref`` where the three columns are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two spellings of a record reference.
NAMED_REF = r"^topic=(.*) partition=(\d+) offset=(\d+)$"
DASHED_REF = r"^(.*)-(\d+)-(\d+)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(ref: Column, i: int) -> Column:
    named = F.regexp_extract(ref, NAMED_REF, i)
    return F.nullif(F.when(ref.startswith("topic="), named).otherwise(F.regexp_extract(ref, DASHED_REF, i)), F.lit(""))


def with_position(log: DataFrame) -> DataFrame:
    """Fill topic, partition_id and record_offset from ``record_ref``.

    A reference that fits neither spelling leaves them null.  The column
    ``record_ref`` is dropped; all others pass unchanged.
    """
    ref = F.col("record_ref")
    known = F.col("topic").isNotNull()
    return log.withColumns(
        {
            "topic": F.when(known, F.col("topic")).otherwise(_part(ref, 1)),
            "partition_id": F.when(known, F.col("partition_id")).otherwise(_part(ref, 2).try_cast("int")),
            "record_offset": F.when(known, F.col("record_offset")).otherwise(_part(ref, 3).try_cast("bigint")),
        }
    ).drop("record_ref")


def task_id(task_bytes: Column) -> Column:
    """The ``id`` in the JSON of ``task_bytes``; null if it is missing or cut off."""
    return F.get_json_object(F.decode(task_bytes, "UTF-8"), "$.id")


def positions(log: DataFrame, *extra: str) -> DataFrame:
    """Columns topic, partition_id, record_offset and ``extra`` of every row."""
    return with_position(log).select("topic", "partition_id", "record_offset", *extra)
