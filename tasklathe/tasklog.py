"""The task log that the log queries run on, mapped from ``events``.

topic 'events'; partition p = user_id % 4; offset o by arrival; key k; time t
in epoch milliseconds; duration d; completed; scheduled.  ``LOG_SQL`` is the
same mapping for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.functions.times import zoneless_micros
from tasklathe.operators.scan import running

N_PARTITIONS = 4
NUMBERING_BLOCK = 600_000_000  # microseconds of arrival that one task numbers at a time


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, topic, p, o, k, t, event_type, value, props, d, completed, scheduled."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("p", F.pmod("user_id", F.lit(N_PARTITIONS)).cast("int"))
    e = e.withColumn("_us", zoneless_micros(F.col("ts")))
    e = running(e, ["p"], ["_us", "event_id"], {"o": ("sum", F.lit(1))}, block=NUMBERING_BLOCK).withColumn("o", F.col("o") - 1)
    t = F.floor(F.col("_us") / 1000)
    return e.select(
        "event_id",
        F.lit("events").alias("topic"),
        "p",
        F.col("o").cast("bigint").alias("o"),
        F.col("user_id").cast("string").alias("k"),
        t.alias("t"),
        "event_type",
        "value",
        "props",
        (F.round(F.col("value") * 100).cast("bigint") * 100).alias("d"),
        ((F.col("event_type") != "error") | (F.col("o") % 50 > 0)).alias("completed"),
        F.when(F.col("event_type") == "purchase", t + F.pmod("user_id", F.lit(5)) * 1000).otherwise(F.lit(0).cast("bigint")).alias("scheduled"),
    )


LOG_SQL = """
log as (
  select *, row_number() over (partition by p order by ts, event_id) - 1 as o from (
    select event_id, 'events' as topic, cast(user_id % 4 as int) as p, ts, user_id, cast(user_id as varchar) as k, epoch_us(ts) // 1000 as t,
           event_type, value, props, cast(round(value * 100) as bigint) * 100 as d from events)),
tlog as (
  select *, (event_type <> 'error' or o % 50 > 0) as completed,
         case when event_type = 'purchase' then t + (user_id % 5) * 1000 else 0 end as scheduled from log)
"""
