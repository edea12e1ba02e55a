"""A declared subscription over a stream of records: tasks handed on, retries sent and consumed again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tasklathe.operators.schedule import MAX_RATE
from tasklathe.plans.pipeline import Subscription
from tasklathe.sources.sinks import Writer


def pace(df: DataFrame, rate: float, spent: float, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait until a micro-batch has taken as long as its fullest partition needs at ``rate`` tasks a second."""
    if 0 < rate <= MAX_RATE:
        most = df.groupBy("topic", "partition").count().agg(F.max("count")).first()[0] or 0
        sleep(max(0.0, most / rate - spent))


def start(subscription: Subscription, records: DataFrame, checkpoint: str, on_tasks: Callable[[DataFrame, int], None], retry_writer: Writer | None = None, **trigger) -> StreamingQuery:
    """Run the subscription on every micro-batch.

    ``records`` should read all of ``subscription.topics()``.  ``on_tasks`` gets
    the processed tasks and the batch's id; ``retry_writer`` the records to put
    again.  Both must be safe to repeat for the same id: a batch that died
    half-way is run again whole, so that nothing is lost and each effect happens
    once where the writer replaces its output.  Settings are read per batch.

    A quota in force is refused: its windows would begin anew with every batch.
    A rate holds on average: the next batch begins when this one's fullest
    partition would be done at that rate (``wait_ms`` counts within a batch); a
    rate of 0 is an error here, it means not to run at all (``supervisor``).
    """
    if "timestamp" in records.columns and dict(records.dtypes)["timestamp"] != "bigint":
        records = records.withColumn("timestamp", F.unix_millis("timestamp"))

    if subscription.quota() is not None:
        raise ValueError("a quota needs the whole log; key rates aren't kept from one micro-batch to the next")

    def batch(df: DataFrame, batch_id: int) -> None:
        if subscription.quota() is not None:  # settings may have changed
            raise ValueError("a quota was set while the subscription runs")
        began, rate = time.monotonic(), subscription.properties["processing.rate.per.partition"]
        if rate == 0:
            raise ValueError("a rate of 0 pauses the subscription: let a supervisor stop the query")
        r = subscription.run(df)
        on_tasks(r.processed, batch_id)
        if r.retries is not None and retry_writer is not None:
            retry_writer(r.retries.select("topic", "key", "value", "headers"), batch_id)
        pace(df, rate, time.monotonic() - began)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()
