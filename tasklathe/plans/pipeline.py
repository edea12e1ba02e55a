"""A subscription declared step by step; it becomes one DataFrame plan, batch or streaming.

    (Subscription("sub", "events")
        .consuming(json_task("k int"))
        .then(lambda df: df.filter("task.k > 3"))
        .ignore_keys(["7"])
        .enable_retry(backoff_ms=5000)
        .run(records))
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklathe.config import Properties
from tasklathe.operators import extract, filters, partitioner, quota, retry, runtime, schedule
from tasklathe.operators.quota import QuotaConfig
from tasklathe.operators.scan import running
from tasklathe.sources.log import subscribed

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Result:
    """What a subscription makes of records: the processed tasks, what was discarded, failed rows, and records to send again.

    shaped: with a quota, the records of bursts to send on, as they came
    (topic, key, value, headers); they are not processed here.
    """

    processed: DataFrame
    discarded: DataFrame
    failed: DataFrame
    retries: DataFrame | None
    shaped: DataFrame | None = None


@dataclass
class Subscription:
    """A processor of one topic. Each stage takes and returns a DataFrame: dropping rows, changing them, or making several of one.

    A stage may add a string column ``error``: its rows count as failed, and
    as done.  A stage may set a boolean column ``retry``: with retries enabled
    its rows are put again.
    """

    subscription_id: str
    topic: str
    properties: Properties = field(default_factory=Properties)
    _extract: Callable[[Column], Column] | None = None
    _raw: bool = False
    _stages: list[Stage] = field(default_factory=list)
    _keys: list[str] = field(default_factory=list)
    _backoff: int | None = None
    _retry_topic: str | None = None
    _quota: QuotaConfig | None = None

    def consuming(self, extractor: Callable[[Column], Column], raw: bool = False) -> Subscription:
        """How to read a task from its bytes.

        Normally these are the record's task bytes, with the metadata of its
        header or envelope.  ``raw``: the extractor reads the whole value of
        records of the origin topic, which carry no metadata.
        """
        self._extract, self._raw = extractor, raw
        return self

    def then(self, *stages: Stage) -> Subscription:
        self._stages.extend(stages)
        return self

    def processing(self, factory: Callable[[], runtime.Processor], schema: str, threads: int = 1) -> Subscription:
        """A stage that runs a caller's processor: per key in order, on the partition's concurrency, giving up after the timeout of the properties.

        Its rows have the columns of ``schema``, ``completion`` and ``error``;
        the processor gets the extracted task's columns as dicts.
        """

        def run(df: DataFrame) -> DataFrame:
            flat = df.select("topic", "partition", "offset", F.decode("key", "UTF-8").alias("key"), *(["task.*"] if dict(df.dtypes)["task"].startswith("struct") else ["task"]))
            return runtime.process(flat, factory, schema, "key", ["partition", "offset"], threads=max(threads, self.properties["partition.concurrency"]), timeout_ms=self.properties["deferred.complete.timeout.ms"])

        return self.then(run)

    def ignore_keys(self, keys: Iterable[str]) -> Subscription:
        self._keys.extend(keys)
        return self

    def enable_retry(self, backoff_ms: int, topic: str | None = None) -> Subscription:
        self._backoff, self._retry_topic = backoff_ms, topic or f"{self.topic}-retry"
        return self

    def enable_quota(self, config: QuotaConfig) -> Subscription:
        self._quota = config
        return self

    def overriding(self, **suppliers: Any) -> Subscription:
        self.properties = Properties(suppliers)
        return self

    def topics(self) -> list[str]:
        return subscribed(self.topic, self._retry_topic is not None, [self._quota.target(self.topic)] if self._quota else None)

    def quota(self) -> QuotaConfig | None:
        """The quota in force: its rate, or where it has none that of the properties; None if unlimited."""
        if self._quota is None:
            return None
        config = self._quota if self._quota.rate >= 0 else replace(self._quota, rate=self.properties["per.key.quota.processing.rate"])
        return config if config.rate >= 0 else None

    def _paced(self, kept: DataFrame) -> DataFrame:
        """Records with what the properties say on their pace: ``wait_ms`` under a rate per partition, ``lane`` under a concurrency above 1.

        A rate of 0 lets nothing pass.  Records of other topics than the origin
        have limiters of their own.
        """
        rate, lanes = self.properties["processing.rate.per.partition"], self.properties["partition.concurrency"]
        if rate >= 0:
            arrived = running(kept, ["topic", "partition"], "offset", {"_at": ("max", F.col("timestamp"))})
            kept = schedule.token_bucket(arrived, ["topic", "partition"], "offset", F.coalesce("_at", F.lit(0)), rate).withColumnRenamed("wait", "wait_ms").drop("_at")
        if lanes > 1:
            kept = partitioner.with_lanes(kept, F.col("key"), "partition", "offset", lanes)
        return kept

    def _split_bursts(self, kept: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """What complies with the quota, and the bursts.

        Keyed records of the origin topic are counted, by arrival; a record
        arrives no earlier than the ones before it in its partition.
        """
        config = self.quota()
        if config is None:
            return kept, None
        columns = kept.columns
        arrived = running(kept.filter((F.col("topic") == self.topic) & F.col("key").isNotNull()), ["partition"], "offset", {"_at": ("max", F.col("timestamp"))})
        timed = quota.windowed_key_stat(arrived.filter("_at is not null"), "partition", "key", "_at", "offset", config.window_ms)
        routed = quota.shaped(quota.decided(timed, self.topic, "topic", "key", config), "topic", config, self.topic)
        violates = F.col("usage.type") == quota.VIOLATE
        others = kept.filter(~F.col("topic").eqNullSafe(self.topic) | F.col("key").isNull())
        passed = others.unionByName(arrived.filter("_at is null").select(columns)).unionByName(routed.filter(~violates).select(columns))
        return passed, routed.filter(violates).select(F.col("target").alias("topic"), "key", "value", "headers")

    def run(self, records: DataFrame, now: Column | None = None) -> Result:
        """The plan over records (topic, partition, offset, timestamp in ms, key, value, headers).

        Key rates of a quota are those of these records alone, so give it the
        whole log, not a micro-batch.
        """
        if self._extract is None:
            raise ValueError("say what to consume first")
        keys = [*self._keys, *self.properties["ignore.keys"]]
        # keys are dropped on the raw column, before anything is parsed
        kept = filters.ignore_keys(records, "key", [k.encode() for k in keys])
        kept, bursts = self._split_bursts(kept)
        kept = self._paced(kept)
        legacy = self.properties["legacy.parse.fallback.enabled"]
        if self._raw:
            tasks = extract.retry_extract(kept, self._retry_topic or f"{self.topic}-retry", self._extract, legacy)
        else:
            tasks = extract.custom_extract(extract.default_extract(kept, legacy), self._extract)
        valid, discarded = extract.split_discarded(tasks)
        out = valid
        for s in self._stages:
            out = out.transform(s)
        failed = out.filter(F.col("error").isNotNull()) if "error" in out.columns else out.limit(0)
        again = None
        if "retry" in out.columns:
            if self._backoff is None:
                raise ValueError("a stage asks for retries, but they aren't enabled")
            at = now if now is not None else F.unix_millis(F.current_timestamp())
            wanted = out.filter(F.col("retry"))
            if self._retry_topic is not None:
                wanted = wanted.withColumn("topic", F.lit(self.topic))
            again = retry.retry_records(wanted, at, self._backoff, self._retry_topic, self.properties["retry.task.in.legacy.format"])
        return Result(out, discarded, failed, again, bursts)


@dataclass
class Client:
    """Puts tasks on a topic: builds records with metadata; writing them is the caller's (``sources.sinks``)."""

    topic: str
    application: str
    instance: str

    def records(self, df: DataFrame, key: Column, task_bytes: Column, timestamp: Column | None = None, scheduled: Column | None = None, partition: Column | None = None, now_ms: int | None = None) -> DataFrame:
        from tasklathe.operators.client import filled_metadata, to_records

        return to_records(df, self.topic, key, task_bytes, filled_metadata(self.application, self.instance, now_ms, timestamp, scheduled), partition)
