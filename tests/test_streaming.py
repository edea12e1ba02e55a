"""Streaming forms give what the batch operators give."""

import pytest

from pyspark.sql import functions as F

from tasklathe.operators import batching, compaction, quota
from tasklathe.sources.log import read_batch, read_stream
from tasklathe.sources.sinks import folder_writer
from tasklathe.streaming import processors as P
from tasklathe.streaming.listener import Progress

W = 1000


def log(spark, n=120):
    r = [(i % 2, i // 2, str(i * 7 % 5), 10_000 + i * 130 + (i % 3) * 40, float(i * 37 % 11)) for i in range(n)]
    return spark.createDataFrame(r, "p int, o bigint, k string, t bigint, v double")


def stream(spark, tmp_path, df, files=3):
    cuts = [df.agg(F.max("o")).first()[0] * i // files for i in range(1, files)]
    edges = [-1, *cuts, 10**9]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        df.filter((F.col("o") > a) & (F.col("o") <= b)).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    src = tmp_path / "in"
    src.mkdir()
    for i in range(files):
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(src / f"{i:03d}-{f.name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_compaction(spark, tmp_path, rows):
    df = log(spark)
    for pick in ("latest", "max"):
        want = compaction.compact(df, "k", "t", "o", W, pick, F.col("v")).select("k", "w0", "n", "o", "t")
        d = tmp_path / pick
        d.mkdir()
        s = P.with_event_time(stream(spark, d, df), "t")
        got = rows(drain(P.run_stateful(s, ["k"], P.Compaction(W, pick)), d, f"compaction_{pick}"))
        every = rows(want)
        # the last window of a key closes when the watermark passes it; all closed ones agree
        assert got and set(got) <= set(every)
        assert len(every) - len(got) <= 5


def test_batching(spark, tmp_path, rows):
    df = log(spark)
    want = set(rows(batching.flushed(batching.batches(df, ["p"], "t", "o", 3, 2000), ["p"], "o", 3)))
    s = P.with_event_time(stream(spark, tmp_path, df), "t")
    got = rows(drain(P.run_stateful(s, ["p"], P.Batching(3, 2000)), tmp_path, "batching"))
    assert got and set(got) <= want and len(want) - len(got) <= 2


def test_key_stat(spark, tmp_path, rows):
    df = log(spark).withColumn("t", 10_000 + F.col("o") * 130)
    want = rows(quota.windowed_key_stat(df, "p", "k", "t", "o", W).select("p", "o", "k", "from_ms", "to_ms", "n"))
    s = P.with_event_time(stream(spark, tmp_path, df), "t")
    assert rows(drain(P.run_stateful(s, ["p"], P.KeyStat(W)), tmp_path, "stat")) == want


def test_delay_and_completion(spark, tmp_path, rows):
    df = log(spark).withColumn("scheduled", F.when(F.col("o") % 4 == 0, F.col("t") + 700).otherwise(0))
    s = P.with_event_time(stream(spark, tmp_path, df), "t")
    got = rows(drain(P.run_stateful(s, ["k"], P.Delay()), tmp_path, "delay"))
    last = df.agg(F.max("t")).first()[0]
    want = rows(df.select("k", "o", "t", "scheduled"))
    assert set(got) <= set(want) and {r for r in want if r[3] < last - 200} <= set(got)
    d = tmp_path / "c"
    d.mkdir()
    ev = df.select("p", "o", "t", F.lit("received").alias("kind"), F.lit(-1).cast("bigint").alias("timeout_at"))
    ev = ev.unionByName(ev.filter("o <> 30").withColumn("kind", F.lit("completed")))
    marks = drain(P.run_stateful(P.with_event_time(stream(spark, d, ev), "t"), ["p"], P.Completion()), d, "completion")
    assert rows(marks.groupBy("p").agg(F.max("high_watermark"))) == [(0, 29), (1, 29)]


def test_router_and_listener(spark, tmp_path, rows):
    states = []
    listen = Progress(lambda q, s: states.append(s))
    spark.streams.addListener(listen)
    try:
        df = spark.createDataFrame([("a", bytes([i]), bytes([i])) for i in range(6)], "topic string, key binary, value binary")
        df.selectExpr("topic", "0 partition", "0L offset", "timestamp '2024-01-01' timestamp", "0 timestampType", "key", "value", "array() headers").selectExpr(
            "topic", "partition", "offset", "timestamp", "timestampType", "key", "value", "cast(headers as array<struct<key:string,value:binary>>) headers"
        ).write.parquet(str(tmp_path / "src" / "a"))
        s = read_stream(spark, ["a"], folder=str(tmp_path / "src"))
        out = s.select(F.when(F.col("value") < b"\x03", "a-retry").otherwise("a-shaping").alias("topic"), "key", "value")
        write = folder_writer(str(tmp_path / "out"), ["a-retry", "a-shaping"])
        q = P.routed(out, write, str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination(60)
        back = read_batch(spark, ["a-retry", "a-shaping"], folder=str(tmp_path / "out"))
        assert rows(back.groupBy("topic").count()) == [("a-retry", 3), ("a-shaping", 3)]
        assert rows(back.filter("topic = 'a-retry'").select("offset")) == [(1,), (2,), (3,)]
    finally:
        spark.streams.removeListener(listen)
    with pytest.raises(ValueError):
        read_stream(spark, ["a"])


def test_token_bucket(spark, tmp_path, rows):
    from tasklathe.operators import schedule

    df = log(spark).withColumn("t", 10_000 + F.col("o") * 13)
    want = rows(schedule.token_bucket(df, ["p"], "o", F.col("t"), 20, 0.5).select("p", "o", F.round("wait", 6)))
    s = P.with_event_time(stream(spark, tmp_path, df), "t")
    assert rows(drain(P.run_stateful(s, ["p"], P.TokenBucket(20, 0.5)), tmp_path, "bucket").select("p", "o", F.round("wait", 6))) == want
    assert any(r[2] > 0 for r in want)


def test_subscription_with_retries(spark, tmp_path, rows):
    """Every task is put again once and then done: each id is seen with a retry count of 1."""
    from tasklathe.operators.extract import json_task
    from tasklathe.plans.pipeline import Client, Subscription
    from tasklathe.streaming.subscription import start

    base = str(tmp_path / "topics")
    tasks = spark.range(20).select(F.col("id").cast("string").alias("key"), F.to_json(F.struct("id")).alias("task"))
    sub = (
        Subscription("sub", "work")
        .consuming(json_task("id bigint"))
        .enable_retry(10)
        .then(lambda d: d.withColumn("retry", F.coalesce(F.col("metadata.retry_count"), F.lit(0)) == 0))
    )
    write = folder_writer(base, sub.topics(), n_partitions=2)
    write(Client("work", "app", "host").records(tasks, F.col("key"), F.encode("task", "UTF-8")), 0)
    spark.createDataFrame([], read_batch(spark, ["work"], folder=base).schema).write.parquet(f"{base}/work-retry/b-none")
    seen = []
    again = folder_writer(base, ["work-retry"])
    for _ in range(2):
        q = start(sub, read_stream(spark, sub.topics(), folder=base), str(tmp_path / "ck"), lambda d, b: seen.extend(tuple(r) for r in d.select("task.id", "metadata.retry_count").collect()), again, availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(seen) == sorted([(i, n) for i in range(20) for n in (0, 1)])


def test_supervisor(spark, tmp_path):
    from tasklathe.config import Properties
    from tasklathe.streaming.supervisor import Supervisor

    src = tmp_path / "src"
    spark.range(5).write.parquet(str(src))
    got = []

    def start(props):
        s = spark.readStream.schema("id bigint").parquet(str(src))
        return P.routed(s, lambda df, b: got.append(df.count()), str(tmp_path / "ck"))

    p = Properties()
    sup = Supervisor(start, p)
    try:
        sup.tick()
        sup.query.processAllAvailable()
        p.dynamic("partition.concurrency").set(8)
        sup.tick()
        assert sup.restarts == 1 and sup.query.isActive
        p.dynamic("processing.rate.per.partition").set(0)
        sup.tick()
        assert sup.query is None
        p.dynamic("processing.rate.per.partition").set(5)
        sup.tick()
        spark.range(7).write.mode("append").parquet(str(src))
        sup.query.processAllAvailable()
    finally:
        sup.close()
    assert sum(got) == 12  # nothing twice, nothing lost


class _State:
    """State of one key, kept in the test."""

    def __init__(self):
        self.v, self.m = None, {}

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None

    def containsKey(self, k):
        return k in self.m

    def getValue(self, k):
        return self.m[k]

    def updateValue(self, k, v):
        self.m[k] = v

    def removeKey(self, k):
        del self.m[k]

    def keys(self):
        return list(self.m)


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *a):
        return _State()

    getListState = getMapState = getValueState

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class _At:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _feed(processor, rows, now=0):
    import pandas as pd

    out = pd.concat(list(processor.handleInputRows((0,), iter([pd.DataFrame(rows)]), _At(now))))
    return [tuple(r) for r in out.itertuples(index=False)]


def _event(o, kind, at=-1):
    return {"p": 0, "o": o, "t": 0, "kind": kind, "timeout_at": at}


def test_completion_that_comes_early():
    c = P.Completion()
    c.init(_Handle())
    assert _feed(c, [_event(1, "completed")]) == [(0, -1, 0)]
    assert _feed(c, [_event(0, "received"), _event(0, "completed")]) == [(0, 0, 0)]
    assert _feed(c, [_event(1, "received"), _event(2, "received")]) == [(0, 1, 1)]
    assert _feed(c, [_event(1, "completed"), _event(2, "completed"), _event(5, "completed")]) == [(0, 2, 0)]
    assert _feed(c, [_event(4, "received"), _event(4, "completed"), _event(6, "received"), _event(6, "completed")]) == [(0, 4, 1)]  # 5 isn't passed
    assert _feed(c, [_event(5, "received")]) == [(0, 6, 0)]


def test_timeout_without_new_rows():
    for extend, want in ((None, [(0, 3, 0)]), (50, [(0, 1, 2)])):
        h = _Handle()
        c = P.Completion(extend)
        c.init(h)
        assert _feed(c, [_event(o, "received", 100 if o == 2 else -1) for o in (1, 2, 3)] + [_event(1, "completed"), _event(3, "completed")]) == [(0, 1, 2)]
        assert h.timers == {100}
        got = [tuple(r) for f in c.handleExpiredTimer((0,), _At(100), _At(100)) for r in f.itertuples(index=False)]
        assert got == want and h.timers == (set() if extend is None else {150})


def test_late_row_of_a_closed_tick():
    b = P.Batching(2, 1000)
    b.init(_Handle())
    row = lambda o, t: {"p": 0, "o": o, "t": t}
    assert _feed(b, [row(0, 10), row(1, 20), row(2, 30)]) == [(0, 0, 0, 2, 0, 1, True)]
    got = [tuple(r) for f in b.handleExpiredTimer((0,), _At(1000), _At(1000)) for r in f.itertuples(index=False)]
    assert got == [(0, 0, 1, 1, 2, 2, False)]
    assert _feed(b, [row(3, 40), row(4, 1500), row(5, 50), row(6, 1600)]) == [(0, 0, 2, 1, 3, 3, False), (0, 1, 0, 1, 4, 4, False), (0, 0, 3, 1, 5, 5, False)]
