"""Golden vectors and brute force for the log-processing operators."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklathe import config, settings_file
from tasklathe.functions import wire
from tasklathe.functions.hashing import murmur2
from tasklathe.functions.sketch import CountMin, dimensions
from tasklathe.operators import anchored, batching, checks, client, commit, compaction, extract, filters, metrics, partitioner, quota, retry, schedule
from tasklathe.operators.scan import running
from tasklathe.plans.pipeline import Client, Subscription
from tasklathe.sources.log import subscribed

quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


# --- running aggregates and anchored windows -----------------------------------------


@quick
@given(st.integers(0, 10**6), st.integers(1, 30))
def test_running_equals_plain_window(spark, seed, block):
    from pyspark.sql import Window

    r = random.Random(seed)
    df = spark.createDataFrame([(r.choice([None, "a", "b"]), i, r.choice([None, r.randrange(9)])) for i in range(60)], "g string, o bigint, v bigint")
    w = Window.partitionBy("g").orderBy("o")
    for before in (False, True):
        f = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = df.select("o", F.coalesce(F.sum("v").over(f), F.lit(0)), F.max("v").over(f), F.min("v").over(f), F.lag("v").over(w)).collect()
        v = F.col("v")
        got = running(df, ["g"], "o", {"s": ("sum", v), "x": ("max", v), "n": ("min", v), "p": ("prev", v)}, before=before, block=block).select("o", "s", "x", "n", "p").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def plain_windows(ts, width):
    out, w0 = [], None
    for t in ts:
        w0 = t if w0 is None or t >= w0 + width else w0
        out.append(w0)
    return out


@given(st.lists(st.integers(0, 300), min_size=1, max_size=80), st.integers(1, 60), st.lists(st.integers(0, 80), max_size=4))
@settings(deadline=None)
def test_step_functions_chain(ts, width, cuts):
    t = np.array(sorted(ts), np.int64)
    cuts = sorted({min(c, len(t)) for c in cuts} - {0, len(t)})
    at, got = anchored.FREE, []
    for part in np.split(t, cuts):
        got += anchored.window_starts(part, width, at).tolist()
        ends, outs = anchored.step_function(part, width)
        j = int(np.searchsorted(ends, at, "left"))
        at = int(outs[j]) if j < len(ends) else at
    assert got == plain_windows(t.tolist(), width)


@quick
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_anchored_windows(spark, seed, width):
    r = random.Random(seed)
    data = [(r.choice(["hot", "hot", "hot", None, "b"]), r.randrange(2000), i, 1) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, o bigint, _x int").repartition(5)
    got = {(x["k"], x["o"]): x["w0"] for x in anchored.anchored_windows(df, ["k"], F.col("t"), ["o"], width).collect()}
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        assert [got[k, d[2]] for d in own] == plain_windows([d[1] for d in own], width)
    assert anchored.anchored_windows(df.limit(0), ["k"], F.col("t"), ["o"], 5).count() == 0
    with pytest.raises(ValueError):
        anchored.anchored_windows(df, ["k"], F.col("t"), ["o"], 0)


# --- compaction and batching -------------------------------------------------------------


def test_compaction_golden(spark, rows):
    df = spark.createDataFrame([("yuto", 0, 0, 10), ("yuto", 10, 1, 90), ("wonpill", 20, 2, 400), ("yuto", 30, 3, 20), ("yuto", 1000, 4, 1)], "k string, t bigint, o bigint, age int")
    assert rows(compaction.compact(df, "k", "t", "o", 1000, "max", F.col("age")).select("k", "o")) == [("wonpill", 2), ("yuto", 1), ("yuto", 4)]
    larger = lambda a, b: "left" if a["age"] > b["age"] else "either"
    assert rows(compaction.compact_with(df, "k", "t", "o", 1000, larger).select("k", "age")) == [("wonpill", 400), ("yuto", 1), ("yuto", 90)]
    # a later task doesn't extend the window: 0 and 500 share one, 1000 opens the next
    two = spark.createDataFrame([("a", 0, 0), ("a", 500, 1), ("a", 1000, 2), (None, 1, 3), (None, 2, 4)], "k string, t bigint, o bigint")
    assert rows(compaction.compact(two, "k", "t", "o", 1000).select("k", "n", "o")) == sorted([("a", 2, 1), ("a", 1, 2), (None, 2, 4)], key=repr)


def test_batching_golden(spark, rows):
    df = spark.createDataFrame([(0, i, i) for i in range(3)], "p int, t bigint, o bigint")
    assert rows(batching.flushed(batching.batches(df, ["p"], "t", "o", 2), ["p"], "o", 2).select("size", "full")) == [(1, False), (2, True)]
    for c, w in ((0, 1), (1, 0), (-1, None)):
        with pytest.raises(ValueError):
            batching.batches(df, ["p"], "t", "o", c, w)
    caps = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, -1), (0, 3, None), (0, 4, 7)], "p int, o bigint, v bigint")
    assert [r[1] for r in rows(batching.last_known_good(caps, ["p"], "o", "v").select("o", "effective"))] == [2, 2, 2, 2, 7]


# --- schedules -------------------------------------------------------------------------------


def waits(spark, now, **kw):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(now)], "p int, o bigint, t bigint")
    return [r["wait"] for r in schedule.token_bucket(df, ["p"], "o", F.col("t"), created=F.lit(0), **kw).orderBy("o").collect()]


def test_token_bucket_golden(spark):
    assert waits(spark, [0, 9, 140, 150, 500], rate=10) == pytest.approx([0, 91, 60, 150, 0])
    hour = 3_600_000
    after = waits(spark, [0, *(hour + 10 * i for i in range(1, 11)), hour + 100, hour + 100], rate=10)
    assert after[:12] == [0] * 12 and after[12] > 0
    slow = waits(spark, [0, hour, hour], rate=10, burst_seconds=0)
    assert slow[:2] == [0, 0] and slow[2] > 0
    for rate in (-1, 2_000_000):
        assert waits(spark, [0, 0, 0], rate=rate) == [0, 0, 0]
    assert waits(spark, [0, 0], rate=0) == []
    with pytest.raises(Exception, match="permits"):
        waits(spark, [0], rate=1, permits=F.lit(0))


def test_bucket_is_the_recurrence(spark):
    r = random.Random(5)
    now = np.cumsum([r.randrange(0, 60) for _ in range(200)]).tolist()
    each, burst, free, stored, at = 25.0, 1000.0, 0.0, 0.0, []
    for t in now:
        if t > free:
            stored = min(burst / each, stored + (t - free) / each)
            free = t
        at.append(max(0.0, free - t))
        used = min(1.0, stored)
        stored -= used
        free += (1 - used) * each
    assert waits(spark, now, rate=40) == pytest.approx(at, abs=1e-6)


def test_fifo_waits_behind_a_delayed_task(spark):
    df = spark.createDataFrame([(0, 0, 100, 5), (0, 1, 10, 5), (0, 2, 300, 1)], "p int, o bigint, ready bigint, d bigint")
    got = schedule.fifo_service(df, ["p"], "o", F.col("ready"), F.col("d")).orderBy("o").collect()
    assert [(r["start"], r["finish"]) for r in got] == [(100, 105), (105, 110), (300, 301)]


# --- quotas -------------------------------------------------------------------------------------


def stat(spark, arrivals):
    df = spark.createDataFrame([(0, i, k, t) for i, (t, k) in enumerate(arrivals)], "p int, o bigint, k string, t bigint")
    return [(r["from_ms"], r["to_ms"], r["n"]) for r in quota.windowed_key_stat(df, "p", "k", "t", "o", 100).orderBy("o").collect()]


def test_windowed_key_stat_golden(spark):
    assert stat(spark, [(0, "a"), (99, "a"), (100, "a"), (101, "b"), (200, "b")]) == [(0, 0, 1), (0, 99, 2), (0, 100, 3), (0, 101, 1), (100, 200, 2)]
    got = stat(spark, [(0, "a"), (99, "a"), (100, "a"), (301, "a"), (400, "a"), (402, "b")])
    assert got[3] == (301, 301, 1) and got[5] == (301, 402, 1)


def test_quota_golden(spark):
    def decide(n, seconds, rate=42, key="k"):
        u = quota.quota_decision(F.lit(key), rate, 10_000, F.lit(0), F.lit(seconds * 1000), F.lit(n))
        r = spark.range(1).select(u.alias("u")).first()["u"]
        return r["type"], r["rate"]

    assert decide(615, 15) == ("COMPLY", None)
    assert decide(645, 15) == ("VIOLATE", 43.0)
    assert decide(387, 9)[0] == "COMPLY"
    assert decide(645, 15, key=None)[0] == decide(645, 15, rate=-1)[0] == "COMPLY"
    assert quota.QuotaConfig().target("t") == "t-shaping"


def test_sketch_bound():
    assert dimensions() == (12, 65536)
    r = np.random.default_rng(0)
    for seed in (0, 42):
        r = np.random.default_rng(seed)
        keys = np.where(r.random(20_000) < 0.5, r.integers(0, 100, 20_000), r.integers(1000, 9000, 20_000)) * 0x9E3779B97F4A7
        s = CountMin(0.001, 0.001)
        s.add(keys)
        true = Counter(keys.tolist())
        u = np.array(list(true))
        err = s.estimate(u) - np.array([true[x] for x in u.tolist()])
        assert err.min() >= 0 and err.max() <= 0.001 * len(keys)


# --- completion ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("seen", "done", "hw", "pending"),
    [([1, 2, 3], [1], 1, 2), ([1, 2, 3, 4], [3], -1, 4), ([1, 2, 3, 4], [3, 2], -1, 4), ([1, 2, 3, 4], [3, 2, 1], 3, 1), ([1, 3], [1, 3], 3, 0), ([1, 1001], [1, 1001], 1001, 0)],
)
def test_watermark_golden(spark, seen, done, hw, pending):
    df = spark.createDataFrame([(0, o, o in done) for o in seen], "p int, o bigint, c boolean")
    r = commit.watermarks(df, ["p"], "o", F.col("c")).first()
    assert (r["high_watermark"], r["pending"]) == (hw, pending)


def test_timeout_and_regression(spark, rows):
    df = spark.createDataFrame([(0, 1, False, 20), (0, 2, True, -1)], "p int, o bigint, c boolean, at bigint")
    give_up = commit.after_timeout(F.col("c"), F.col("at"), F.lit(20))
    assert commit.watermarks(df, ["p"], "o", give_up).first()["high_watermark"] == 2
    assert commit.watermarks(df, ["p"], "o", commit.after_timeout(F.col("c"), F.col("at"), F.lit(20), "extend")).first()["high_watermark"] == -1
    r = commit.regressions(spark.createDataFrame([(0, i, o) for i, o in enumerate([1, 2, 2, 1, 5])], "p int, i bigint, o bigint"), ["p"], "i", F.col("o"))
    assert [x[1] for x in rows(r.select("i", "regression"))] == [False, False, False, True, False]


# --- extraction, client, retries ---------------------------------------------------------------------


@given(st.fixed_dictionaries({"timestamp_millis": st.integers(-(2**63), 2**63 - 1), "source_application_id": st.text(), "source_instance_id": st.text(), "retry_count": st.integers(0, 2**40), "scheduled_time_millis": st.integers(0, 2**62)}), st.binary())
def test_wire_round_trip(m, task):
    try:
        m["source_application_id"].encode(), m["source_instance_id"].encode()
    except UnicodeEncodeError:
        return
    assert wire.metadata_of(wire.metadata_bytes(m)) == m
    assert wire.envelope_of(wire.envelope_bytes(m, task)) == (m, task)


@given(st.binary(max_size=40))
def test_wire_never_crashes(b):
    try:
        wire.envelope_of(b)
    except (ValueError, UnicodeDecodeError):
        pass


def test_wire_known_bytes():
    # field 1 as varint 150: the encoding guide's example
    assert wire.metadata_bytes({"timestamp_millis": 150}) == bytes([0x08, 0x96, 0x01])
    assert wire.metadata_of(b"")["source_application_id"] == ""


# Published test values of the producers' hash.
MURMUR = {b"21": -973932308, b"foobar": -790332482, b"a-little-bit-long-string": -985981536, b"a-little-bit-longer-string": -1486304829, b"abc": 479470107}


def test_murmur2():
    assert murmur2(list(MURMUR)).tolist() == list(MURMUR.values())
    assert len(murmur2([b""])) == 1


def test_lane_balance(spark):
    keys = spark.range(10_000).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("k"))
    for parts, lanes in ((1, 10), (8, 17)):
        df = keys.select(partitioner.log_partition(F.col("k"), parts).alias("p"), partitioner.lane_of(F.col("k"), lanes).alias("lane"))
        assert partitioner.balance(df, "p", "lane").agg(F.max("deviation")).first()[0] < 0.05
    with pytest.raises(Exception, match="lane"):
        partitioner.custom_lanes(keys, F.lit(9), 3).collect()


def test_ascii_keys(spark):
    df = spark.createDataFrame([("ok ~",), ("",), (None,)], "k string")
    got = [r[0] if r[0] is None else bytes(r[0]) for r in df.select(client.ascii_key(F.col("k"))).collect()]
    assert got == [b"ok ~", b"", None]
    with pytest.raises(Exception, match="illegal character"):
        spark.createDataFrame([("é",)], "k string").select(client.ascii_key(F.col("k"))).collect()
    assert client.producer_options({"acks": "1"})["acks"] == "1"


def test_key_filters(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert filters.ignore_keys(df, "k", []) is df
    want = sorted([("b",), (None,)], key=repr)
    assert rows(filters.ignore_keys(df, "k", ["a"])) == want
    assert rows(filters.ignore_keys_of(df, "k", spark.createDataFrame([("a",), (None,)], "x string"))) == want


def test_retry_metadata_and_legacy(spark):
    m = {"timestamp_millis": 5, "source_application_id": "a", "source_instance_id": "i", "retry_count": 1, "scheduled_time_millis": 0}
    df = spark.createDataFrame([("t", b"k", b"v", [("x", b"1"), ("dt_meta", b"old")])], f"topic string, key binary, task_bytes binary, headers {extract.HEADERS_TYPE}")
    df = df.withColumn("metadata", F.struct(*(F.lit(v).alias(k) for k, v in m.items())).cast(wire.METADATA_TYPE))
    new = retry.retry_records(df, F.lit(100), 10).first()
    assert new["topic"] == "t-retry" and [h["key"] for h in new["headers"]] == ["x", "dt_meta"]
    assert wire.metadata_of(bytes(new["headers"][1]["value"])) == m | {"retry_count": 2, "scheduled_time_millis": 110}
    old = retry.retry_records(df, F.lit(100), 10, legacy=True).first()
    assert [h["key"] for h in old["headers"]] == ["x"] and wire.envelope_of(bytes(old["value"])) == (m | {"retry_count": 2, "scheduled_time_millis": 110}, b"v")


# --- running processors ----------------------------------------------------------------------------


def test_process(spark):
    from concurrent.futures import Future, ThreadPoolExecutor

    from tasklathe.operators import runtime

    class Double:
        def __init__(self):
            self.pool = ThreadPoolExecutor(2)
            self.last = {}

        def process(self, row):
            k, o = row["k"], row["o"]
            assert self.last.get(k, -1) < o or k is None  # in order per key
            self.last[k] = o
            if o == 3:
                raise ValueError("bad")
            if o == 4:
                return None
            if o == 5:
                return [{"k": k, "n": 1}, {"k": k, "n": 2}]
            if o == 6:
                return self.pool.submit(lambda: {"k": k, "n": 60})
            if o == 7:
                return Future()  # never done
            return {"k": k, "n": o * 2}

        def close(self):
            self.pool.shutdown()

    df = spark.createDataFrame([(k, o) for o in range(8) for k in ("a", "b")] + [(None, 1), (None, 0)], "k string, o bigint")
    got = Counter((r["k"], r["n"], r["completion"]) for r in runtime.process(df, Double, "k string, n bigint", "k", ["o"], lanes=3, threads=4, timeout_ms=50).collect())
    each = {(k, n, "sync"): 1 for k in "ab" for n in (0, 4, 1)} | {(k, 2, "sync"): 2 for k in "ab"} | {(k, 60, "deferred"): 1 for k in "ab"}
    assert got == Counter(each | {(None, None, "failed"): 2, (None, None, "timed_out"): 2, (None, 2, "sync"): 1, (None, 0, "sync"): 1})


def test_per_worker_and_trace(spark, rows):
    from tasklathe.operators import runtime

    class Count:
        def __init__(self):
            self.n = 0

        def process(self, row):
            self.n += 1
            return {"n": self.n}

        def close(self):
            raise AssertionError("kept")

    df = spark.createDataFrame([("a", i) for i in range(5)], "k string, o bigint")
    make = runtime.per_worker("count", Count)
    assert rows(runtime.process(df, make, "n bigint", "k", ["o"], lanes=1).select("n")) == [(i,) for i in range(1, 6)]
    h = spark.createDataFrame([([("trace", b"t1")],), ([],), (None,)], f"headers {extract.HEADERS_TYPE}")
    assert [r["spans"] for r in extract.with_trace(h, "trace", ["A", "B"]).collect()] == [["t1", "t1-A", "t1-B"], None, None]


# --- checks and metrics -----------------------------------------------------------------------------


@pytest.mark.parametrize(("seq", "ok"), [([1, 2, 3, 4, 5], True), ([1, 2, 1, 2, 3, 4, 5], True), ([1, 2, 3, 4, 5, 5], True), ([1, 3, 2, 4, 5], False), ([1, 2, 3, 4, 5, 4, 3], False)])
def test_ordering_golden(spark, seq, ok):
    assert checks.ordered_offsets(seq) is ok
    df = spark.createDataFrame([("k", i, o) for i, o in enumerate(seq)], "k string, s bigint, o bigint")
    assert (checks.order_problems(df, "k", "s", "o", block=2).count() == 0) is ok


def test_overlaps(spark):
    df = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("k", 20, 30), ("j", 0, None), (None, 0, 9), (None, 1, 2)], "k string, s bigint, e bigint")
    assert [tuple(r) for r in checks.overlaps(df, "k", "s", "e", block=4).collect()] == [("k", 5, 20, 10)]


def test_error_accounting(spark):
    df = spark.createDataFrame([("ok", None), ("fail", "x"), ("ok", None), ("async-fail", None)], "k string, error string")
    r = metrics.counters(df, [], discarded=F.lit(False), error=F.col("error").isNotNull(), timeout=F.lit(None).cast("boolean")).first()
    assert (r["processed"], r["errors"], r["timeouts"]) == (4, 1, 0)


# --- settings ------------------------------------------------------------------------------------------


def test_properties():
    p = config.Properties({"partition.concurrency": 4}, {"partition.concurrency": 8, "max.pending.records": 5})
    assert (p["partition.concurrency"], p["max.pending.records"], p["commit.interval.ms"], p.reload_requested) == (4, 5, 1000, False)
    seen = []
    d = p.dynamic("partition.concurrency")
    d.listen(lambda old, new: seen.append((old, new)))
    assert d.set(4) is None and d.set(6) == 4 and seen == [(None, 4), (4, 6)] and p.reload_requested
    for bad in (0, "3", True, 2**31):
        with pytest.raises(ValueError):
            d.set(bad)
    assert d.value == 6
    with pytest.raises(KeyError):
        config.Properties({"no.such": 1})
    with pytest.raises(ValueError):
        config.static_supplier([("a", 1), ("a", 2)])
    assert len(config.DEFINITIONS) == 14
    for draft in config.DRAFTS:
        s = config.json_schema(draft, additional=True)
        assert s["additionalProperties"] and s["properties"]["processing.rate.per.partition"]["maximum"] == 1_000_000


@pytest.mark.parametrize("name", ["s.json", "s.yaml"])
def test_settings_file(tmp_path, name):
    path = str(tmp_path / name)
    f = settings_file.SettingsFile.register(path, prefix="app.")
    assert config.Properties(f.supplier())["max.pending.records"] == 10_000

    def write(**kw):
        values = {"app." + k.replace("_", "."): v for k, v in kw.items()}
        (tmp_path / name).write_text(settings_file.dump(values, path) + ("\n" if len(kw) % 2 else ""))

    write(max_pending_records=7, ignore_keys=["a", "b"], other=1)
    assert f.poll() and f.properties["max.pending.records"].value == 7 and f.properties["ignore.keys"].value == ["a", "b"]
    write(max_pending_records=-7)
    assert not f.poll() and f.properties["max.pending.records"].value == 7
    write(max_pending_records=None, x=2)
    f.poll()
    assert f.properties["max.pending.records"].value == 10_000
    (tmp_path / name).write_text("{ broken" if name.endswith("json") else "a:\n  b: 1\n")
    assert not f.poll()


# --- the whole pipeline ------------------------------------------------------------------------------------


def test_subscription(spark, rows):
    c = Client("events", "app", "host")
    tasks = spark.createDataFrame([(str(i), json.dumps({"k": i}) if i != 3 else "{bad") for i in range(6)], "key string, task string")
    recs = c.records(tasks, F.col("key"), F.encode("task", "UTF-8"), now_ms=1000)
    recs = recs.withColumns({"partition": F.lit(0), "offset": F.col("key").cast("string").cast("bigint"), "timestamp": F.lit(1000).cast("bigint")})
    sub = (
        Subscription("sub", "events")
        .consuming(extract.json_task("k int"))
        .ignore_keys(["5"])
        .enable_retry(50)
        .enable_quota(quota.QuotaConfig(10))
        .then(lambda d: d.filter("task.k <> 1"))
        .then(lambda d: d.withColumns({"retry": F.col("task.k") == 2, "error": F.when(F.col("task.k") == 4, "boom")}))
    )
    assert sub.topics() == ["events", "events-retry", "events-shaping"] == subscribed("events", True, ["events-shaping"])
    r = sub.run(recs, now=F.lit(2000))
    assert rows(r.processed.select("task.k")) == [(0,), (2,), (4,)]
    assert rows(r.discarded.select("offset")) == [(3,)] and rows(r.failed.select("task.k")) == [(4,)]
    again = r.retries.first()
    assert again["topic"] == "events-retry" and again["metadata"]["retry_count"] == 1 and again["metadata"]["scheduled_time_millis"] == 2050
    back = r.retries.select("topic", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("timestamp"), "key", "value", "headers")
    once_more = sub.run(back, now=F.lit(3000)).retries.first()
    assert once_more["metadata"]["retry_count"] == 2
    # metadata of the origin topic's headers is kept, unless the extractor reads raw values
    stamp = lambda s: s.run(recs).processed.select("metadata.source_application_id").distinct().collect()[0][0]
    assert stamp(Subscription("s", "events").consuming(extract.json_task("k int")).enable_retry(5)) == "app"
    assert stamp(Subscription("s", "events").consuming(extract.json_task("k int"), raw=True).enable_retry(5)) == ""
    with pytest.raises(ValueError, match="enabled"):
        Subscription("s", "events").consuming(extract.json_task("k int")).then(lambda d: d.withColumn("retry", F.lit(True))).run(recs)


def test_subscription_shapes_bursts(spark):
    from tasklathe.streaming.subscription import start

    rnd = random.Random(3)
    recs, at = [], {0: 0, 1: 0}
    for o in range(300):
        for p in at:
            at[p] += rnd.randrange(60)
            topic = "events-retry" if o % 11 == 0 else "events"
            key = rnd.choice([b"hot", b"hot", b"hot", b"cold", b"rare%d" % rnd.randrange(9), None])
            recs.append((topic, p, o, at[p] - (5 if o % 7 == 0 else 0), key, json.dumps({"k": 1000 * p + o}).encode()))
    # record by record, as a partition's consumer counts them
    want, state = set(), {}
    for topic, p, o, t, key, _ in sorted(recs, key=lambda r: (r[1], r[2])):
        if topic != "events" or key is None:
            continue
        s = state.setdefault(p, {"at": t, "w": t, "prev": None, "n": {}, "before": {}})
        s["at"] = now = max(s["at"], t)
        if now - s["w"] >= 1000:
            s.update(prev=s["w"], w=now, before=s["n"], n={})
        s["n"][key] = s["n"].get(key, 0) + 1
        near = s["prev"] is not None and s["prev"] >= now - 2000
        n, seen = s["n"][key] + (s["before"].get(key, 0) if near else 0), now - (s["prev"] if near else s["w"])
        if seen >= 1000 and n / seen * 1000 >= 10:
            want.add(1000 * p + o)
    df = spark.createDataFrame(recs, "topic string, partition int, offset bigint, timestamp bigint, key binary, value binary").withColumn("headers", F.expr("cast(array() as array<struct<key: string, value: binary>>)"))
    sub = lambda c: Subscription("sub", "events").consuming(extract.json_task("k int")).enable_quota(c)
    r = sub(quota.QuotaConfig(10, 1000)).run(df)
    there = [(x["topic"], json.loads(x["value"])["k"]) for x in r.shaped.collect()]
    assert {t for t, _ in there} == {"events-shaping"} and sorted(k for _, k in there) == sorted(want) and 20 < len(want) < 400
    assert sorted(x[0] for x in r.processed.select("task.k").collect()) == sorted({1000 * p + o for _, p, o, *_ in recs} - want)
    free = sub(quota.QuotaConfig(-1, 1000)).run(df)
    assert free.shaped is None and free.processed.count() == len(recs)
    with pytest.raises(ValueError, match="whole log"):
        start(sub(quota.QuotaConfig(10)), df, "unused", lambda d, i: None)


def test_scopes_of_processors(spark, rows):
    from tasklathe.operators import runtime

    class Counting:
        made = 0

        def __init__(self):
            type(self).made += 1
            self.no, self.n = type(self).made, 0

        def process(self, row):
            self.n += 1
            return {"p": row["p"], "no": self.no, "n": self.n}

        def close(self):
            pass

    df = spark.range(60).selectExpr("cast(id % 3 as int) p", "cast(id % 5 as string) k", "id o")
    got = runtime.process(df, runtime.per_partition("p", Counting), "p int, no int, n int", "k", ["o"], lanes=1).collect()
    assert len({(r["p"], r["no"]) for r in got}) == len({r["no"] for r in got}) == 3 and max(r["n"] for r in got) == 20
    got = runtime.process(df, runtime.per_thread(Counting), "p int, no int, n int", "k", ["o"], lanes=1, threads=1).collect()
    assert {r["no"] for r in got} == {1} and max(r["n"] for r in got) == 60


def test_states_of_a_subscription():
    from tasklathe.config import Properties
    from tasklathe.streaming.listener import RUNNING, States
    from tasklathe.streaming.supervisor import Supervisor

    class Query:
        isActive = True

        def processAllAvailable(self):
            pass

        def stop(self):
            pass

    told = []
    p = Properties({"partition.concurrency": 2})
    s = Supervisor(lambda properties: Query(), p, on_state=told.append)
    s.tick()
    p.dynamic("partition.concurrency").set(4)
    s.tick()
    s.tick()
    s.close()
    assert told == ["INITIALIZING", "RUNNING", "REBALANCING", "RUNNING", "SHUTTING_DOWN", "TERMINATED"] and s.restarts == 1
    assert not s.states.to(RUNNING) and not States().to(RUNNING)


def test_client_metrics_are_bound_on_demand():
    from types import SimpleNamespace

    from tasklathe.config import Properties
    from tasklathe.streaming.listener import Progress

    source = SimpleNamespace(description="log", metrics={"lag": "7"}, numInputRows=3, processedRowsPerSecond=1.5)
    event = SimpleNamespace(progress=SimpleNamespace(id="q", durationMs={"addBatch": 40, "walCommit": 5}, numInputRows=3, sources=[source]))
    times = iter([10.0, 10.5])
    on = Progress(properties=Properties({"client.metrics.micrometer.bound": True}), clock=lambda: next(times))
    on.onQueryProgress(event)
    on.onQueryProgress(event)
    assert on.client["q", "log", "lag"] == "7" and on.client["q", "log", "numInputRows"] == "3"
    assert on.durations["q"]["records"] == 80 and on.durations["q"]["commit"] == 10 and on.durations["q"]["pause"] == 455
    off = Progress(properties=Properties())
    off.onQueryProgress(event)
    assert not off.client


def test_cadence_and_capacity_are_brute_force(spark, rows):
    import random

    from tasklathe.operators import commit

    r = random.Random(3)
    data = [(p, o, o * 10, None if r.random() < 0.03 else o * 10 + r.randrange(200)) for p in (0, None) for o in range(150)]
    df = spark.createDataFrame(data, "p int, o bigint, at bigint, done bigint")
    marks = {}
    for p in (0, None):
        own = [d for d in data if d[0] == p]
        for tick in range(50, 3000, 50):
            n = 0
            for d in own:
                if d[3] is None or d[3] >= tick:
                    break
                n = d[1] + 1
            if n and n != marks.get((p, tick - 50), (0,))[0]:
                marks[p, tick] = (n, True)
            else:
                marks[p, tick] = (n, False)
    got = {(x["p"], x["tick"]): x["commit"] for x in commit.cadence(df, ["p"], "o", F.col("done"), 50).collect()}
    assert got == {k: n for k, (n, moved) in marks.items() if moved}
    held = {}
    for p in (0, None):
        own = [d for d in data if d[0] == p]
        for i, d in enumerate(own):
            head = 0
            while head < i and own[head][3] is not None and own[head][3] <= d[2]:
                head += 1
            held[p, d[1]] = i + 1 - head
    got = {(x["p"], x["o"]): (x["pending"], x["over"]) for x in commit.over_capacity(df, ["p"], "o", F.col("at"), F.col("done"), 10, 2).collect()}
    assert got == {k: (n, n > 12) for k, n in held.items()}


def _mangled(r, m, task):
    """An envelope or a metadata message, often cut off, altered or with other fields in it."""
    b = wire.envelope_bytes(m, task) if r.random() < 0.5 else wire.metadata_bytes(m)
    kind = r.randrange(6)
    if kind == 0 and b:
        return b[: r.randrange(len(b))]
    if kind == 1 and b:
        i = r.randrange(len(b))
        return b[:i] + bytes([r.randrange(256)]) + b[i + 1 :]
    if kind == 2:
        return b + r.choice([b"\x38\x05", b"\x41" + b"x" * 8, b"\x45abcd", b"\x3a\x02hi", b"\x3b", b"\x08\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01", b"\x12\x01\xff", b"\x08" + b"\xff" * 11])
    if kind == 3:
        return bytes(r.randrange(256) for _ in range(r.randrange(12)))
    return b


def test_messages_in_columns_are_read_as_single_ones(spark):
    from pyspark.sql import functions as F

    r = random.Random(12)
    number = lambda: r.choice([0, 1, 127, 128, 300, 2**31, 2**62, -1, -(2**63), 1_740_986_529_912])
    text = lambda: r.choice(["", "app", "ü€😀", "x" * 300])
    rows = []
    for i in range(1500):
        m = {"timestamp_millis": number(), "source_application_id": text(), "source_instance_id": text(), "retry_count": number(), "scheduled_time_millis": number()}
        task = bytes(r.randrange(256) for _ in range(r.randrange(200)))
        rows.append((i, m, task, None if i % 50 == 0 else _mangled(r, m, task)))
    df = spark.createDataFrame(rows, f"i int, m {wire.METADATA_TYPE}, task binary, b binary").repartition(3)
    got = df.select("*", wire.encode_metadata(F.col("m")).alias("em"), wire.encode_envelope(F.col("m"), F.col("task")).alias("ee"), wire.decode_metadata(F.col("b")).alias("dm"), wire.decode_envelope(F.col("b")).alias("de")).collect()
    n = 0
    for x in got:
        m = x["m"].asDict()
        assert bytes(x["em"]) == wire.metadata_bytes(m) and bytes(x["ee"]) == wire.envelope_bytes(m, bytes(x["task"]))
        b = None if x["b"] is None else bytes(x["b"])
        try:
            want = None if b is None else wire.metadata_of(b)
        except ValueError:
            want = None
        assert (None if x["dm"] is None else x["dm"].asDict()) == want, b
        try:
            want = None if b is None else wire.envelope_of(b)
        except ValueError:
            want = None
        assert (None if x["de"] is None else (wire.metadata_of(bytes(x["de"]["metadata"])), bytes(x["de"]["task"]))) == want, b
        n += x["dm"] is not None
    assert 300 < n < 1400
    nulls = spark.range(1).select(wire.encode_metadata(F.lit(None).cast(wire.METADATA_TYPE)).alias("a"), wire.encode_envelope(F.lit(None).cast(wire.METADATA_TYPE), F.lit(None).cast("binary")).alias("b"), wire.decode_metadata(F.lit(None).cast("binary")).alias("c")).first()
    assert nulls["a"] is None and bytes(nulls["b"]) == b"\n\x00" and nulls["c"] is None


def test_compaction_in_stretches(spark, rows):
    from tasklathe.operators import compaction

    r = random.Random(5)
    data = [("hot" if r.random() < 0.7 else r.choice(["a", None]), r.randrange(20_000), i, r.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t bigint, o bigint, v int").repartition(6)
    larger = lambda a, b: "left" if a["v"] > b["v"] else "either"
    assert rows(compaction.compact_with(df, "k", "t", "o", 9000, larger, associative=True)) == rows(compaction.compact_with(df, "k", "t", "o", 9000, larger))


def test_subscription_runs_a_processor_with_timeout_and_pace(spark):
    from concurrent.futures import Future

    from tasklathe.streaming.subscription import pace

    class Slow:
        def process(self, row):
            return Future() if row["k"] == 3 else {"k": row["k"], "at": row["offset"]}

        def close(self):
            pass

    recs = spark.range(8).selectExpr("'events' topic", "0 partition", "id offset", "id * 10 timestamp", "cast(id % 2 as string) key", "cast(concat('{\"k\": ', id, '}') as binary) value", "cast(array() as array<struct<key:string,value:binary>>) headers").withColumn("key", F.encode("key", "UTF-8"))
    sub = Subscription("s", "events").overriding(**{"deferred.complete.timeout.ms": 20, "processing.rate.per.partition": 2}).consuming(extract.json_task("k int")).processing(Slow, "k int, at bigint")
    got = sub.run(recs).processed.collect()
    assert sorted(r["k"] for r in got if r["completion"] == "sync") == [0, 1, 2, 4, 5, 6, 7] and [r["completion"] for r in got if r["k"] is None] == ["timed_out"]
    assert Subscription("s", "events").overriding(**{"processing.rate.per.partition": 0}).consuming(extract.json_task("k int")).run(recs).processed.count() == 0
    slept = []
    pace(recs, 2, 1.5, slept.append)
    pace(recs, -1, 0, slept.append)
    assert slept == [2.5]


def test_sketch_of_arrivals_is_one_by_one():
    rng = np.random.default_rng(2)
    for eps in (0.3, 0.02, 0.0005):  # from all hashes sharing counters to hardly any
        s = CountMin(eps, 0.01)
        cells, rows = np.zeros_like(s.cells), np.arange(s.depth)
        hashes = rng.zipf(1.3, 9000).astype(np.int64) * 0x9E3779B97F4A7C1 % 2**62
        counts = rng.integers(1, 5, 9000)
        want = []
        at = s._at(hashes)
        for i, n in enumerate(counts):
            c = cells[rows, at[:, i]]
            want.append(c.min() + n)
            cells[rows, at[:, i]] = np.maximum(c, want[-1])
        assert (s.add(hashes, counts) == np.array(want)).all() and (s.cells == cells).all()
