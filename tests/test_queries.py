"""The catalogue: every query has a stable schema, and SQL that exists matches a query."""

import os

import pytest

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"


def test_names():
    q, s = entry_module.queries(), entry_module.oracle_sql()
    assert set(s) <= set(q)
    assert {"p1_found", "p3_found", "p5_found", "p6_found"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["p", "windows", "tasks", "compacted"] and df.count() > 0


def test_traces_of_all_partitions(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    # two rows a partition, so that every offset comes in all of them; an error is a trace left open
    made = [(i, i % 4, at + dt.timedelta(seconds=i), "error" if i in (1, 2, 7) else "view", 1.0, "{}") for i in range(8)]
    spark.createDataFrame(made, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r[0] for r in entry_module.queries()["trace_propagation"](spark, str(tmp_path)).collect())
    assert got == ["trace-1-0", "trace-2-0", "trace-3-1"]
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view events as from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(r[0] for r in db.execute(entry_module.oracle_sql()["trace_propagation"]).fetchall()) == got
