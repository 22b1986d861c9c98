from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventflow.operators import metrics as M

NOW = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize("chunk_rows", [7, 100_000])
def test_counter_delta(spark, chunk_rows):
    rng = random.Random(1)
    rows, last = [], {}
    for i in range(400):
        key = "hot" if rng.random() < 0.8 else "cold"
        last[key] = last.get(key, 0) + rng.randint(0, 9)
        rows.append((key, NOW + timedelta(seconds=i), last[key]))
    df = spark.createDataFrame(rows, "k string, ts timestamp, c long").repartition(4)
    got = M.counter_delta(df, ["k"], "ts", ["c"], chunk_rows)
    assert {r.k: r.s for r in got.groupBy("k").agg(F.sum("c_delta").alias("s")).collect()} == last
    assert got.filter("c_delta < 0").count() == 0 and got.filter("c_delta = c").count() >= 2


def test_handled_and_worker_counts_differ(spark):
    df = spark.createDataFrame([("w", None, 200, "ok"), ("w", None, 500, "ok"), ("w", "boom", 200, "ok"), ("w", None, 200, "no_response")],
                               "worker string, process_error string, status_code int, outcome string").withColumn("function", F.lit("f"))
    got = {r.result: r.value for r in M.handled_events(df).collect()}
    assert got == {"success": 2, "failure": 1}
    row = M.worker_outcomes(df).first()
    assert (row.success, row.error) == (2, 2)


def test_rollup_levels(spark):
    df = spark.range(60).select(F.lit("ns").alias("namespace"), (F.col("id") % 2).cast("string").alias("project"),
                                (F.col("id") % 6).cast("string").alias("function"), (F.col("id") % 5 == 0).alias("process_error"))
    rows = M.handled_events(df, rollup=True).filter("result = 'success'").collect()
    assert {r.level for r in rows} == {0, 1, 2, 3}
    for level in range(4):
        assert sum(r.value for r in rows if r.level == level) == 48


def test_allocations(spark):
    df = spark.createDataFrame([("t", "immediate", 0.0, 2, 3), ("t", "after_wait", 12.9, 0, 3), ("t", "timeout", 100.0, 0, 3)],
                               "trigger_id string, result string, wait_ms double, available int, total int")
    row = M.allocation_stats(df).first()
    assert (row.allocation_count, row.success_immediate, row.success_after_wait, row.timeout, row.wait_ms_sum) == (3, 1, 1, 1, 12)
    assert row.available_percentage == pytest.approx(66 / 3)


RESOURCES = "array<struct<metric_name:string,window_size:string,threshold:double>>"


def functions(spark, rows):
    return spark.createDataFrame(rows, f"name string, state string, replicas int, min_replicas int, scale_to_zero {RESOURCES}, "
                                       "scale_status struct<last_scale_event:string,last_scale_event_time:timestamp>")


def test_idle(spark):
    spec = [("m", "10m", 1.0), ("q", "1h", 5.0)]
    rows = [("quiet", "ready", 0, 5, spec, None), ("busy", "ready", None, 0, spec, None), ("was-busy", "ready", -3, None, spec, ("e", NOW)),
            ("kept", "ready", 1, 0, spec, None), ("default", "ready", None, None, spec, None), ("off", "error", 0, 0, spec, None),
            ("no-spec", "ready", 0, 0, None, None), ("bad-window", "ready", 0, 0, [("m", "x", 1.0)], None),
            ("bad-status", "ready", 0, 0, spec, ("e", None)), ("slow", "ready", 0, 0, spec, None)]
    candidates = M.idle_candidates(functions(spark, rows))
    assert sorted(r.name for r in candidates.collect()) == ["busy", "quiet", "slow", "was-busy"]

    def sample(name, metric, minutes, value):
        return (name, metric, NOW - timedelta(minutes=minutes), value)

    metrics = spark.createDataFrame([sample("busy", "m", 5, 2.0), sample("was-busy", "m", 11, 9.0), sample("quiet", "m", 5, 1.0),
                                     sample("slow", "q", 59, 6.0), sample("quiet", "q", 61, 6.0), sample("quiet", "m", -1, 9.0)],
                                    "function string, metric_name string, ts timestamp, value double")
    got = {r.name: r.idle for r in M.idle_functions(candidates, metrics, NOW).collect()}
    assert got == {"busy": False, "quiet": True, "slow": False, "was-busy": True}


def test_stuck(spark):
    starts = spark.createDataFrame([(1, NOW - timedelta(minutes=5)), (2, NOW - timedelta(minutes=5)), (3, NOW - timedelta(seconds=60))],
                                   "event_id int, ts timestamp")
    ends = spark.createDataFrame([(2,)], "event_id int")
    assert [r.event_id for r in M.stuck_events(starts, ends, "1m", NOW).collect()] == [1]


def test_exposition(spark):
    df = spark.createDataFrame([("m", {"b": 'q"x', "a": "1\\2"}, 3.0), ("n", {}, 0.5)], "metric string, labels map<string,string>, value double")
    assert [r.line for r in M.to_exposition(df).collect()] == ['m{a="1\\\\2",b="q\\"x"} 3', "n 0.5"]


def test_time_bounds_reach_the_scan(spark, folder):
    spark.range(10).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("f").alias("function"),
                           F.lit("m").alias("metric_name"), F.lit(1.0).alias("value")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    plan = M.stuck_events(rows, rows.limit(0), "1m", NOW)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts," in plan
    candidates = M.idle_candidates(functions(spark, [("a", "ready", 0, 0, [("m", "10m", 1.0)], None)]))
    plan = M.idle_functions(candidates, rows, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts," in plan
