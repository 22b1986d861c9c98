"""Batches against a direct walk, with keys cut into chunks, ties, gaps and long waits."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventflow.operators import batching as B

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_rows(n, seed, spread_ms):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += timedelta(milliseconds=rng.choice([0, 1, 5, 20, spread_ms]))
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("ab"), i, at))
    return rows


def direct(rows, size, timeout_ms):
    out, state = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        opened, held, no = state.get(key, (None, size, -1))
        late = timeout_ms is not None and opened is not None and at - opened >= timedelta(milliseconds=timeout_ms)
        if held >= size or late:
            opened, held, no = at, 0, no + 1
        out[(key, i)] = (no, held)
        state[key] = (opened, held + 1, no)
    return out


@pytest.mark.parametrize("size,timeout_ms,chunk_rows,spread_ms", [
    (4, 50, 10_000, 300), (4, 50, 30, 300), (10, 1_000, 25, 100), (10, 40, 9, 10), (60, 100_000, 17, 5), (1, 10, 20, 5),
    (3, 1, 11, 3), (500, 10_000_000, 40, 5)])
def test_assign_batches(spark, size, timeout_ms, chunk_rows, spread_ms):
    rows = make_rows(600, size + chunk_rows, spread_ms)
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp").repartition(6)
    got = B.assign_batches(df, ["k"], "ts", ["i"], size, f"{timeout_ms}ms", chunk_rows).collect()
    assert {(r.k, r.i): (r.batch_no, r.pos) for r in got} == direct(rows, size, timeout_ms)


def test_without_timeout(spark):
    rows = make_rows(300, 1, 50)
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp")
    got = B.assign_batches(df, ["k"], "ts", ["i"], 7, None, 40).collect()
    assert {(r.k, r.i): (r.batch_no, r.pos) for r in got} == direct(rows, 7, None)
    assert len({r.batch_id for r in got}) == len({(r.k, r.batch_no) for r in got})


def test_other_columns_pass_through(spark):
    rows = make_rows(50, 2, 50)
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp").withColumn(
        "headers", F.create_map(F.lit("a"), F.col("k"))).withColumn("body", F.col("k").cast("binary"))
    out = B.assign_batches(df, ["k"], "ts", ["i"], 3, "20ms", 10)
    assert out.schema["headers"].dataType == df.schema["headers"].dataType
    assert all(r.headers["a"] == r.k and bytes(r.body).decode() == r.k for r in out.collect())


def test_poll_cycles_flush(spark):
    df = spark.range(20).select(F.col("id").alias("i"), (F.col("id") / 8).cast("int").alias("cycle"),
                                F.timestamp_seconds("id").alias("ts"))
    got = {r.i: (r.cycle, r.batch_no, r.pos) for r in B.assign_poll_batches(df, "cycle", "ts", ["i"], 3).collect()}
    assert got[7] == (0, 2, 1) and got[8] == (1, 0, 0)
    over = {r.i: r.batch_no for r in B.assign_poll_batches(df, "cycle", "ts", ["i"], 3, one_over=True).collect()}
    assert over[3] == 0 and over[4] == 1


def test_size_below_one(spark):
    with pytest.raises(ValueError):
        B.assign_batches(spark.range(1).withColumn("ts", F.current_timestamp()), ["id"], "ts", [], 0)


def test_long_chunks_are_walked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "WALK_ROWS", 7)
    rows = make_rows(400, 9, 30)
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp")
    got = B.assign_batches(df, ["k"], "ts", ["i"], 4, "25ms", 60).collect()
    assert {(r.k, r.i): (r.batch_no, r.pos) for r in got} == direct(rows, 4, 25)


def test_passages_compose():
    """Two runs of rows, one after the other, open batches as one run does; equal outcomes are one entry."""
    rng = random.Random(4)
    for _ in range(200):
        size, timeout = rng.choice([1, 2, 3, 7, 50]), rng.choice([1, 5, 40, 1000])
        times = np.cumsum(rng.choices([0, 1, 3, 30], k=rng.randint(2, 40)))
        cut = rng.randint(1, len(times) - 1)
        both = B.Passage.of_times(times[:cut], size, timeout).then(B.Passage.of_times(times[cut:], size, timeout), size, timeout)
        whole = B.Passage.of_times(times, size, timeout)
        assert len(both.at) <= size
        for _ in range(20):
            opened, held = times[0] - rng.randint(0, 50), rng.randint(1, size)
            state = [np.array([x], np.int64) for x in (opened, held, 5)]
            assert [x.tolist() for x in both.after(*state, size, timeout)] == [x.tolist() for x in whole.after(*state, size, timeout)]
            opened, number = int(opened), 5
            for now in times.tolist():
                if held >= size or now - opened >= timeout:
                    opened, held, number = now, 0, number + 1
                held += 1
            assert [int(x[0]) for x in whole.after(*state, size, timeout)] == [opened, held, number]


@pytest.mark.parametrize("size,spread_ms", [(10_000, 40), (10_000, 1)])
def test_large_batches_over_many_chunks(spark, size, spread_ms):
    """Many chunks of one key and batches larger than a chunk: summaries are combined over several levels."""
    rows = make_rows(24_000, 5, spread_ms)
    df = spark.createDataFrame([("hot", i, at) for _, i, at in rows], "k string, i long, ts timestamp").repartition(6)
    got = B.assign_batches(df, ["k"], "ts", ["i"], size, "90s", 24).collect()
    want = direct([("hot", i, at) for _, i, at in rows], size, 90_000)
    assert {(r.k, r.i): (r.batch_no, r.pos) for r in got} == want
