"""Order-dependent columns: cut into many chunks, they equal the plain walk over each key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from eventflow.operators.ordered import CHUNK, ordered
from eventflow.operators.prefix import Walk, scan_rows


def skewed_rows(n=900, seed=3):
    """One key holds two thirds of the rows; some values are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        rows.append((key, i, rng.choice([None, "x", "y"]), rng.randint(-5, 5)))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.fixture(params=[7, 50, 10_000])
def scan(request, spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, seq long, v string, n long").repartition(5)
    return rows, ordered(df, ["k"], ["seq"], request.param)


def test_hot_key_is_cut(spark):
    df = spark.createDataFrame(skewed_rows(), "k string, seq long, v string, n long")
    scan = ordered(df, ["k"], ["seq"], 50)
    sizes = scan.rows.groupBy(CHUNK).count().collect()
    assert scan.chunks > 10
    assert max(r["count"] for r in sizes) < 200
    assert scan.rows.filter("k = 'hot'").select(CHUNK).distinct().count() > 5
    carried = scan.crossing.groupBy(CHUNK, "k").count().count()
    assert carried <= 2 * scan.chunks


def test_row_number(scan):
    rows, s = scan
    got = {(r.k, r.seq): r.rn for r in s.row_number("rn").result().collect()}
    want = {(k, r[1]): i + 1 for k, group in by_key(rows).items() for i, r in enumerate(group)}
    assert got == want


def test_lag(scan):
    rows, s = scan
    got = {(r.k, r.seq): (r.pv, r.pn) for r in s.lag({"pv": "v", "pn": "n"}).result().collect()}
    want = {}
    for k, group in by_key(rows).items():
        for i, r in enumerate(group):
            want[(k, r[1])] = (group[i - 1][2], group[i - 1][3]) if i else (None, None)
    assert got == want


def test_last_value(scan):
    rows, s = scan
    got = {(r.k, r.seq): r.lv for r in s.last_value("v", "lv").result().collect()}
    want = {}
    for k, group in by_key(rows).items():
        last = None
        for r in group:
            last = r[2] if r[2] is not None else last
            want[(k, r[1])] = last
    assert got == want


def test_running_sum(scan):
    rows, s = scan
    got = {(r.k, r.seq): r.total for r in s.running_sum("n", "total").result().collect()}
    want = {}
    for k, group in by_key(rows).items():
        total = 0
        for r in group:
            total += r[3]
            want[(k, r[1])] = total
    assert got == want


def test_no_keys_and_timestamp_order(spark):
    df = spark.range(500).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    got = ordered(df, [], ["ts"], 40).row_number("rn").result().collect()
    assert all(r.rn == r.id + 1 for r in got)


def test_unordered_type_is_refused(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(TypeError):
        ordered(df, [], ["s"], 2)


def test_more_chunks_than_coarse_cells(spark, monkeypatch):
    """Chunks follow the rows: far over 32,768 of them, none much larger than asked, a hot key over very many."""
    n = 80_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("n"))
    scan = ordered(df, ["k"], ["seq"], 2)
    sizes = scan.rows.groupBy(CHUNK).count()
    made, largest, low, high = sizes.agg(F.count("*"), F.max("count"), F.min(CHUNK), F.max(CHUNK)).first()
    assert scan.chunks > 32_768 and made > 25_000 and largest <= 20 and low == 0 and high == scan.chunks - 1
    assert scan.rows.filter("k = -1").select(CHUNK).distinct().count() > 15_000
    # in the order of (key hash, seq)
    w = Window.orderBy(F.xxhash64("k"), "seq")
    assert scan.rows.withColumn("back", F.col(CHUNK) < F.lag(CHUNK).over(w)).filter("back").count() == 0
    got = scan.running_sum("n", "total").result()
    want = df.withColumn("want", F.sum("n").over(Window.partitionBy("k").orderBy("seq")))
    assert got.join(want, ["k", "seq"]).filter("total = want").count() == n


@pytest.mark.parametrize("coarse,rows_a_chunk", [(4, 7), (4, 50), (9, 3)])
def test_two_levels(spark, monkeypatch, coarse, rows_a_chunk):
    monkeypatch.setattr("eventflow.operators.ordered.COARSE", coarse)
    rows = skewed_rows()
    s = ordered(spark.createDataFrame(rows, "k string, seq long, v string, n long").repartition(5), ["k"], ["seq"], rows_a_chunk)
    assert s.chunks > coarse
    got = {(r.k, r.seq): (r.rn, r.pv) for r in s.row_number("rn").lag({"pv": "v"}).result().collect()}
    want = {(k, r[1]): (i + 1, group[i - 1][2] if i else None) for k, group in by_key(rows).items() for i, r in enumerate(group)}
    assert got == want


# a walk whose steps do not commute: the last few values, and a running total that an "x" starts anew

def _step(state, rows):
    total, reset, tail = state
    out, tails = [], []
    for v, n in zip(rows.column("v").to_pylist(), rows.column("n").to_pylist()):
        if v == "x":
            total, reset = 0, True
        total += n
        tail = [*tail, n][-3:]
        out.append(total)
        tails.append("/".join(map(str, tail)))
    return (total, reset, tail), [out, tails]


def _both(a, b):
    return (b[0] if b[1] else a[0] + b[0], a[1] or b[1], [*a[2], *b[2]][-3:])


@pytest.mark.parametrize("chunk_rows", [10_000, 50, 4])
def test_scan_is_one_walk(spark, chunk_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, seq long, v string, n long").repartition(5).withColumn("total", F.lit("mine"))
    walk = Walk((0, False, []), _step, _both, "total bigint, reset boolean, tail array<bigint>", "total bigint, tail string")
    got = scan_rows(df, ["k"], ["seq"], walk, chunk_rows)
    assert got.columns == ["k", "seq", "v", "n", "total", "tail"]
    want = {}
    for k, group in by_key(rows).items():
        total, tail = 0, []
        for r in group:
            total = r[3] + (0 if r[2] == "x" else total)
            tail = [*tail, r[3]][-3:]
            want[(k, r[1])] = (total, "/".join(map(str, tail)))
    assert {(r.k, r.seq): (r.total, r.tail) for r in got.collect()} == want
    assert scan_rows(df.limit(0), ["k"], ["seq"], walk, chunk_rows).count() == 0


def test_no_task_walks_a_whole_shard(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, seq long, v string, n long")
    walk = Walk((0, False, []), _step, _both, "total bigint, reset boolean, tail array<bigint>", "total bigint, tail string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # chunks this small would share a task
    try:
        tasks = [r.task for r in scan_rows(df, ["k"], ["seq"], walk, 50).withColumn("task", F.spark_partition_id()).filter("k = 'hot'").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(set(tasks)) == 4 and max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)
