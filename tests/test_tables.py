"""Snapshot and deltas: folders and read cost stay flat, a repeated batch does no harm."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from eventflow.sources import sinks, streams
from eventflow.streaming import tables

SCHEMA = "k int, batch_no int, n int"


def folders(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in ("delta", "snapshot") if os.path.isdir(f"{path}/{d}")}


def feed(spark, folder, first, last):
    for b in range(first, last):
        spark.createDataFrame([(k, b, b * 10 + k) for k in range(b % 3, 12, 2)] + [(100 + b, b, -1)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    rows = streams.open_stream(spark, {"kind": "landing", "attributes": {"path": f"{folder}/in", "maxFilesPerTrigger": 1}}, SCHEMA)
    return rows.groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("seen"))


def run(spark, folder, **options):
    out = stream(spark, folder)
    sinks.run_once(tables.write_latest(out, f"{folder}/t", f"{folder}/state", ["k"], **options))
    return tables.latest(spark, f"{folder}/t", ["k"], out.schema)


def want(spark, folder):
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/in").groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("seen"))
    return sorted(map(tuple, rows.collect()))


def test_fifty_batches(spark, folder):
    most = 0
    for first in range(0, 50, 10):
        feed(spark, folder, first, first + 10)
        got = run(spark, folder, merge_after=4)
        assert sorted(map(tuple, got.collect())) == want(spark, folder)
        now = folders(f"{folder}/t")
        most = max(most, len(now["delta"]) + len(now["snapshot"]))
    assert most <= 2 * 4 + 2 and len(os.listdir(f"{folder}/t/pointer")) <= 3


def test_gone_rows_leave(spark, folder):
    feed(spark, folder, 0, 12)
    got = run(spark, folder, merge_after=3, gone=F.col("n") < 0)
    assert got.filter("k >= 100").count() <= 3
    assert sorted(map(tuple, got.filter("k < 100").collect())) == [r for r in want(spark, folder) if r[0] < 100]


def test_repeated_batches(spark, folder):
    """A batch that runs again, before or after its merge, changes nothing; a snapshot without its pointer does not count."""
    feed(spark, folder, 0, 5)
    out = run(spark, folder, merge_after=3)
    rows, schema = sorted(map(tuple, out.collect())), out.schema
    writer = tables.write_latest(stream(spark, folder), f"{folder}/t", f"{folder}/again", ["k"], merge_after=3)
    sinks.run_once(writer)  # another checkpoint: all batches once more
    assert sorted(map(tuple, tables.latest(spark, f"{folder}/t", ["k"], schema).collect())) == rows
    spark.createDataFrame([(1, 1, 1)], schema).write.parquet(f"{folder}/t/snapshot/upto=99")
    assert sorted(map(tuple, tables.latest(spark, f"{folder}/t", ["k"], schema).collect())) == rows


def test_nothing_written_yet(spark, folder):
    schema = spark.createDataFrame([], "k int, n int").schema
    assert tables.latest(spark, f"{folder}/none", ["k"], schema).count() == 0
