"""The stream over shard logs: start positions, restarts, chosen shards, bounded micro-batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventflow.sources import shard_log as S
from eventflow.sources import sinks

SCHEMA = "topic string, shard_id int, offset bigint, body string, at timestamp"


def rows(spark, low, high, topics=("a", "b/c d"), shards=3):
    """Offsets low to high of each shard, with a gap at every tenth."""
    parts = [spark.range(low, high).filter("id % 10 <> 9").select(F.lit(t).alias("topic"), F.lit(s).alias("shard_id"), F.col("id").alias("offset"),
                                                                 F.concat(F.lit(f"{t}/{s}/"), "id").alias("body"), F.timestamp_seconds("id").alias("at"))
             for t in topics for s in range(shards)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def offsets(low, high):
    return [i for i in range(low, high) if i % 10 != 9]


def take(spark, folder, name="one", **options):
    """What one run reads, by shard, beyond what earlier runs of this name read."""
    stream = S.open_log(spark, f"{folder}/log", SCHEMA, **options)
    sinks.run_once(sinks.write_batches(stream, f"{folder}/{name}", f"{folder}/{name}-state"))
    found = {}
    try:
        read = spark.read.schema(SCHEMA).parquet(f"{folder}/{name}/batch=*").collect()
    except Exception:
        return {}
    for r in read:
        assert r.body == f"{r.topic}/{r.shard_id}/{r.offset}" and r.at.timestamp() == r.offset
        found.setdefault((r.topic, r.shard_id), []).append(r.offset)
    return {k: sorted(v) for k, v in found.items()}


def test_restart_goes_on(spark, folder):
    S.write_log(rows(spark, 0, 25), f"{folder}/log")
    assert take(spark, folder, start="earliest", progress=f"{folder}/progress") == {(t, s): offsets(0, 25) for t in ("a", "b/c d") for s in range(3)}
    S.write_log(rows(spark, 25, 60, ("a",), 4), f"{folder}/log")  # with a new shard, which begins at 25
    got = take(spark, folder, start="earliest", progress=f"{folder}/progress")
    assert got[("a", 0)] == offsets(0, 60) and got[("a", 3)] == offsets(25, 60) and got[("b/c d", 2)] == offsets(0, 25)


@pytest.mark.parametrize("start,first", [("earliest", 0), ("EARLIEST", 0), ("12", 12), ("latest", 25)])
def test_start(spark, folder, start, first):
    S.write_log(rows(spark, 0, 25), f"{folder}/log")
    take(spark, folder, start=start, topics=["a"])
    S.write_log(rows(spark, 25, 40), f"{folder}/log")
    assert take(spark, folder, start=start, topics=["a"]) == {("a", s): offsets(first, 40) for s in range(3)}


def test_commits_win_over_the_start(spark, folder):
    S.write_log(rows(spark, 0, 25), f"{folder}/log")
    commits = spark.createDataFrame([("a", 0, 7), ("a", 1, 25), ("x", 0, 3)], "topic string, shard_id int, committed bigint")
    S.commit_positions(commits.limit(0), f"{folder}/commits")
    S.commit_positions(commits, f"{folder}/commits")
    got = take(spark, folder, start="20", commits=f"{folder}/commits")
    assert got == {("a", 0): offsets(7, 25), ("a", 2): offsets(20, 25), **{("b/c d", s): offsets(20, 25) for s in range(3)}}


def test_progress_is_a_start(spark, folder):
    S.write_log(rows(spark, 0, 25), f"{folder}/log")
    take(spark, folder, start="earliest", progress=f"{folder}/progress")
    S.write_log(rows(spark, 25, 50), f"{folder}/log")
    take(spark, folder, start="earliest", progress=f"{folder}/progress")  # the run after tells that the first one is done
    positions = S.read_positions(f"{folder}/progress")
    assert positions and set(positions.values()) <= {25, 50}
    S.write_log(rows(spark, 50, 70), f"{folder}/log")
    got = take(spark, folder, "two", start="earliest", commits=f"{folder}/progress")
    assert got == {tuple(__import__("json").loads(k)): offsets(v, 70) for k, v in positions.items()}


def test_parts_are_disjoint_and_whole(spark, folder):
    S.write_log(rows(spark, 0, 25, shards=5), f"{folder}/log")
    parts = [take(spark, folder, f"part{i}", start="earliest", part=(i, 3)) for i in range(3)]
    assert sum(map(len, parts)) == len({k for p in parts for k in p}) == 10
    assert {s for _, s in parts[1]} == {1, 4}
    assert {s for _, s in take(spark, folder, "list", start="earliest", shards=[0, 4])} == {0, 4}


def test_ranges_and_gaps(spark, folder):
    """A busy shard is several ranges; ranges without rows are none, a range is where the offsets say."""
    S.write_log(rows(spark, 0, 25, ("a",), 1), f"{folder}/log")
    S.write_log(rows(spark, 1000, 1010, ("a",), 1), f"{folder}/log")
    reader = S.ShardLogReader(spark.createDataFrame([], SCHEMA).schema, {"path": f"{folder}/log", "start": "earliest", "rangeRows": "10"})
    found = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [(p.low, p.high) for p in found] == [(0, 10), (10, 20), (20, 30), (1000, 1009)]
    assert sum(len(b) for p in found for b in reader.read(p)) == len(offsets(0, 25)) + 9
    assert take(spark, folder, start="earliest", range_rows=10) == {("a", 0): offsets(0, 25) + offsets(1000, 1010)}


def test_bounded_micro_batches(spark, folder):
    """Each run takes one micro-batch; none is lost or repeated."""
    S.write_log(rows(spark, 0, 40, ("a",), 2), f"{folder}/log")
    with pytest.raises(ValueError):
        S.ShardLogReader(spark.createDataFrame([], SCHEMA).schema, {"path": folder, "maxOffsetsPerTrigger": "5"})
    seen = 0
    for run in range(12):
        got = take(spark, folder, start="earliest", progress=f"{folder}/progress", max_offsets=20)
        count = sum(map(len, got.values()))
        assert count - seen <= 20 and all(v == offsets(0, 40)[:len(v)] for v in got.values())
        seen = count
    assert got == {("a", s): offsets(0, 40) for s in range(2)}


def test_bad_options(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    for bad in ({"start": "soon"}, {"part": "3/3"}):
        with pytest.raises(ValueError):
            S.ShardLogReader(schema, {"path": "/x", **bad})


def test_empty_log(spark, folder):
    assert take(spark, folder, start="earliest") == {}
