from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventflow.operators import delivery as D


def outcomes(spark, n, start=1):
    return spark.range(start, start + n).select(
        F.lit("t").alias("topic"), F.lit(0).alias("shard_id"), F.col("id").alias("offset"),
        F.lit(None).cast("string").alias("process_error"))


def test_ack_window_story(spark):
    """10 records: nothing committed; 11: one; after a restart with 5 more, 15 come (again)."""
    def state(n, prior=None):
        acked = D.ack_decision(outcomes(spark, n))
        commits = D.commit_frontier(acked, 10, "stream", prior)
        current = acked.groupBy("topic", "shard_id").agg(F.max("offset").alias("current"))
        return D.shard_lags(current, commits).first(), commits

    first, _ = state(10)
    assert (first.current, first.committed) == (10, 0)
    second, commits = state(11)
    assert (second.committed, second.lag) == (1, 10)
    assert D.redelivered(outcomes(spark, 16), commits, "stream").count() == 15
    third, _ = state(16, commits)
    assert (third.committed, third.lag) == (6, 10)


def test_frontier_never_moves_back(spark):
    prior = spark.createDataFrame([("t", 0, 50), ("u", 1, 3)], "topic string, shard_id int, committed long")
    rows = {(r.topic, r.shard_id): r.committed for r in
            D.commit_frontier(D.ack_decision(outcomes(spark, 5)), 0, "kafka", prior).collect()}
    assert rows == {("t", 0): 50, ("u", 1): 3}
    fresh = D.commit_frontier(D.ack_decision(outcomes(spark, 5)), 100).first()
    assert fresh.committed == 0


def test_failed_record_is_passed_over(spark):
    rows = outcomes(spark, 5).withColumn("process_error", F.when(F.col("offset") == 3, "boom"))
    assert D.commit_frontier(D.ack_decision(rows)).first().committed == 6


@pytest.mark.parametrize("mode,want", [("disable", [1, 3]), ("enable", [1]), ("explicitOnly", []), ("odd", [1, 3])])
def test_ack_modes(spark, mode, want):
    df = spark.createDataFrame([(1, None, None), (2, "err", False), (3, None, True), (4, "err", True)],
                               "id int, process_error string, no_ack boolean")
    assert sorted(r.id for r in D.ack_decision(df, mode).filter("acked").collect()) == want


@pytest.mark.parametrize("mode", ["enable", "explicitOnly"])
def test_explicit_ack_story(spark, mode):
    log = outcomes(spark, 10, 0).withColumn("no_ack", F.lit(True))
    assert D.commit_frontier(D.ack_decision(log, mode)).first() is None  # nothing is marked
    none = log.limit(0).select("topic", "shard_id", "offset")
    assert D.pending(log, none).count() == 10
    acks = log.filter("offset < 6").select(F.lit("streamMessageAck").alias("kind"), "topic", "shard_id", "offset")
    claims = spark.createDataFrame([("t", 0)], "topic string, shard_id int")
    assert D.pending_size(log, acks).first().pending == 4
    assert D.apply_acks(acks, claims).first().committed == 6


def test_acks_for_others_are_ignored(spark):
    acks = spark.createDataFrame([("streamMessageAck", "t", 0, 4), ("streamMessageAck", "t", 9, 8), ("other", "t", 0, 90),
                                  ("streamMessageAck", "/", 0, 30)], "kind string, topic string, shard_id int, offset long")
    claims = spark.createDataFrame([("t", 0), ("u", 0)], "topic string, shard_id int")
    assert [tuple(r) for r in D.apply_acks(acks, claims).collect()] == [("t", 0, 5)]
    stream = sorted(tuple(r) for r in D.apply_acks(acks, claims, 10, "stream").collect())
    assert stream == [("t", 0, 20), ("u", 0, 20)]


def test_dispositions(spark):
    rows = [("rabbit-mq", "e", None, "unacked"), ("rabbit-mq", None, "e", "ack"), ("pubsub", None, "e", "nack"),
            ("pubsub", None, None, "ack"), ("eventhub", "e", "e", "ack"), ("kinesis", None, "e", "advance"),
            ("nats", "e", None, "lost"), ("mqtt", None, None, "none")]
    df = spark.createDataFrame(rows, "kind string, submit_error string, process_error string, want string")
    assert all(r.disposition == r.want for r in D.disposition(df).collect())


@pytest.mark.parametrize("workers,claims,want", [
    (2, {"t1": [0], "t2": [10, 20, 30]}, {"t1": [0], "t2": [0, 1, 0]}),
    (4, {"t1": list(range(16))}, {"t1": [0, 1, 2, 3] * 4}),
    (4, {"t1": [0], "t2": [10, 20, 30]}, {"t1": [0], "t2": [0, 1, 2]})])
@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_worker_map(spark, workers, claims, want, chunk_rows):
    rows = [(t, s, i) for t, shards in claims.items() for i, s in enumerate(shards)]
    df = spark.createDataFrame(rows, "topic string, shard_id int, pos int")
    got = {}
    for r in sorted(D.assign_workers(df, workers, chunk_rows=chunk_rows).collect(), key=lambda r: r.pos):
        got.setdefault(r.topic, []).append(r.worker)
    assert got == want


def test_suggested_workers(spark):
    df = spark.range(10).select(F.lit("t").alias("topic"), F.col("id").cast("int").alias("shard_id"), F.col("id").alias("pos"))
    # ceil(10 / 4 * 1.2) = 3
    assert {r.worker for r in D.assign_workers(df, replicas=4).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        D.assign_workers(df)


@pytest.mark.parametrize("chunk_rows", [9, 100_000])
def test_drained_events(spark, chunk_rows):
    """A worker with nearly all events, many at one time, and signals in between."""
    events = spark.range(400).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 20 == 0, 2).otherwise(1).alias("worker"),
        F.timestamp_seconds((F.col("id") / 10).cast("int")).alias("ts"))
    signals = spark.createDataFrame([(1, "drain", 5), (1, "continue", 9), (1, "terminate", 30), (1, "continue", 30), (2, "drain", 39)],
                                    "worker int, signal string, s long").select(
        "worker", "signal", F.timestamp_seconds("s").alias("ts"))
    got = sorted(r.event_id for r in D.discard_drained(events, signals, chunk_rows).collect())

    def kept(i):
        second = i // 10
        if i % 20 == 0:
            return second < 39
        return not (5 <= second < 9 or second >= 30)

    assert got == [i for i in range(400) if kept(i)]


def test_ordered_apply_keeps_offset_order(spark):
    df = spark.range(300).select(F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("shard_id"),
                                 F.col("id").alias("offset")).repartition(7)

    def same(batches):
        yield from batches

    rows = D.ordered_apply(df, same, "topic string, shard_id int, offset long", 4).collect()
    assert [(r.shard_id, r.offset) for r in rows] == sorted((r.shard_id, r.offset) for r in rows) and len(rows) == 300


def test_ordered_apply_keeps_state_over_a_shard(spark):
    df = spark.range(4000).select(F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("shard_id"),
                                  F.col("id").alias("offset")).repartition(7)

    def running(batches):
        shard, n = None, 0
        for rows in batches:
            out = []
            for at in rows["shard_id"]:
                shard, n = at, (n if at == shard else 0) + 1
                out.append(n)
            yield rows.assign(n=out)

    rows = D.ordered_apply(df, running, "topic string, shard_id int, offset long, n long", 8).collect()
    assert len(rows) == 4000 and all(r.n == r.offset // 2 + 1 for r in rows)


def test_dedupe_and_redelivery_of_uncommitted(spark):
    log = outcomes(spark, 4).unionByName(outcomes(spark, 4))
    assert D.dedupe(log).count() == 4
    none = spark.createDataFrame([], "topic string, shard_id int, committed long")
    assert D.redelivered(outcomes(spark, 4), none).count() == 4
    at = spark.createDataFrame([("t", 0, 3)], "topic string, shard_id int, committed long")
    assert sorted(r.offset for r in D.redelivered(outcomes(spark, 4), at).collect()) == [3, 4]


def test_rows_without_position_are_no_copies(spark):
    rows = spark.createDataFrame([("t", 0, 1), ("t", 0, 1), (None, None, None), (None, None, None), ("t", None, 1), ("t", None, 1)],
                                 "topic string, shard_id int, offset long")
    assert D.dedupe(rows).count() == 5


def test_signal_index_is_the_union_form(spark):
    """Few signals are an index and the events are not moved; both forms drop the same events, ties, nulls and unknown workers too."""
    import random
    from datetime import datetime, timedelta
    rng = random.Random(8)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 200))
    events = spark.createDataFrame([(i, rng.choice([0, 0, 0, 1, 2, None]), at() if i % 20 else None) for i in range(600)], "i int, worker int, ts timestamp")
    signals = spark.createDataFrame([(rng.choice([0, 0, 1, None]), at(), rng.choice(["drain", "continue", "terminate"])) for _ in range(80)], "worker int, ts timestamp, signal string")
    few, many = D.discard_drained(events, signals), D.discard_drained(events, signals, 40, few=0)
    assert sorted(r.i for r in few.collect()) == sorted(r.i for r in many.collect())
    assert few.columns == events.columns
    plan = few._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "hashpartitioning" not in above and "rangepartitioning" not in above
    assert D.discard_drained(events, signals.limit(0)).count() == 600
