"""Streaming forms equal their batch forms on the same rows, over several micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventflow.operators import delivery as D
from eventflow.operators.batching import assign_batches
from eventflow.operators.envelope import to_envelope
from eventflow.operators.metrics import rollup_windows, stuck_events
from eventflow.sources import sinks, streams
from eventflow.streaming import batches, twins

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, topic string, shard_id int, offset long, ts timestamp, process_error boolean, value long"


def rows(n=240, seed=5):
    rng = random.Random(seed)
    at, out, offsets = START, [], {}
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 30, 200]))
        topic, shard = rng.choice("ttu"), rng.choice([0, 0, 1])
        offset = offsets[(topic, shard)] = offsets.get((topic, shard), -1) + 1
        out.append((i, topic, shard, offset, at, rng.random() < 0.2, rng.randint(0, 50)))
    return out


@pytest.fixture
def landing(spark, folder):
    """The rows as six files that arrive in order, and as a table."""
    everything = rows()
    for part in range(6):
        spark.createDataFrame(everything[part * 40:(part + 1) * 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream():
        return streams.open_stream(spark, {"kind": "landing", "attributes": {"path": f"{folder}/in", "maxFilesPerTrigger": 1}}, SCHEMA)

    return stream, spark.createDataFrame(everything, SCHEMA), folder


def run(spark, stream, folder, mode="append", name="out"):
    sinks.run_once(sinks.write_batches(stream, f"{folder}/{name}", f"{folder}/{name}-state").outputMode(mode))
    return f"{folder}/{name}"


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_several_micro_batches(spark, landing):
    stream, table, folder = landing
    path = run(spark, stream(), folder)
    got = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    assert got.select("batch").distinct().count() == 6
    assert as_set(got, "event_id", "offset") == as_set(table, "event_id", "offset")


def test_batches(spark, landing):
    stream, table, folder = landing
    sentinel = spark.createDataFrame([(10_000 + i, t, s, 999, START + timedelta(days=1), False, 0) for i, (t, s) in enumerate(
        (t, s) for t in "tu" for s in (0, 1))], SCHEMA)
    sentinel.unionByName(sentinel.withColumns({"event_id": F.col("event_id") + 100, "ts": F.col("ts") + F.expr("interval 1 day")})
                         ).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = batches.batch_stream(stream(), ["topic", "shard_id"], "ts", ["event_id"], 4, "2m", "0 seconds")
    path = run(spark, out, folder)
    got = spark.read.schema(out.schema).parquet(f"{path}/batch=*").filter("event_id < 10000")
    want = assign_batches(table, ["topic", "shard_id"], "ts", ["event_id"], 4, "2m", 50)
    columns = ("event_id", "batch_no", "pos", "topic", "value")
    assert as_set(got, *columns) == as_set(want, *columns)


def test_frontier(spark, landing):
    stream, table, folder = landing
    out = twins.frontier_stream(D.ack_decision(stream()), 3)
    path = run(spark, out, folder, "update")
    got = twins.latest_rows(spark, path, ("topic", "shard_id"), out.schema.add("batch", "integer"))
    assert as_set(got, "topic", "shard_id", "committed") == as_set(
        D.commit_frontier(D.ack_decision(table), 3), "topic", "shard_id", "committed")


def test_pending(spark, landing):
    stream, table, folder = landing
    acked = "value < 30"
    out = twins.pending_stream(stream(), stream().filter(acked))
    path = run(spark, out, folder, "update")
    state = twins.latest_rows(spark, path, D.POSITION, out.schema.add("batch", "integer")).filter("received and not acked")
    assert as_set(state, *D.POSITION) == as_set(D.pending(table, table.filter(acked)), *D.POSITION)


def test_dedupe(spark, landing):
    stream, table, folder = landing
    out = twins.dedupe_stream(stream().unionByName(stream()), delay="1 day")
    path = run(spark, out, folder)
    got = spark.read.schema(out.schema).parquet(f"{path}/batch=*")
    assert as_set(got, "event_id") == as_set(D.dedupe(table), "event_id")


@pytest.mark.parametrize("form", [lambda s: twins.dedupe_stream(s, delay="1 day"), D.dedupe])
def test_dedupe_keeps_rows_without_position(spark, landing, form):
    stream, table, folder = landing
    bare = stream().withColumn("offset", F.lit(None).cast("bigint"))
    out = form(bare.unionByName(stream()).unionByName(stream()))
    path = run(spark, out, folder)
    got = spark.read.schema(out.schema).parquet(f"{path}/batch=*")
    assert got.filter("offset is null").count() == table.count()
    assert got.filter("offset is not null").count() == D.dedupe(table).count()


def test_rollup_drops_open_windows_only(spark, landing):
    stream, table, folder = landing
    keyed = stream().withColumn("metric", F.col("topic"))
    path = run(spark, twins.rollup_stream(keyed, "5m", delay="0 seconds"), folder)
    got = spark.read.parquet(f"{path}/batch=*")
    closed = table.agg(F.max("ts")).first()[0]
    want = rollup_windows(table.withColumn("metric", F.col("topic")), ["5m"]).filter(
        F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(closed))
    columns = ("metric", "window_start", "n", "total", "low", "high")
    assert as_set(got, *columns) == as_set(want, *columns) and got.count() > 5


def test_stuck(spark, landing):
    stream, table, folder = landing
    ends = stream().filter("not process_error")
    path = run(spark, twins.stuck_stream(stream(), ends, "1m", "0 seconds"), folder)
    got = spark.read.schema("event_id long, ts timestamp").parquet(f"{path}/batch=*")
    now = table.filter("not process_error").agg(F.max("ts")).first()[0]
    want = stuck_events(table.select("event_id", "ts"), table.filter("not process_error"), "1m", now)
    assert as_set(got, "event_id") == as_set(want, "event_id") and got.count() > 5


def test_recorder_round_trip(spark, landing):
    stream, table, folder = landing
    sent = to_envelope(stream(), {"body": F.concat(F.lit("prefix-"), "topic", F.lit("-"), F.col("offset").cast("string")), "ts": "ts",
                                  "trigger_kind": F.when(F.col("value") == 7, "http").otherwise("kafka-cluster"),
                                  "headers": F.create_map(F.lit("s"), F.col("shard_id").cast("string"))}, "kafka-cluster", "k")
    sinks.run_once(sinks.record_events(sent, f"{folder}/rec", f"{folder}/rec-state"))
    got = sinks.read_recorded(spark, f"{folder}/rec", ignore="prefix-t-0")
    want = table.filter("value != 7 and not (topic = 't' and offset = 0)").select(
        F.concat(F.lit("prefix-"), "topic", F.lit("-"), F.col("offset").cast("string")).alias("body"))
    assert as_set(got, "body") == as_set(want, "body")
    times = [r.timestamp for r in got.collect()]
    assert times == sorted(times)


def test_repeated_batch_is_written_once(spark, landing):
    """A batch that runs again (its commit was lost) replaces its own output."""
    import pathlib

    stream, table, folder = landing
    path = run(spark, stream(), folder)
    for name in ("5", ".5.crc"):
        commit = pathlib.Path(f"{folder}/out-state/commits/{name}")
        if commit.exists():
            commit.write_bytes(b"")
            commit.rename(f"{folder}/kept-{name.strip('.')}")
    again = run(spark, stream(), folder)
    assert spark.read.schema(SCHEMA).parquet(f"{again}/batch=*").count() == table.count()


def test_forward(spark, landing):
    stream, table, folder = landing
    sinks.run_once(sinks.forward(stream(), {"kind": "landing", "path": f"{folder}/fw"}, ("event_id", "value"), f"{folder}/fw-state",
                                 key="shard_id"))
    sent = spark.read.schema("key string, value string").parquet(f"{folder}/fw/batch=*")
    got = sent.select(F.col("key").cast("int").alias("shard_id"), F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))
    assert as_set(got, "event_id", "shard_id") == as_set(table, "event_id", "shard_id")


def test_unknown_trigger(spark):
    with pytest.raises(ValueError):
        streams.open_stream(spark, {"kind": "pigeon"})
    with pytest.raises(ValueError):
        streams.open_stream(spark, {"kind": "landing", "attributes": {"path": "x"}})


def test_processing_over_batches(spark, landing):
    """Six micro-batches: positions and counts grow, and equal those of the whole table."""
    from eventflow.operators.handlers import NO_ACK_HEADER, Response
    from eventflow.operators.metrics import counter_delta
    from eventflow.streaming import process

    stream, table, folder = landing

    def handler(context, event):
        context.user_data["seen"] = context.user_data.get("seen", 0) + 1
        if event.offset % 5 == 0:
            raise ValueError("no")
        if event.offset % 7 == 0:
            return ["two", "answers"]
        return Response(event.body, headers={NO_ACK_HEADER: event.offset % 3 == 0})

    def envelope(rows):
        broken = F.col("value") == 9
        return to_envelope(rows, {
            "topic": "topic", "shard_id": "shard_id", "offset": "offset", "ts": "ts",
            "content_type": F.when(broken, "application/cloudevents+json").otherwise("text/plain"),
            "body": F.when(broken, "{nope").otherwise(F.col("topic"))}, "kafka-cluster", "k")

    sinks.run_once(process.process_events(envelope(stream()), handler, folder, f"{folder}/state", "enable", 2))
    whole = process.handle(envelope(table), handler)
    want = D.commit_frontier(D.ack_decision(whole, "enable"), 2)
    assert as_set(process.committed(spark, folder), "topic", "shard_id", "committed") == as_set(want, "topic", "shard_id", "committed")
    counts = {r.result: r.n for r in process.handled(spark, folder).groupBy("result").agg(F.sum("value").alias("n")).collect()}
    broken = table.filter("value = 9").count()
    assert counts == {"success": 240 - broken, "failure": broken} and broken > 0
    assert process.outcomes_of(spark, folder).count() == whole.count() > 240
    # the counts of each batch are snapshots of growing counters
    snaps = spark.read.option("basePath", f"{folder}/handled").parquet(f"{folder}/handled").withColumn(
        "at", F.timestamp_seconds("batch"))
    deltas = counter_delta(snaps, ["topic", "result"], "at", ["value"])
    assert deltas.filter("value_delta < 0").count() == 0 and snaps.select("batch").distinct().count() == 6


@pytest.mark.parametrize("chunk_rows", [15, 100_000])
def test_written_batches(spark, landing, chunk_rows):
    """Micro-batch by micro-batch, with keys cut into chunks, the batches are those of one walk."""
    stream, table, folder = landing
    sentinel = spark.createDataFrame([(10_000 + i, t, s, 999, START + timedelta(days=1 + d), False, 0) for d in (0, 1)
                                      for i, (t, s) in enumerate((t, s) for t in "tu" for s in (0, 1))], SCHEMA)
    sentinel.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    sinks.run_once(batches.write_batched(stream(), ["topic", "shard_id"], "ts", ["event_id"], f"{folder}/b", f"{folder}/state", 4,
                                         "2m", "0s", chunk_rows))
    got = batches.batched(spark, f"{folder}/b").filter("event_id < 10000")
    walked = assign_batches(table, ["topic", "shard_id"], "ts", ["event_id"], 4, "2m")
    first = walked.groupBy("batch_id").agg(F.min_by(F.struct(F.unix_micros("ts").alias("us"), "event_id"), "pos").alias("f"))
    want = walked.join(first, "batch_id").withColumn("batch_id", F.concat_ws(
        "/", "topic", F.col("shard_id").cast("string"), F.col("f.us").cast("string"), F.col("f.event_id").cast("string")))
    columns = ("event_id", "batch_id", "pos", "value")
    assert as_set(got, *columns) == as_set(want, *columns)
    assert max(r["count"] for r in spark.read.option("basePath", f"{folder}/b/open").parquet(f"{folder}/b/open").groupBy(
        "batch", "topic", "shard_id").count().collect()) < 4
    left = {kind: len(list(Path(folder, "b", kind).glob("batch=*"))) for kind in ("rows", "numbered", "open", "mark", "closed")}
    assert left == {"rows": 0, "numbered": 0, "open": 2, "mark": 2, "closed": left["closed"]} and left["closed"] > 2
