from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventflow.functions.durations import duration_text_us, duration_us
from eventflow.sources import polling, schedule, streams

NOW = datetime(2024, 3, 5, 12, 34, 56, 500_000)
EPSILON = timedelta(microseconds=40)


def test_star_seconds_become_zero():
    assert schedule.parse_schedule("* */5 * * * *").seconds == (0,)
    assert schedule.parse_schedule("*/5 * * * *").minutes == tuple(range(0, 60, 5))
    assert schedule.parse_schedule("@hourly").minutes == (0,)
    assert schedule.parse_schedule("250ms") == schedule.Interval(250_000)
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *", "what"):
        with pytest.raises(ValueError):
            schedule.parse_schedule(bad)


@pytest.mark.parametrize("interval,late,want", [
    ("5ms", "0s", 0), ("250ms", "0s", 0), ("5s", "0s", 0), ("5m", "0s", 0), ("5h", "0s", 0), ("1ms", "1ms", 1),
    ("1ms", "150ms", 150), ("250ms", "1s", 4), ("1s", "1s", 1), ("1s", "1m", 60), ("1m", "1m", 1), ("1m", "1h", 60),
    ("1h", "1h", 1), ("1h", "24h", 24)])
def test_missed_intervals(spark, interval, late, want):
    due = NOW - timedelta(microseconds=duration_text_us(late)) - EPSILON
    runs = spark.createDataFrame([(due,)], "last_run timestamp")
    row = schedule.missed_ticks(runs, interval, NOW, due=True).first()
    assert row.missed == want
    before = spark.createDataFrame([(due - timedelta(microseconds=duration_text_us(interval)),)], "last_run timestamp")
    row = schedule.missed_ticks(before, interval, NOW).first()
    assert row.missed == want and (row.delay_us == 0 if want else row.delay_us <= duration_text_us(interval))


def test_missed_cron(spark):
    def run(spec, ago, due=False):
        df = spark.createDataFrame([(NOW - ago,)], "last_run timestamp")
        return schedule.missed_ticks(df, spec, NOW, due=due).first()

    assert run("*/5 * * * * *", timedelta(seconds=10), due=True).missed == 2
    just = run("*/5 * * * *", timedelta(0))
    assert just.missed == 0 and 0 < just.delay_us < 5 * 60 * 1_000_000
    assert run("*/5 * * * *", timedelta(minutes=10)).delay_us == 0


def test_next_day(spark):
    last = datetime(2019, 1, 1, 1, 1, 1, 1)
    df = spark.createDataFrame([(last,)], "last_run timestamp")
    row = schedule.missed_ticks(df, "1 1 * * *", last).select("missed", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("n")).first()
    assert (row.missed, row.n) == (0, "2019-01-02 01:01:00")


def direct_ticks(spec, start, end):
    cron = schedule.parse_schedule(spec)
    at, out = start.replace(microsecond=0) + timedelta(seconds=1), []
    while at <= end:
        week = (at.weekday() + 1) % 7
        if cron.any_day or cron.any_weekday:
            day = at.day in cron.days and week in cron.weekdays
        else:
            day = at.day in cron.days or week in cron.weekdays
        if day and at.month in cron.months and at.hour in cron.hours and at.minute in cron.minutes and at.second in cron.seconds:
            out.append(at)
        at += timedelta(seconds=1)
    return out


@pytest.mark.parametrize("spec", ["*/20 6-9 * * *", "30 */7 12 3,6 * mon-wed", "0 0 13 * 5", "15,45 0 23 28-31 feb *"])
def test_ticks_against_direct_walk(spark, spec):
    start, end = datetime(2024, 2, 28, 5, 59, 30), datetime(2024, 3, 6, 7, 0, 0)
    want = direct_ticks(spec, start, end)
    rows = schedule.ticks(spark, spec, start, end).select(F.unix_seconds("tick").alias("s")).collect()
    assert sorted(r.s for r in rows) == [int(t.replace(tzinfo=timezone.utc).timestamp()) for t in want]
    runs = spark.createDataFrame([(start,), (datetime(2024, 3, 3, 6, 20, 0),)], "last_run timestamp")
    for row, first in zip(schedule.missed_ticks(runs, spec, end).collect(), (start, datetime(2024, 3, 3, 6, 20, 0))):
        passed = [t for t in direct_ticks(spec, first, end) if t < end]
        assert row.missed == max(0, len(passed) - 1)


def test_interval_ticks(spark):
    start = datetime(2024, 1, 1)
    rows = schedule.ticks(spark, "250ms", start, start + timedelta(seconds=1)).collect()
    assert len(rows) == 4


def test_durations(spark):
    texts = ["10s", "250ms", "2h45m", "1.5h", "-3s", "0", "", "10", "abc", "5 s", "1h30m10s", "100us", "1500ns"]
    want = [10_000_000, 250_000, 9_900_000_000, 5_400_000_000, -3_000_000, 0, None, None, None, None, 5_410_000_000, 100, 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.d for r in df.select("i", duration_us(F.col("t")).alias("d")).orderBy("i").collect()] == want


def test_kafka_options():
    trigger = {"kind": "kafka-cluster", "url": "b:9092", "attributes": {"topics": ["a", "b"], "consumerGroup": "g"}}
    got = streams.kafka_options(trigger)
    assert got["subscribe"] == "a,b" and got["kafka.bootstrap.servers"] == "b:9092" and got["kafka.group.id"] == "g"
    assert got["startingOffsets"] == "latest" and got["kafka.max.partition.fetch.bytes"] == "1048576"
    assert got["kafka.session.timeout.ms"] == "10000" and got["kafka.fetch.max.wait.ms"] == "250"
    assert "kafka.security.protocol" not in got
    attributes = {**trigger["attributes"], "brokers": ["x:1", "y:2"], "initialOffset": "Earliest", "caCert": "-----BEGIN X----- ab cd -----END X-----",
                  "sasl": {"enable": True, "mechanism": "SCRAM-SHA-256", "user": "u", "password": "p"}}
    got = streams.kafka_options({**trigger, "attributes": attributes})
    assert got["kafka.bootstrap.servers"] == "x:1,y:2" and got["startingOffsets"] == "earliest"
    assert got["kafka.security.protocol"] == "SASL_SSL" and "ScramLoginModule" in got["kafka.sasl.jaas.config"]
    assert got["kafka.ssl.truststore.certificates"] == "-----BEGIN X-----\nab\ncd\n-----END X-----\n"
    for missing in ("topics", "consumerGroup"):
        with pytest.raises(ValueError):
            streams.kafka_options({**trigger, "attributes": {k: v for k, v in trigger["attributes"].items() if k != missing}})
    with pytest.raises(ValueError):
        streams.kafka_options({"attributes": trigger["attributes"]})
    with pytest.raises(ValueError):
        streams.initial_offset("middle")


def test_settings_by_annotation(spark):
    trigger = {"kind": "kafka-cluster", "url": "b:9092", "attributes": {"topics": ["a"], "consumerGroup": "g", "fetchMin": 7, "sasl": {"user": "own"}}}
    notes = {"x/kafka-session-timeout": "20s", "x/kafka-fetch-min": "9", "x/kafka-fetch-max": "11", "x/kafka-sasl-enabled": "T", "x/kafka-sasl-user": "u",
             "x/kafka-sasl-mechanism": "oauthbearer", "x/kafka-sasl-oauth-token-url": "t", "x/kafka-sasl-oauth-client-id": "c", "x/kafka-sasl-oauth-scopes": "r,w",
             "x/kafka-tls-enabled": "true", "x/kafka-tls-minimum-version": "1.3", "kafka-max-wait-time": "9s"}
    full = streams.annotated(trigger, notes, "x/")
    assert full["attributes"]["sasl"]["user"] == "own" and "enable" not in trigger["attributes"]["sasl"]
    got = streams.kafka_options(full)
    assert got["kafka.session.timeout.ms"] == "20000" and got["kafka.fetch.min.bytes"] == "7" and got["kafka.fetch.max.bytes"] == "11"
    assert got["kafka.fetch.max.wait.ms"] == "250" and got["kafka.ssl.enabled.protocols"] == "TLSv1.3" and got["kafka.security.protocol"] == "SASL_SSL"
    assert 'clientId="c"' in got["kafka.sasl.jaas.config"] and 'scope="r w"' in got["kafka.sasl.jaas.config"] and got["kafka.sasl.oauthbearer.token.endpoint.url"] == "t"
    for name, value in (("kafka-fetch-min", "many"), ("kafka-tls-enabled", "yes")):
        with pytest.raises(ValueError):
            streams.annotated({"attributes": {}}, {name: value})


def test_partitions_and_start_positions(spark):
    hub = streams.eventhub_options({"attributes": {"namespace": "n", "eventHubName": "h", "partitions": [0, 2]}})
    assert hub["assign"] == '{"h": [0, 2]}' and "subscribe" not in hub
    claims = spark.createDataFrame([("a", 0, 3, 90), ("a", 1, 0, 50), ("b", 0, 1, 9)], "topic string, shard_id int, earliest long, latest long")
    commits = spark.createDataFrame([("a", 1, 44)], "topic string, shard_id int, committed long")
    assert streams.starting_offsets(streams.resolve_start(claims, commits, "earliest")) == '{"a": {"0": 3, "1": 44}, "b": {"0": 1}}'


def test_pollers_share_the_items(spark):
    items = spark.range(2000).select(F.concat(F.lit("d/"), "id").alias("__name"), (F.col("id") + 1).alias("__mtime_secs"), F.lit(0).alias("__mtime_nsecs"),
                                     F.lit("f").alias("__obj_type"), F.col("id").alias("__size"))
    whole = {r["__name"] for r in polling.poll_items(items).collect()}

    def shares(n):
        return [{r["__name"] for r in polling.poll_items(items, shard=k, shards=n).collect()} for k in range(n)]

    four, five = shares(4), shares(5)
    for parts in (four, five):
        assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole) and min(map(len, parts)) > 300
    assert all(after <= before for before, after in zip(four, five))  # only the new poller takes items
    with pytest.raises(ValueError):
        polling.poll_items(items, shard=4, shards=4)


def test_polls_skip_what_is_done(spark, folder):
    rows = spark.range(100).select(F.col("id").cast("string").alias("__name"), (F.col("id") + 1000).alias("__mtime_secs"), F.lit(0).alias("__mtime_nsecs"),
                                   F.lit("f").alias("__obj_type"), F.col("id").alias("__size"))
    rows.write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    stamps = items.filter("__size < 40").select("__name", F.col("__mtime_secs").alias("secs"), F.lit(1).alias("nsecs"))
    assert polling.poll_floor(items, stamps) == 1040 and polling.poll_floor(items, stamps, slack=5) == 1035
    assert polling.poll_floor(items.limit(0), stamps) is None
    out = polling.poll_items(items, stamps, since=1040)
    assert out.count() == 60 == polling.poll_items(items, stamps).count()
    assert "GreaterThanOrEqual(__mtime_secs,1040)" in out._jdf.queryExecution().executedPlan().toString()


def test_other_stream_options():
    got = streams.kinesis_options({"attributes": {"streamName": "s", "iteratorType": "TRIM_HORIZON", "shards": ["0", "1"]}})
    assert got["startingPosition"] == "TRIM_HORIZON" and got["pollingPeriodMs"] == "500" and got["shards"] == "0,1"
    with pytest.raises(ValueError):
        streams.kinesis_options({"attributes": {"streamName": "s", "iteratorType": "MIDDLE"}})
    hub = streams.eventhub_options({"attributes": {"namespace": "n", "eventHubName": "h"}})
    assert hub["subscribe"] == "h" and hub["kafka.security.protocol"] == "SASL_SSL" and hub["kafka.group.id"] == "$Default"


@pytest.mark.parametrize("syntax,pattern,yes,no", [
    ("mqtt", "a/+/c", ["a/b/c", "a//c"], ["a/b/d", "a/b/c/d", "a/c"]),
    ("mqtt", "a/#", ["a", "a/b", "a/b/c"], ["ab", "b/a"]),
    ("mqtt", "#", ["a", "a/b"], ["$SYS/x"]),
    ("mqtt", "+/x", ["a/x"], ["$SYS/x", "a/b/x"]),
    ("amqp", "a.*.c", ["a.b.c"], ["a.c", "a.b.b.c"]),
    ("amqp", "a.#", ["a", "a.b", "a.b.c"], ["b", "ab"]),
    ("amqp", "#.c", ["c", "b.c", "a.b.c"], ["a.bc", "c.d", "xc"]),
    ("amqp", "a.#.c", ["a.c", "a.b.c", "a.b.b.c"], ["a", "ac", "a.b"]),
    ("amqp", "#", ["", "a", "a.b"], []),
    ("exact", "a.b", ["a.b"], ["axb"])])
def test_topic_patterns(spark, syntax, pattern, yes, no):
    rule = streams.topic_pattern(pattern, syntax)
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
    assert [r.t for r in df.filter(F.col("t").rlike(rule) != F.col("want")).collect()] == []


def test_bad_topic_filter():
    for bad in ("a/#/b", "a+/b", "a/b#"):
        with pytest.raises(ValueError):
            streams.topic_pattern(bad, "mqtt")


def test_consumer_gets_an_event_once(spark):
    df = spark.createDataFrame([("a/b",)], "topic string")
    rows = streams.route_by_topic(df, [("c", "a/#"), ("c", "+/b"), ("d", "x")], "mqtt").collect()
    assert [r.consumer for r in rows] == ["c"]


def test_polling_rounds(spark):
    def items(*rows):
        return spark.createDataFrame([(n, s, ns, "file", 1, {"a": "1"}) for n, s, ns in rows],
                                     "__name string, __mtime_secs long, __mtime_nsecs long, __obj_type string, __size long, "
                                     "attributes map<string,string>")

    def names(df):
        return sorted(r["__name"] for r in df.collect())

    first = items(("d/a.csv", 100, 5), ("d/b.csv", 100, 6), ("d/c.txt", 100, 7), ("e/a.csv", 100, 8))
    found = polling.poll_items(first, None, paths=["d/"], suffixes=[".csv"])
    assert names(found) == ["d/a.csv", "d/b.csv"]
    done = found.select("__name", F.timestamp_micros(F.lit(100_000_000)).alias("at"),
                        F.when(F.col("__name") == "d/b.csv", "failed").alias("error"))
    stamps = polling.stamp_items(None, done)
    assert [tuple(r) for r in stamps.collect()] == [("d/a.csv", 100, 0)]
    # a changed in the same second, a nanosecond later than the stamp; b failed; all of them come again
    assert names(polling.poll_items(first, stamps, suffixes=[".csv"])) == ["d/a.csv", "d/b.csv", "e/a.csv"]
    same = spark.createDataFrame([("d/a.csv", 100, 5), ("d/b.csv", 99, 999), ("e/a.csv", 101, 0)], "__name string, secs long, nsecs long")
    assert names(polling.poll_items(first, same, suffixes=[".csv"])) == ["d/b.csv"]
    assert names(polling.poll_items(first, same, suffixes=[".csv"], incremental=False)) == ["d/a.csv", "d/b.csv", "e/a.csv"]
    again = polling.stamp_items(same, done)
    assert {r["__name"]: r.secs for r in again.collect()} == {"d/a.csv": 100, "d/b.csv": 99, "e/a.csv": 101}


def test_poll_filters_reach_the_scan(spark, folder):
    df = spark.range(10).select(F.col("id").cast("string").alias("__name"), F.lit(1).alias("__mtime_secs"), F.lit(1).alias("__mtime_nsecs"),
                                F.lit("f").alias("__obj_type"), F.col("id").alias("__size"), F.lit("x").alias("color"), F.lit("y").alias("unused"))
    df.write.parquet(f"{folder}/items")
    out = polling.poll_items(spark.read.parquet(f"{folder}/items"), None, suffixes=["1"], predicates=["__size > 3"], attributes=["color"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(__size,3)" in plan and "StringEndsWith(__name,1)" in plan and "unused" not in plan


def test_interval_blocks(spark, monkeypatch):
    monkeypatch.setattr(schedule, "TICK_BLOCK", 10)
    df = spark.createDataFrame([(1, NOW, NOW + timedelta(seconds=33)), (2, NOW, NOW), (3, NOW, NOW + timedelta(seconds=20))],
                               "i int, a timestamp, b timestamp")
    rows = schedule.ticks_between(df, "1s", "a", "b").groupBy("i").agg(F.countDistinct("tick").alias("n"), F.count("*").alias("m")).collect()
    assert {r.i: (r.n, r.m) for r in rows} == {1: (33, 33), 3: (20, 20)}


@pytest.mark.parametrize("syntax,sep,one", [("mqtt", "/", "+"), ("amqp", ".", "*"), ("exact", "/", "+")])
def test_trie_is_the_regular_expressions(spark, syntax, sep, one):
    """Random patterns and topics; empty levels, hidden topics and nulls among them."""
    import random
    import re
    rng = random.Random(len(syntax))
    topics = [sep.join(rng.choice(["a", "b", "", "$s", "c d"]) for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["", "$a", f"$a{sep}b"]
    patterns = []
    for i in range(150):
        levels = [rng.choice(["a", "b", "", one, one, "$s", "#" if syntax == "amqp" else "a"]) for _ in range(rng.randint(1, 4))]
        if syntax == "mqtt" and rng.random() < 0.4:
            levels[-1] = "#"
        patterns.append((f"c{i % 40}", sep.join(levels)))
    trie = streams.TopicTrie.of(patterns, syntax)
    for topic in topics:
        want = {c for c, p in patterns if re.fullmatch(streams.topic_pattern(p, syntax).removeprefix("^").removesuffix("$"), topic)}
        assert trie.match(topic, syntax) == want, topic
    df = spark.createDataFrame([(i, t) for i, t in enumerate(topics)] + [(-1, None)], "i int, topic string")
    plain = sorted((r.i, r.consumer) for r in streams.route_by_topic(df, patterns, syntax).collect())
    assert plain == sorted((r.i, r.consumer) for r in streams.route_by_trie(df, patterns, syntax).collect())
    assert plain == sorted((r.i, r.consumer) for r in streams.route_by_trie(df, patterns, syntax, few=3).collect())
    with pytest.raises(ValueError):
        streams.TopicTrie.of([("c", "a/#/b")], "mqtt")


def test_plan_does_not_grow_with_subscriptions(spark):
    df = spark.createDataFrame([(i, f"a/{i}") for i in range(50)], "i int, topic string")
    plans = [streams.route_by_trie(df, [(f"c{k}", f"+/{k}") for k in range(n)], "mqtt")._jdf.queryExecution().executedPlan().toString() for n in (3, 10_000)]
    assert abs(len(plans[0]) - len(plans[1])) < 50 and all("rlike" not in p.lower() for p in plans)
