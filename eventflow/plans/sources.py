"""Sources, routing, schedules and sinks over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from eventflow.operators import envelope as E
from eventflow.plans import query
from eventflow.plans.envelope import item_rows, request_log
from eventflow.plans.tables import EVENTS, LOG, event_log, events, table
from eventflow.session import shared_dir
from eventflow.sources import polling, schedule, sinks, streams


def fresh_dir(spark) -> str:
    """A new folder for one run of a streaming query."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def event_stream(spark, sf_dir):
    """The events table as a landing stream."""
    schema = table(spark, sf_dir, "events").schema
    trigger = {"kind": "landing", "attributes": {"path": sf_dir, "pathGlobFilter": "events.parquet"}}
    return streams.open_stream(spark, trigger, schema).select(
        "event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 8).cast("int").alias("shard_id"),
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", F.col("props").alias("body"),
        (F.col("value") > 150).alias("process_error"))


@query("s1_open_stream", f"WITH {EVENTS} SELECT event_id, topic, shard_id, epoch_us(ts) AS ts_us, body FROM ev")
def _s1(spark, sf_dir):
    out = fresh_dir(spark)
    rows = event_stream(spark, sf_dir).select("event_id", "topic", "shard_id", F.unix_micros("ts").alias("ts_us"), "body")
    sinks.run_once(sinks.write_batches(rows, f"{out}/rows", f"{out}/state"))
    return spark.read.schema(rows.schema).parquet(f"{out}/rows/batch=*")


@query("s2_resolve_start", f"""WITH {LOG}, c AS (
  SELECT topic, shard_id, min("offset") AS first, max("offset") + 1 AS last,
    coalesce(max("offset" + 1) FILTER (NOT process_error), 0) AS committed FROM log GROUP BY topic, shard_id)
SELECT 'earliest' AS mode, topic, shard_id, CASE WHEN shard_id < 5 THEN committed ELSE first END AS start_at, shard_id < 5 AS from_commit FROM c
UNION ALL SELECT 'LATEST', topic, shard_id, CASE WHEN shard_id < 5 THEN committed ELSE last END, shard_id < 5 FROM c
UNION ALL SELECT '7', topic, shard_id, CASE WHEN shard_id < 5 THEN committed ELSE 7 END, shard_id < 5 FROM c""")
def _s2(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    claims = rows.groupBy("topic", "shard_id").agg(F.min("offset").alias("earliest"),
                                                   (F.max("offset") + 1).alias("latest"))
    commits = rows.filter((F.col("shard_id") < 5) & ~F.col("process_error")).groupBy("topic", "shard_id").agg(
        (F.max("offset") + 1).alias("committed")).withColumn("group", F.lit("g"))
    return streams.union_sources(*[
        streams.resolve_start(claims, commits, mode, "g").withColumn("mode", F.lit(mode))
        for mode in ("earliest", "LATEST", "7")])


def _stamps(items):
    """Stamps of an earlier run: some before, some at, some after the item's time."""
    return items.filter(F.col("__size") < 2000).select(
        "__name", (F.col("__mtime_secs") - F.col("doc_id") % 2).alias("secs"),
        (F.col("__mtime_nsecs") + F.when(F.col("doc_id") % 4 == 2, 1).otherwise(0)).alias("nsecs"))


@query("s3_poll_items", """WITH i AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS name, lang, n_chars AS size,
  1700000000 + n_chars AS secs, doc_id * 1000 % 1000000000 AS nsecs FROM documents)
SELECT name, secs, nsecs, size, lang FROM i WHERE (lang = 'en' OR lang = 'de') AND size > 100
  AND (size >= 2000 OR doc_id % 2 = 1)
UNION ALL SELECT 'first:' || name, secs, nsecs, size, lang FROM i WHERE lang = 'en' AND size > 100""")
def _s3(spark, sf_dir):
    items = item_rows(spark, sf_dir).withColumn("lang", F.col("attributes")["lang"])
    again = polling.poll_items(items, _stamps(items), suffixes=(".en", ".de"), predicates=("__size > 100",),
                               attributes=("lang",))
    first = polling.poll_items(items, None, suffixes=(".en",), predicates=("__size > 100",), attributes=("lang",))
    return again.unionByName(first.withColumn("__name", F.concat(F.lit("first:"), "__name"))).select(
        F.col("__name").alias("name"), F.col("__mtime_secs").alias("secs"), F.col("__mtime_nsecs").alias("nsecs"),
        F.col("__size").alias("size"), "lang")


@query("s3_poll_shards", """WITH i AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS name, n_chars AS size, 1700000000 + n_chars AS secs FROM documents)
SELECT name, secs, 1 AS pollers FROM i WHERE suffix(name, '.en') AND size > 100 AND (size >= 2000 OR doc_id % 2 = 1)""")
def _s3_shards(spark, sf_dir):
    items = item_rows(spark, sf_dir)
    stamps = _stamps(items)
    since = polling.poll_floor(items, stamps)
    parts = [polling.poll_items(items, stamps, suffixes=(".en",), predicates=("__size > 100",), shard=k, shards=5, since=since).withColumn("poller", F.lit(k)) for k in range(5)]
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("__name").alias("name"), F.col("__mtime_secs").alias("secs")).agg(
        F.countDistinct("poller").cast("int").alias("pollers"))


@query("s3_stamp_items", """WITH i AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS name,
  1700000000 + n_chars AS secs, doc_id * 1000 % 1000000000 AS nsecs, n_chars AS size FROM documents)
SELECT name, CASE WHEN doc_id % 5 <> 0 THEN 1800000000 + doc_id ELSE secs - doc_id % 2 END AS secs,
  CASE WHEN doc_id % 5 <> 0 THEN 5000 ELSE nsecs + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END END AS nsecs
FROM i WHERE doc_id % 5 <> 0 OR size < 2000""")
def _s3_stamps(spark, sf_dir):
    items = item_rows(spark, sf_dir)
    processed = items.select(
        "__name", F.timestamp_micros((F.lit(1_800_000_000) + F.col("doc_id")) * 1_000_000 + 5).alias("at"),
        F.when(F.col("doc_id") % 5 == 0, "failed").alias("error"))
    return polling.stamp_items(_stamps(items), processed).select(F.col("__name").alias("name"), "secs", "nsecs")


@query("s4_ticks", """WITH u AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id),
cal AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT max(ts) FROM events), INTERVAL 1 MINUTE)) AS t)
SELECT user_id, 'cron' AS how, epoch_us(t) AS tick_us FROM u JOIN cal ON t > lo AND t <= hi
WHERE minute(t) IN (0, 20, 40) AND hour(t) BETWEEN 6 AND 9 AND (day(t) IN (3, 9) OR dayofweek(t) IN (1, 5))
UNION ALL SELECT user_id, 'interval', epoch_us(lo) + n * 9000000000 FROM u, range(1, 100000) r(n) WHERE epoch_us(lo) + n * 9000000000 <= epoch_us(hi)""")
def _s4(spark, sf_dir):
    spans = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    cron = schedule.ticks_between(spans, "*/20 6-9 3,9 * mon,fri", "lo", "hi").withColumn("how", F.lit("cron"))
    fixed = schedule.ticks_between(spans, "2h30m", "lo", "hi").withColumn("how", F.lit("interval"))
    return cron.unionByName(fixed).select("user_id", "how", F.unix_micros("tick").alias("tick_us"))


@query("s5_missed_ticks", """WITH t AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_id, epoch_us(ts) AS u, epoch_us(now) AS n FROM events, t),
c AS (SELECT *, u - u % 900000000 + 900000000 AS nxt FROM r)
SELECT event_id, 'interval' AS how, greatest(CAST(ceil((n - u) / 60000000.0) AS BIGINT) - 2, 0) AS missed,
  CASE WHEN greatest(CAST(ceil((n - u) / 60000000.0) AS BIGINT) - 2, 0) > 0 THEN 0 ELSE u + 60000000 - n END AS delay_us, u + 60000000 AS next_us FROM r
UNION ALL SELECT event_id, 'cron', greatest((n - 1) // 900000000 - u // 900000000 - 1, 0),
  CASE WHEN greatest((n - 1) // 900000000 - u // 900000000 - 1, 0) > 0 THEN 0 ELSE nxt - n END, nxt FROM c""")
def _s5(spark, sf_dir):
    runs = events(spark, sf_dir).select("event_id", F.col("ts").alias("last_run"))
    now = runs.agg(F.max("last_run")).first()[0]
    fixed = schedule.missed_ticks(runs, "1m", now).withColumn("how", F.lit("interval"))
    cron = schedule.missed_ticks(runs, "*/15 * * * *", now).withColumn("how", F.lit("cron"))
    return fixed.unionByName(cron).select("event_id", "how", "missed", "delay_us",
                                          F.unix_micros("next_run").alias("next_us"))


@query("e6_normalize_schedule", """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM events)
SELECT epoch_us(t) AS ts_us, 'wake up' AS body, '/run' AS path, 'POST' AS method, 'v' AS h_k, 'cron' AS trigger_kind
FROM b, unnest(generate_series(lo, hi, INTERVAL 10 MINUTE)) AS g(t) WHERE t > lo""")
def _e6(spark, sf_dir):
    lo, hi = events(spark, sf_dir).agg(F.date_trunc("hour", F.min("ts")), F.max("ts")).first()
    out = E.normalize_schedule(schedule.ticks(spark, "*/10 * * * *", lo, hi), "wake up", {"k": "v"}, "/run", "POST")
    return out.select(F.unix_micros("ts").alias("ts_us"), F.col("body").cast("string").alias("body"), "path", "method",
                      F.col("headers")["k"].alias("h_k"), "trigger_kind")


ROUTES = (("all", "+/#"), ("clicks", "click/+/user"), ("shard3", "+/3/#"), ("views", "view/#"), ("views", "view/1/user"))
ROUTES_AMQP = (("all", "#"), ("clicks", "click.*.user"), ("three", "*.3.#"), ("users", "#.user"))


#: as many consumers of single users as there are subscriptions, and some by type and shard
MANY_ROUTES = [(f"c{i % 100}", f"+/+/{i}") for i in range(10_000)] + [("clicks", "click/#"), ("three", "+/3/#"), ("three", "click/3/7")]


@query("s6_route_by_trie", f"""WITH {EVENTS}
SELECT event_id, 'c' || user_id % 100 AS consumer FROM ev WHERE user_id < 10000
UNION ALL SELECT event_id, 'clicks' FROM ev WHERE topic = 'click' UNION ALL SELECT event_id, 'three' FROM ev WHERE shard_id = 3""")
def _s6_trie(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.concat_ws("/", "topic", F.col("shard_id").cast("string"), F.col("user_id").cast("string")).alias("topic"))
    return streams.route_by_trie(rows, MANY_ROUTES, "mqtt").select("event_id", "consumer")


@query("s6_route_by_topic", f"""WITH {EVENTS}
SELECT event_id, 'mqtt' AS syntax, 'all' AS consumer FROM ev
UNION ALL SELECT event_id, 'mqtt', 'clicks' FROM ev WHERE topic = 'click'
UNION ALL SELECT event_id, 'mqtt', 'shard3' FROM ev WHERE shard_id = 3
UNION ALL SELECT event_id, 'mqtt', 'views' FROM ev WHERE topic = 'view'
UNION ALL SELECT event_id, 'amqp', 'all' FROM ev
UNION ALL SELECT event_id, 'amqp', 'clicks' FROM ev WHERE topic = 'click'
UNION ALL SELECT event_id, 'amqp', 'three' FROM ev WHERE shard_id = 3
UNION ALL SELECT event_id, 'amqp', 'users' FROM ev
UNION ALL SELECT event_id, 'exact', 'a' FROM ev WHERE topic IN ('click', 'view')
UNION ALL SELECT event_id, 'exact', 'b' FROM ev WHERE topic = 'view'""")
def _s6(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "topic", "shard_id")
    parts = [F.col("topic"), F.col("shard_id").cast("string"), F.lit("user")]
    mqtt = streams.route_by_topic(rows.withColumn("topic", F.concat_ws("/", *parts)), ROUTES, "mqtt")
    amqp = streams.route_by_topic(rows.withColumn("topic", F.concat_ws(".", *parts)), ROUTES_AMQP, "amqp")
    exact = streams.route_by_topic(rows, (("a", "click"), ("a", "view"), ("b", "view")))
    return streams.union_sources(*[df.select("event_id", F.lit(n).alias("syntax"), "consumer")
                                   for n, df in (("mqtt", mqtt), ("amqp", amqp), ("exact", exact))])


@query("s7_union_sources", f"""WITH {EVENTS}
SELECT 'kafka-cluster' AS trigger_kind, 'k' AS trigger_name, topic AS path, body FROM ev
UNION ALL SELECT 'http', 'web', regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), html FROM pages
UNION ALL SELECT 'cron', 'text', CAST(NULL AS VARCHAR), text FROM conversations""")
def _s7(spark, sf_dir):
    kafka = E.to_envelope(events(spark, sf_dir), {"path": "topic", "body": "body"}, "kafka-cluster", "k")
    web = E.normalize_http_log(request_log(spark, sf_dir), "web")
    other = table(spark, sf_dir, "conversations").select(
        F.lit("cron").alias("trigger_kind"), F.lit("text").alias("trigger_name"), F.col("text").cast("binary").alias("body"))
    return streams.union_sources(kafka, web, other).select(
        "trigger_kind", "trigger_name", "path", F.col("body").cast("string").alias("body"))


@query("s8_run_once", f"WITH {EVENTS} SELECT topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ev GROUP BY topic")
def _s8(spark, sf_dir):
    out = fresh_dir(spark)
    rows = event_stream(spark, sf_dir).select("topic", "event_id")
    sinks.run_once(sinks.write_batches(rows, f"{out}/rows", f"{out}/state"))
    done = spark.read.schema(rows.schema).parquet(f"{out}/rows/batch=*")
    return done.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s9_record_events", f"""WITH {EVENTS}
SELECT body, topic AS h_topic, epoch_us(ts) AS ts_us FROM ev WHERE topic <> 'error' AND body <> '{{"k": 7}}'""")
def _s9(spark, sf_dir):
    out = fresh_dir(spark)
    kind = F.when(F.col("topic") == "error", "http").otherwise("kafka-cluster")
    rows = E.to_envelope(event_stream(spark, sf_dir), {
        "trigger_kind": kind, "body": "body", "ts": "ts", "headers": F.create_map(F.lit("topic"), F.col("topic"))},
        "kafka-cluster", "k")
    sinks.run_once(sinks.record_events(rows, f"{out}/rows", f"{out}/state"))
    return sinks.read_recorded(spark, f"{out}/rows", ignore='{"k": 7}').select(
        "body", F.col("headers")["topic"].alias("h_topic"), F.unix_micros("timestamp").alias("ts_us"))


@query("s10_forward", f"""WITH {EVENTS}
SELECT CAST(user_id AS VARCHAR) AS key, event_id, topic FROM ev WHERE NOT process_error""")
def _s10(spark, sf_dir):
    out = fresh_dir(spark)
    rows = event_stream(spark, sf_dir).filter(~F.col("process_error"))
    sinks.run_once(sinks.forward(rows, {"kind": "landing", "path": f"{out}/rows"}, ("event_id", "topic"),
                                 f"{out}/state", key="user_id"))
    sent = spark.read.schema("key string, value string").parquet(f"{out}/rows/batch=*")
    value = F.from_json("value", "event_id bigint, topic string")
    return sent.select("key", value["event_id"].alias("event_id"), value["topic"].alias("topic"))
