"""Event layout and decoding over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions.maps import empty_map, field, header
from eventflow.operators import envelope as E
from eventflow.plans import query
from eventflow.plans.tables import EVENTS, LOG, event_log, events, table

TEXT = "CAST(body AS STRING) AS body"


@query("e1_to_envelope", f"""WITH {EVENTS}
SELECT CAST(event_id AS VARCHAR) AS id, 'kafka-cluster' AS trigger_kind, 'clicks' AS trigger_name,
  'async' AS trigger_class, topic, shard_id, 8 AS num_shards, epoch_us(ts) AS ts_us,
  CAST(strlen(body) AS BIGINT) AS size, body, 0 AS n_headers, CAST(NULL AS VARCHAR) AS method FROM ev""")
def _e1(spark, sf_dir):
    out = E.to_envelope(events(spark, sf_dir), {
        "id": "event_id", "topic": "topic", "shard_id": "shard_id", "num_shards": F.lit(8), "ts": "ts",
        "body": "body"}, "kafka-cluster", "clicks")
    return out.select("id", "trigger_kind", "trigger_name", "trigger_class", "topic", "shard_id", "num_shards",
                      F.unix_micros("ts").alias("ts_us"), "size", F.expr(TEXT),
                      F.size("headers").alias("n_headers"), "method")


def kafka_records(spark, sf_dir):
    """The event log as rows of a Kafka source, with one header key given twice."""
    def pair(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").cast("binary").alias("value"))

    return event_log(spark, sf_dir).select(
        F.col("user_id").cast("string").cast("binary").alias("key"), F.col("body").cast("binary").alias("value"),
        "topic", F.col("shard_id").alias("partition"), "offset", F.col("ts").alias("timestamp"),
        F.array(pair("user", F.col("user_id")), pair("status", F.col("status_code")),
                pair("user", F.concat(F.lit("u"), F.col("event_id").cast("string")))).alias("headers"))


@query("e2_normalize_kafka", f"""WITH {LOG}
SELECT topic, topic AS path, shard_id, "offset", epoch_us(ts) AS ts_us, body,
  'u' || event_id AS h_user, CAST(status_code AS VARCHAR) AS h_status, 2 AS n_headers FROM log""")
def _e2(spark, sf_dir):
    return E.normalize_kafka(kafka_records(spark, sf_dir)).select(
        "topic", "path", "shard_id", "offset", F.unix_micros("ts").alias("ts_us"), F.expr(TEXT),
        F.col("headers")["user"].alias("h_user"), F.col("headers")["status"].alias("h_status"),
        F.size("headers").alias("n_headers"))


@query("e3_normalize_shard_records", f"""WITH {EVENTS}
SELECT 'shard-stream' AS kind, event_id AS "offset", '/streams/' || topic AS topic, shard_id, epoch_us(ts) AS ts_us, body FROM ev
UNION ALL SELECT 'kinesis', NULL, NULL, NULL, NULL, body FROM ev
UNION ALL SELECT 'eventhub', event_id, NULL, shard_id, NULL, body FROM ev""")
def _e3(spark, sf_dir):
    source = events(spark, sf_dir)
    micros = F.unix_micros("ts")
    records = source.select(
        F.concat(F.lit("/streams/"), "topic").alias("stream_path"), "shard_id",
        F.col("event_id").alias("sequence"), F.floor(micros / 1_000_000).cast("bigint").alias("arrival_sec"),
        ((micros % 1_000_000) * 1000 + 7).alias("arrival_nsec"), F.col("body").cast("binary").alias("data"))
    sections = source.select("shard_id", F.col("event_id").alias("sequence"),
                             F.array(F.col("body").cast("binary"), F.lit("more").cast("binary")).alias("data"))
    out = (E.normalize_shard_records(records, "shard-stream")
           .unionByName(E.normalize_shard_records(records.select("data"), "kinesis"))
           .unionByName(E.normalize_shard_records(sections, "eventhub")))
    return out.select(F.col("trigger_kind").alias("kind"), "offset", "topic", "shard_id",
                      F.unix_micros("ts").alias("ts_us"), F.expr(TEXT))


@query("e4_normalize_queue", f"""WITH {EVENTS}
SELECT 'rabbit-mq' AS kind, 'm' || event_id AS id, topic AS method, 'ex/' || shard_id AS path,
  'reply-' || topic AS url, CAST(user_id AS VARCHAR) AS h_user, body FROM ev
UNION ALL SELECT 'mqtt', 'm' || event_id, NULL, topic, 'tcp://broker:1883', NULL, body FROM ev
UNION ALL SELECT 'nats', NULL, NULL, 'sub.' || topic, NULL, CAST(user_id AS VARCHAR), body FROM ev
UNION ALL SELECT 'pubsub', NULL, NULL, topic, topic, CAST(user_id AS VARCHAR), body FROM ev""")
def _e4(spark, sf_dir):
    messages = events(spark, sf_dir).select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.col("topic").alias("type"),
        F.lit("ex").alias("exchange"), F.col("shard_id").cast("string").alias("routing_key"),
        F.concat(F.lit("reply-"), "topic").alias("reply_to"), "topic", F.concat(F.lit("sub."), "topic").alias("subject"),
        F.lit("application/json").alias("content_type"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("headers"),
        F.col("body").cast("binary").alias("payload"), "ts")
    out = None
    for kind in ("rabbit-mq", "mqtt", "nats", "pubsub"):
        part = E.normalize_queue(messages, kind, url="tcp://broker:1883")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("trigger_kind").alias("kind"), "id", "method", "path", "url",
                      F.col("headers")["user"].alias("h_user"), F.expr(TEXT))


def request_log(spark, sf_dir):
    """The pages as request log rows."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), "url",
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        F.col("html").cast("binary").alias("body"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("ts"))


@query("e5_normalize_http_log", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, 'text/html' AS content_type,
  coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS f_page,
  coalesce(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS f_ref,
  CAST(strlen(html) AS BIGINT) AS size, 'sync' AS trigger_class FROM pages""")
def _e5(spark, sf_dir):
    return E.normalize_http_log(request_log(spark, sf_dir), keep=("page_id",)).select(
        "page_id", "method", "path", "content_type", field("page").alias("f_page"), field("ref").alias("f_ref"),
        "size", "trigger_class")


def item_rows(spark, sf_dir):
    """The documents as items of a polled table."""
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("__name"),
        (F.lit(1_700_000_000) + F.col("n_chars")).alias("__mtime_secs"),
        (F.col("doc_id") * 1000 % 1_000_000_000).alias("__mtime_nsecs"), F.lit("file").alias("__obj_type"),
        F.col("n_chars").alias("__size"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("doc"), F.col("doc_id").cast("string")).alias("attributes"),
        "doc_id")


@query("e7_normalize_items", """
SELECT doc_id, lang AS h_lang, CAST(n_chars AS VARCHAR) AS h_size, n_chars AS size, source || '/' || doc_id || '.' || lang AS path,
  (1700000000 + n_chars) * 1000000 + (doc_id * 1000 % 1000000000) // 1000 AS ts_us, 'batch' AS trigger_class
FROM documents""")
def _e7(spark, sf_dir):
    return E.normalize_items(item_rows(spark, sf_dir), keep=("doc_id",)).select(
        "doc_id", header("lang").alias("h_lang"), header("__size").alias("h_size"), "size", "path", F.unix_micros("ts").alias("ts_us"), "trigger_class")


def _plain_event(spark, sf_dir, **attributes):
    return E.to_envelope(events(spark, sf_dir), {
        "id": F.concat(F.lit("P-"), F.col("event_id").cast("string")), "path": F.lit("/in"), "ts": "ts", **attributes},
        "http", "web", keep=("event_id",))


def _unwrapped(rows):
    return E.unwrap_cloudevents(rows).select(
        "event_id", "id", "trigger_kind", "trigger_class", "content_type", "type", "version", "path", "decode_error",
        F.unix_micros("ts").alias("ts_us"), F.size("headers").alias("n_headers"), F.expr(TEXT))


@query("e8_structured_cloudevents", f"""WITH {EVENTS}
SELECT event_id, CASE WHEN bad THEN 'P-' ELSE 'A-' END || event_id AS id,
  CASE WHEN bad THEN 'http' ELSE '/users/' || user_id END AS trigger_kind,
  CASE WHEN bad THEN 'async' ELSE 'unsupported' END AS trigger_class,
  CASE WHEN bad THEN 'application/cloudevents+json' ELSE 'text/xml' END AS content_type,
  CASE WHEN bad THEN NULL ELSE topic END AS type, CASE WHEN bad THEN NULL ELSE '0.1' END AS version, '/in' AS path,
  CASE WHEN bad THEN 'Failed to wrap structured cloud event' END AS decode_error,
  CASE WHEN bad THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
  CASE WHEN bad THEN 0 ELSE 1 END AS n_headers,
  CASE WHEN bad THEN '{{broken' ELSE 'data of ' || topic END AS body
FROM (SELECT *, process_error AS bad FROM ev)""")
def _e8(spark, sf_dir):
    document = F.to_json(F.struct(
        F.lit("0.1").alias("cloudEventsVersion"), F.col("topic").alias("eventType"), F.lit("1.0").alias("eventTypeVersion"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("A-"), F.col("event_id").cast("string")).alias("eventID"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.lit("text/xml").alias("contentType"),
        F.create_map(F.lit("ext"), F.col("topic")).alias("extensions"),
        F.concat(F.lit("data of "), "topic").alias("data")))
    return _unwrapped(_plain_event(spark, sf_dir, content_type=F.lit("application/cloudevents+json"),
                                   body=F.when(F.col("process_error"), "{broken").otherwise(document)))


@query("e9_binary_cloudevents", f"""WITH {EVENTS}
SELECT event_id, CASE WHEN ce THEN 'B-' ELSE 'P-' END || event_id AS id,
  CASE WHEN ce THEN '/users/' || user_id ELSE 'http' END AS trigger_kind,
  CASE WHEN ce THEN 'unsupported' ELSE 'async' END AS trigger_class, 'application/json' AS content_type,
  CASE WHEN ce THEN topic END AS type, CASE WHEN ce THEN '0.1' END AS version, '/in' AS path,
  CAST(NULL AS VARCHAR) AS decode_error,
  CASE WHEN NOT ce THEN epoch_us(ts) WHEN process_error THEN NULL
       ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
  CASE WHEN ce THEN 6 ELSE 0 END AS n_headers, body
FROM (SELECT *, topic <> 'error' AS ce FROM ev)""")
def _e9(spark, sf_dir):
    time_text = F.when(F.col("process_error"), "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    headers = F.create_map(
        F.lit("CE-EventID"), F.concat(F.lit("B-"), F.col("event_id").cast("string")),
        F.lit("CE-Source"), F.concat(F.lit("/users/"), F.col("user_id").cast("string")),
        F.lit("CE-EventTime"), time_text, F.lit("CE-EventType"), F.col("topic"),
        F.lit("CE-EventTypeVersion"), F.lit("1.0"), F.lit("CE-CloudEventsVersion"), F.lit("0.1"))
    return _unwrapped(_plain_event(spark, sf_dir, content_type=F.lit("application/json"), body="body",
                                   headers=F.when(F.col("topic") != "error", headers)))


@query("e10_ids_without_position", """SELECT 'http' AS kind, count(*) AS n, count(*) AS ids FROM pages
UNION ALL SELECT 'cron', count(*), count(*) FROM events UNION ALL SELECT 'queue', count(*), count(*) FROM events""")
def _e10_fresh(spark, sf_dir):
    """Requests, ticks and queue messages have no position; all of them carry the same content here."""
    calls = table(spark, sf_dir, "pages").select(F.lit("GET").alias("method"), F.lit("http://h/p").alias("url"), empty_map().alias("headers"),
                                                 F.lit(b"").alias("body"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    ticks = table(spark, sf_dir, "events").select(F.timestamp_seconds(F.lit(0)).alias("tick"))
    queue = E.to_envelope(ticks, {"ts": "tick", "topic": F.lit("q")}, "nats", "q")
    out = None
    for kind, rows in (("http", E.normalize_http_log(calls)), ("cron", E.normalize_schedule(ticks)), ("queue", queue)):
        part = E.ensure_id(rows).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("e10_ensure_id", f"""WITH {EVENTS}
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'id-' || event_id
  ELSE sha256(topic || '/' || shard_id || '/' || event_id) END AS id FROM ev""")
def _e10(spark, sf_dir):
    n = F.col("event_id") % 3
    rows = events(spark, sf_dir).select(
        "event_id", "topic", "shard_id", F.col("event_id").alias("offset"),
        F.when(n == 0, F.concat(F.lit("id-"), F.col("event_id").cast("string"))).when(n == 1, F.lit("")).alias("id"))
    return E.ensure_id(rows).select("event_id", "id")


@query("e11_encode_event", f"""WITH {EVENTS}
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN obj THEN NULL ELSE to_base64(encode(body)) END AS body,
  CASE WHEN obj THEN CAST(json_extract_string(body, '$.k') AS VARCHAR) END AS object_k,
  CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, 'kafka-cluster' AS kind, 'clicks' AS name, topic,
  shard_id, CAST(user_id AS VARCHAR) AS h_user
FROM (SELECT *, event_id % 2 = 0 AS obj FROM ev)""")
def _e11(spark, sf_dir):
    rows = E.to_envelope(events(spark, sf_dir), {
        "id": "event_id", "topic": "topic", "shard_id": "shard_id", "ts": "ts", "body": "body",
        "headers": F.create_map(F.lit("user"), F.col("user_id").cast("string")),
        "body_object": F.when(F.col("event_id") % 2 == 0, F.try_parse_json("body"))}, "kafka-cluster", "clicks")
    doc = F.parse_json("encoded")

    def get(path, kind="string"):
        return F.try_variant_get("doc", path, kind)

    object_k = get("$.body.k")
    return E.encode_event(rows).select(doc.alias("doc")).select(
        get("$.id").alias("id"), F.when(object_k.isNull(), get("$.body")).alias("body"),
        object_k.alias("object_k"), get("$.timestamp", "bigint").alias("seconds"), get("$.trigger.kind").alias("kind"),
        get("$.trigger.name").alias("name"), get("$.topic").alias("topic"), get("$.shard_id", "int").alias("shard_id"),
        get("$.headers.user").alias("h_user"))


@query("e12_typed_access", f"""WITH {EVENTS}
SELECT event_id, topic AS as_text, user_id AS as_int, CAST(NULL AS BIGINT) AS not_int, '' AS absent_text,
  CAST(strlen(topic) AS INTEGER) AS n_bytes, CAST(NULL AS BIGINT) AS absent_int FROM ev""")
def _e12(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.create_map(
        F.lit("kind"), F.col("topic"), F.lit("user"), F.col("user_id").cast("string")).alias("headers"))
    return rows.select("event_id", header("kind").alias("as_text"), header("user", "int").alias("as_int"),
                       header("kind", "int").alias("not_int"), header("none").alias("absent_text"),
                       F.octet_length(header("kind", "bytes")).alias("n_bytes"),
                       header("none", "int").alias("absent_int"))


@query("e13_decode_results", f"""WITH {EVENTS}
SELECT event_id, 200 AS status_code, 'text' AS body_encoding, body AS decoded, CAST(NULL AS VARCHAR) AS result_error
FROM ev WHERE event_id % 5 IN (0, 1)
UNION ALL SELECT event_id, 201, 'base64', topic, NULL FROM ev WHERE event_id % 5 IN (1, 2)
UNION ALL SELECT event_id, 200, 'gzip', NULL, 'Unknown body encoding - "gzip"' FROM ev WHERE event_id % 5 = 3
UNION ALL SELECT event_id, NULL, NULL, NULL, 'Failed to unmarshal result' FROM ev WHERE event_id % 5 = 4""")
def _e13(spark, sf_dir):
    n = F.col("event_id") % 5

    def result(body, encoding, status):
        return F.struct(body.alias("body"), F.lit("text/plain").alias("content_type"),
                        F.create_map(F.lit("h"), F.lit("v")).alias("headers"), F.lit(status).alias("status_code"),
                        F.lit(encoding).alias("body_encoding"))

    plain = result(F.col("body"), "text", 200)
    coded = result(F.base64(F.col("topic").cast("binary")), "base64", 201)
    rows = events(spark, sf_dir).select("event_id", (
        F.when(n == 0, F.to_json(plain)).when(n == 1, F.to_json(F.array(plain, coded)))
        .when(n == 2, F.to_json(F.array(coded))).when(n == 3, F.to_json(result(F.col("body"), "gzip", 200)))
        .otherwise(F.lit("[{not json"))).alias("data"))
    return E.decode_results(rows).select("event_id", "status_code", "body_encoding",
                                         F.col("decoded_body").cast("string").alias("decoded"), "result_error")
