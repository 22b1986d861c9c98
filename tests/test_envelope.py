from __future__ import annotations

import base64
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventflow.functions.maps import field, header, last_wins_map
from eventflow.operators import envelope as E
from eventflow.schema import ENVELOPE

NOON = datetime(2024, 5, 6, 12, 0, 0, tzinfo=timezone.utc)


def one(spark, **values):
    """One envelope with the given attributes."""
    row = spark.range(1)
    mapping = {}
    for k, v in values.items():
        if isinstance(v, dict):
            mapping[k] = F.create_map(*[F.lit(str(x)) for p in v.items() for x in p])
        else:
            mapping[k] = F.lit(v)
    return E.to_envelope(row, mapping, values.get("trigger_kind", "test kind"), "test name")


def test_envelope_has_the_whole_layout(spark):
    df = one(spark, body="abc")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in ENVELOPE]
    row = df.first()
    assert row.size == 3 and row.headers == {} and row.topic is None


def test_encode_event(spark):
    df = one(spark, id="e-41", content_type="text/csv", body="pear;3\n", headers={"Shop": "north", "Till": 5},
             fields={"aisle": "fruit", "row": 18}, method="PUT", shard_id=3, num_shards=12, type="sale",
             type_version="4", version="1.2", ts=NOON, path="/p", url="u")
    doc = json.loads(E.encode_event(df).first().encoded)
    assert doc["body"] == base64.b64encode(b"pear;3\n").decode()
    assert doc["trigger"] == {"kind": "test kind", "name": "test name"}
    assert doc["headers"] == {"Shop": "north", "Till": "5"} and doc["fields"] == {"aisle": "fruit", "row": "18"}
    assert doc["timestamp"] == int(NOON.timestamp()) and doc["shard_id"] == 3 and doc["num_shards"] == 12
    assert (doc["type"], doc["type_version"], doc["version"]) == ("sale", "4", "1.2")
    assert doc["content_type"] == doc["content-type"] == "text/csv" and doc["method"] == "PUT"
    assert doc["size"] == len("pear;3\n") and doc["id"] == "e-41" and doc["topic"] == ""


STRUCTURED = {
    "cloudEventsVersion": "0.1", "eventType": "shop.sale", "eventTypeVersion": "3", "source": "/tills/5",
    "eventID": "sale-0017", "eventTime": "2024-05-06T12:00:00Z", "extensions": {"shopAisle": "fruit"},
    "contentType": "text/csv", "data": "pear;3"}


def cloud(spark, body, content_type="application/cloudevents+json", headers=None):
    return E.unwrap_cloudevents(one(spark, body=body, content_type=content_type, headers=headers or {}, path="/in",
                                    method="POST", id="mine", ts=datetime(2020, 1, 1)))


def test_structured_cloud_event(spark):
    row = cloud(spark, json.dumps(STRUCTURED)).first()
    assert bytes(row.body) == b"pear;3" and row.body_object is None
    assert row.trigger_kind == row.trigger_name == "/tills/5" and row.trigger_class == "unsupported"
    assert row.headers == {"shopAisle": "fruit"} and row.id == "sale-0017"
    assert (row.type, row.type_version, row.version, row.content_type) == (
        "shop.sale", "3", "0.1", "text/csv")
    assert (row.path, row.method, row.decode_error) == ("/in", "POST", None)


def test_structured_cloud_event_with_object(spark):
    df = cloud(spark, json.dumps({**STRUCTURED, "data": {"a": "b", "c": 1}}))
    row = df.select("body", F.to_json("body_object").alias("o")).first()
    assert row.body is None and json.loads(row.o) == {"a": "b", "c": 1}
    assert json.loads(E.encode_event(df).first().encoded)["body"] == {"a": "b", "c": 1}


def test_broken_structured_cloud_events(spark):
    for body in ("{nope", json.dumps({**STRUCTURED, "eventTime": "yesterday"})):
        row = cloud(spark, body).first()
        assert row.decode_error and row.id == "mine" and row.trigger_class == "async"


def test_binary_cloud_event(spark):
    headers = {"CE-EventID": "A234", "CE-Source": "/tills/5", "CE-EventTime": "2024-05-06T12:00:00Z",
               "CE-EventType": "t", "CE-EventTypeVersion": "1.0", "CE-CloudEventsVersion": "0.1"}
    row = cloud(spark, "kept", "text/plain", headers).select(
        "*", F.unix_seconds("ts").alias("at")).first()
    assert bytes(row.body) == b"kept" and row.id == "A234" and row.trigger_kind == "/tills/5" and row.version == "0.1"
    assert row.at == int(NOON.timestamp()) and row.headers == headers
    late = cloud(spark, "kept", "text/plain", {**headers, "CE-EventTime": "soon"}).first()
    assert late.ts is None
    plain = cloud(spark, "kept", "text/plain", {**headers, "CE-CloudEventsVersion": ""}).first()
    assert plain.id == "mine" and plain.trigger_class == "async"


def test_decode_results(spark):
    result = {"body": "123", "content_type": "123", "headers": {}, "status_code": 200, "body_encoding": "text"}
    texts = [json.dumps(result), json.dumps([result]), json.dumps([result, {**result, "body_encoding": "base64", "body": "MTIz"}]),
             json.dumps({**result, "body_encoding": "zip"}), "not json", "[]", "null"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, data string")
    got = {}
    for r in E.decode_results(df).collect():
        got.setdefault(r.i, []).append(r)
    assert [len(got[i]) for i in range(5)] == [1, 1, 2, 1, 1]
    assert all(bytes(r.decoded_body) == bytes([49, 50, 51]) and r.result_error is None for i in range(3) for r in got[i])
    assert got[3][0].result_error == 'Unknown body encoding - "zip"' and got[4][0].result_error


def test_last_header_wins(spark):
    df = spark.sql("SELECT array(struct('a' AS key, '1' AS value), struct('b' AS key, '2' AS value), "
                   "struct('a' AS key, '3' AS value)) AS h, cast(null AS array<struct<key:string,value:string>>) AS n")
    row = df.select(last_wins_map(F.col("h.key"), F.col("h.value")).alias("h"), last_wins_map(F.col("n.key"), F.col("n.value")).alias("n"),
                    last_wins_map(F.array(F.lit("x")), F.array(F.lit("y"))).alias("o")).first()
    assert row.h == {"a": "3", "b": "2"} and row.n == {} and row.o == {"x": "y"}


def test_http_request(spark):
    df = spark.createDataFrame([("GET", u, {"Content-Type": "a/b"}, b"", NOON) for u in (
        "http://h/p?x=1&y=a%20b&x=2", "http://h", "http://h/q?flag&=z")],
        "method string, url string, headers map<string,string>, body binary, ts timestamp")
    rows = E.normalize_http_log(df).select("path", "fields", "content_type").collect()
    assert rows[0].path == "/p" and rows[0].fields == {"x": "2", "y": "a b"} and rows[0].content_type == "a/b"
    assert rows[1].path == "/" and rows[1].fields == {}
    assert rows[2].fields == {"flag": "", "": "z"}


def test_typed_access_and_ids(spark):
    df = one(spark, headers={"n": 12, "t": "x"}, fields={"f": "9"}, id="", topic="t", shard_id=1, offset=5)
    row = df.select(header("n", "int").alias("n"), header("t", "int").alias("t"), header("q").alias("q"),
                    header("t", "bytes").alias("b"), field("f", "int").alias("f")).first()
    assert (row.n, row.t, row.q, bytes(row.b), row.f) == (12, None, "", b"x", 9)
    first, again = E.ensure_id(df).first().id, E.ensure_id(df).first().id
    assert first == again and len(first) == 64
    assert E.ensure_id(df, deterministic=False).first().id != first


def test_schedule_event(spark):
    ticks = spark.createDataFrame([(NOON,)], "tick timestamp")
    row = E.normalize_schedule(ticks, "b", {"h": "v"}, "/p", "PUT").first()
    assert bytes(row.body) == b"b" and row.headers == {"h": "v"} and (row.path, row.method) == ("/p", "PUT")
    assert row.trigger_kind == "cron" and row.ts is not None


def test_ids_without_position_differ(spark):
    from eventflow.operators.envelope import ensure_id, normalize_http_log, normalize_schedule

    calls = spark.range(50).select(F.lit("GET").alias("method"), F.lit("http://h/p").alias("url"), F.expr("map('content-TYPE', 'a/b')").alias("headers"),
                                   F.lit(b"x").alias("body"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    events = ensure_id(normalize_http_log(calls))
    assert events.select("id").distinct().count() == 50 and events.first().content_type == "a/b"
    ticks = ensure_id(normalize_schedule(spark.range(20).select(F.timestamp_seconds(F.lit(0)).alias("tick"))))
    assert ticks.select("id").distinct().count() == 20


def test_documents_that_are_no_objects(spark):
    from eventflow.operators.envelope import decode_results, to_envelope, unwrap_cloudevents

    rows = spark.createDataFrame([("5",), ('"abc"',), ("[1]",), ('{"status_code": "abc", "body": "b", "body_encoding": "text"}',),
                                  ('{"status_code": 201, "body": "b", "body_encoding": "text"}',)], "data string")
    got = [(r.status_code, r.result_error is None) for r in decode_results(rows).collect()]
    assert got == [(None, False)] * 4 + [(201, True)]
    events = to_envelope(rows, {"body": F.col("data").cast("binary"), "content_type": F.lit("application/cloudevents+json")}, "http", "h")
    assert [r.decode_error is None for r in unwrap_cloudevents(events).collect()] == [False, False, False, True, True]
