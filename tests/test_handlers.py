from __future__ import annotations

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from eventflow.functions import library as lib
from eventflow.operators import handlers as H
from eventflow.operators.batching import assign_batches
from eventflow.operators.envelope import to_envelope


def requests(spark, bodies, **more):
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "id string, body string")
    mapping = {"id": "id", "body": "body", "path": F.lit("/some/path"), "method": F.lit("POST"), "topic": F.lit("t"),
               "ts": F.timestamp_seconds(F.col("id").cast("long")), **more}
    return to_envelope(df, mapping, "http", "web")


# what a handler answers for each body, and what must come of it: status, content type, body
ANSWERS = {
    "plain": (lambda e: "warm", (200, "text/plain", "warm")),
    "raw": (lambda e: b"\x00\x01", (200, "text/plain", "\x00\x01")),
    "nothing": (lambda e: None, (200, "text/plain", "")),
    "object": (lambda e: {"degrees": 21, "at": e.topic}, (200, "application/json", '{"degrees": 21, "at": "t"}')),
    "number": (lambda e: 7.5, (200, "text/plain", "7.5")),
    "accepted": (lambda e: (202, "queued"), (202, "text/plain", "queued")),
    "teapot": (lambda e: (418, {"kind": "pot"}), (418, "application/json", '{"kind": "pot"}')),
    "whole": (lambda e: H.Response("<i/>", 207, "text/xml", {"x-one": "1"}), (207, "text/xml", "<i/>")),
    "where": (lambda e: f"{e.method} {e.path}?{e.fields['unit']}", (200, "text/plain", "POST /some/path?kelvin")),
    "broken": (lambda e: 1 / 0, (500, "text/plain", None)),
}


def test_answers_of_every_shape(spark):
    bodies = [*ANSWERS, "several", "unknown"]
    table = {k: v[0] for k, v in ANSWERS.items()} | {"several": lambda e: ["left", "right"]}
    fields = F.create_map(F.lit("unit"), F.lit("kelvin"))
    got = {}
    for r in H.map_handler(requests(spark, bodies, fields=fields), lambda c, e: table[e.body.decode()](e)).collect():
        got.setdefault(bodies[int(r.event_id)], []).append(r)
    for name, (_, (status, kind, body)) in ANSWERS.items():
        (row,) = got[name]
        assert row.status_code == status
        if body is not None:
            assert (row.content_type, bytes(row.body).decode()) == (kind, body)
    assert "division" in bytes(got["broken"][0].body).decode() and got["unknown"][0].status_code == 500
    assert got["whole"][0].headers == {"x-one": "1"} and got["plain"][0].headers == {}
    assert sorted(bytes(r.body) for r in got["several"]) == [b"left", b"right"]


def test_shared_answers_stay_as_they_are(spark):
    shared = H.Response("same")
    rows = H.map_handler(requests(spark, ["a", "b", "c"]).coalesce(1), lambda c, e: (404, shared) if e.id == "0" else shared).collect()
    assert sorted((r.event_id, r.status_code) for r in rows) == [("0", 404), ("1", 200), ("2", 200)]


def test_one_loop_per_task(spark):
    async def init(context):
        context.user_data["loop"] = asyncio.get_running_loop()

    async def handler(context, event):
        return str(context.user_data["loop"] is asyncio.get_running_loop())

    rows = H.map_handler(requests(spark, ["a", "b"]), handler, init).collect()
    assert [bytes(r.body) for r in rows] == [b"True", b"True"]


def test_context_coroutines_and_no_ack(spark):
    def init(context):
        context.user_data["n"] = 0

    async def handler(context, event):
        context.user_data["n"] += 1
        await asyncio.sleep(0)
        headers = {H.NO_ACK_HEADER: True} if event.id == "0" else {H.NO_ACK_HEADER: "true"}
        return H.Response(str(context.user_data["n"]), headers=headers)

    rows = H.map_handler(requests(spark, ["a"] * 6).coalesce(1), handler, init).collect()
    assert [bytes(r.body).decode() for r in sorted(rows, key=lambda r: int(r.event_id))] == list("123456")
    assert {r.event_id: r.no_ack for r in rows} == {**{str(i): False for i in range(6)}, "0": True}


def test_durations_feed_the_counters(spark):
    import time as clock

    from eventflow.operators.metrics import durations

    rows = H.map_handler(requests(spark, ["a", "b"]), lambda c, e: clock.sleep(0.02), keep=("topic",))
    total = durations(rows, ("topic",)).first()
    assert total.duration_ms_count == 2 and 40 <= total.duration_ms_sum < 2000


def test_object_bodies_and_kept_columns(spark):
    df = requests(spark, ['{"a": [1, 2]}'], body_object=F.try_parse_json("body")).withColumn("extra", F.lit(7))
    row = H.map_handler(df, lambda c, e: {"got": e.body["a"]}, keep=("extra",)).first()
    assert json.loads(bytes(row.body)) == {"got": [1, 2]} and row.extra == 7


def test_batch_of_two(spark):
    df = requests(spark, ["hello-0", "hello-1", "hello-2"]).withColumn("k", F.lit("k")).withColumn("i", F.col("id").cast("long"))
    batches = assign_batches(df, ["k"], "ts", ["i"], 2, "1m")
    seen = H.map_batches(batches, lambda c, events: [H.Response("Response to in-batch event", event_id=e.id) for e in events])
    rows = sorted(seen.collect(), key=lambda r: r.event_id)
    assert [(r.event_id, r.status_code, bytes(r.body).decode(), r.answer_no) for r in rows] == [
        (str(i), 200, "Response to in-batch event", i % 2) for i in range(3)]
    assert len({r.batch_id for r in rows}) == 2


def test_correlation(spark):
    events = spark.createDataFrame([("b", x) for x in "abcde"] + [("bad", "z")], "batch_id string, event_id string")
    responses = spark.createDataFrame(
        [("b", "a", 200, None, 0), ("b", "a", 500, "later", 1), ("b", "b", 500, "boom", 2), ("b", "", 200, None, 3),
         ("b", None, 200, None, 4), ("b", "unknown", 200, None, 5), ("b", "d", 404, None, 6), ("bad", None, 500, "all of it", 0)],
        "batch_id string, event_id string, status_code int, error string, answer_no int")
    got = {r.event_id: (r.outcome, r.status_code) for r in H.correlate(events, responses).collect()}
    assert got == {"a": ("success", 200), "b": ("failure", 500), "c": ("no_response", None), "d": ("success", 404),
                   "e": ("no_response", None), "z": ("failure", None), "unknown": ("orphan", 200)}


def test_whole_batch_error(spark):
    df = requests(spark, ["x", "y"]).withColumns({"batch_id": F.lit("b"), "pos": F.col("id").cast("int")})

    def fails(context, events):
        raise ValueError("no")

    responses = H.map_batches(df, fails)
    events = df.select("batch_id", F.col("id").alias("event_id"))
    assert {r.outcome for r in H.correlate(events, responses).collect()} == {"failure"}


def test_one_bad_item_fails_its_call(spark):
    df = requests(spark, ["x", "y"]).withColumns({"batch_id": F.lit("b"), "pos": F.col("id").cast("int")})

    def half(context, given):
        return ["fine", {"set": {1}}]

    for rows in (H.map_batches(df, half).collect(), H.map_handler(df.filter("id = '0'"), half).collect()):
        assert len(rows) == 1 and rows[0].status_code == 500 and rows[0].error


def test_shell(spark):
    df = requests(spark, ["upper me", "b"])
    up = H.shell_handler(df, "tr", ["a-z", "A-Z"]).collect()
    assert {bytes(r.body).decode() for r in up} == {"UPPER ME", "B"}
    env = H.shell_handler(df, "printenv", ["EVENT_PATH", "EVENT_TRIGGER_KIND", "EVENT_TIMESTAMP", "MINE"], env={"MINE": "x"},
                          response_headers={"h": "v"}).orderBy("event_id").first()
    assert bytes(env.body).decode().split() == ["/some/path", "http", "1970-01-01T00:00:00Z", "x"] and env.headers == {"h": "v"}
    bad = H.shell_handler(df, "ls", ["/does/not/exist"]).first()
    assert bad.status_code == 500 and "exist" in bytes(bad.body).decode()
    late = H.shell_handler(df, "sleep", ["20"], timeout=0.2).first()
    assert late.status_code == 408
    nested = requests(spark, ['{"a": 1}'], body_object=F.try_parse_json("body"))
    assert json.loads(bytes(H.shell_handler(nested, "cat").first().body)) == {"a": 1}
    missing = H.shell_handler(df, "no-such-program").first()
    assert missing.status_code == 500
    # the text is an argument, not a script
    quoted = H.shell_handler(df, "echo", ["$(id); ls"]).first()
    assert bytes(quoted.body).decode().strip() == "$(id); ls"
    headed = df.withColumn("headers", F.create_map(F.lit("X-Args"), F.lit("a-z B")))
    assert bytes(H.shell_handler(headed, "tr", ["x", "y"], arguments_header="X-Args").orderBy("event_id").first().body) == b"BBBBB BB"


def fibonacci(context, event):
    a, b = 0, 1
    for _ in range(int(event.body)):
        a, b = b, a + b
    return str(a)


def fibonacci_sum(context, event):
    return str(sum(int(context.call("fibonacci", H.Event(body=str(n))).body) for n in (2, 10, 17)))


def test_handler_calls_handler(spark):
    out = H.call(requests(spark, ["go"]), {"fibonacci": fibonacci, "sum": fibonacci_sum}, "sum").first()
    assert bytes(out.body).decode() == "1653"


def test_statuses_and_timeouts(spark):
    df = spark.createDataFrame([("No available workers", None, None, None, 503), ("x", None, None, None, 500),
                                (None, "e", 404, None, 404), (None, "e", None, 201, 500), (None, None, None, 201, 201),
                                (None, None, None, None, 200)],
                               "submit_error string, process_error string, error_status int, status_code int, want int")
    assert all(r.status_code == r.want for r in H.with_status(df).collect())
    late = spark.createDataFrame([(1, 99, 200, "ok"), (2, 101, 200, "ok"), (3, 100, 500, "bad")],
                                 "id int, duration_ms long, status_code int, outcome string")
    got = {r.id: (r.status_code, r.outcome) for r in H.apply_timeout(late, "100ms").collect()}
    assert got == {1: (200, "ok"), 2: (408, "timeout"), 3: (500, "bad")}


@pytest.mark.parametrize("method,origin,wanted,asked,size,want", [
    ("OPTIONS", "foo.bar", "GET", "", 0, (True, None, 200)),
    ("OPTIONS", "baz.bar", "GET", "", 0, (False, "origin", 400)),
    ("OPTIONS", "foo.bar", "GET", "Not-supported-header", 0, (False, "headers", 400)),
    ("OPTIONS", "FOO.BAR", "get", "accept, AUTHORIZATION", 0, (True, None, 200)),
    ("OPTIONS", "foo.bar", "TRACE", "", 0, (False, "method", 400)),
    ("OPTIONS", "foo.bar", "", "", 0, (True, None, None)),
    ("GET", "foo.bar", "", "", 0, (True, None, None)),
    ("GET", "baz.bar", "", "", 0, (False, "origin", None)),
    ("GET", "", "", "", 0, (False, "origin", None)),
    ("POST", "foo.bar", "", "", 11, (False, "body", 413))])
def test_admission(spark, method, origin, wanted, asked, size, want):
    df = spark.createDataFrame([(method, {"Origin": origin, "Access-Control-Request-Method": wanted,
                                          "Access-Control-Request-Headers": asked}, b"x" * size)],
                               "method string, headers map<string,string>, body binary")
    row = H.admit(df, H.Cors(origins=("foo.bar",)), 10).first()
    assert (row.admitted, row.reason, row.status) == want
    assert H.admit(df, None, 10).first().admitted == (size <= 10)


def test_library(spark):
    texts = ["ssn 123-45-6789", "card 4111 1111 1111 1111 and 000-11-2222", "none", "1234-56"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.found for r in lib.scan_patterns(df, "text").collect()] == [["SSN"], ["Credit card", "SSN"], [], []]
    slugs = spark.createDataFrame([(" Hello, World! ",), ("--a--B__c--",), ("",)], "t string")
    assert [r.slug for r in lib.slugify(slugs, "t").collect()] == ["hello-world", "a-b-c", ""]
    fields = spark.sql("SELECT map('y', '2', 'x', '1') AS fields")
    assert lib.render_fields(fields).first().rendered == "x=1,y=2"


def test_key_stays_out_of_plans(spark):
    import base64

    key = base64.b64encode(b"0123456789abcdef0123456789abcdef").decode()
    spark.conf.set("spark.test.body.key", key)
    df = spark.createDataFrame([("secret text", {"a": "b"})], "body string, headers map<string,string>")
    hidden = lib.encrypt_body(df, "spark.test.body.key")
    row = hidden.first()
    assert b"secret" not in bytes(row.body) and row.headers == {"a": "b", "X-Encryption": "AES-GCM"}
    back = lib.decrypt_body(hidden, "spark.test.body.key")
    assert bytes(back.first().body) == b"secret text"
    assert key not in hidden._jdf.queryExecution().toString()
