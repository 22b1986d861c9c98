"""Handlers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import batching as B
from eventflow.operators import handlers as H
from eventflow.operators.envelope import to_envelope
from eventflow.plans import query
from eventflow.plans.tables import EVENTS, events, spread, table


def _envelope(spark, sf_dir, keep=()):
    return to_envelope(spread(events(spark, sf_dir)), {"id": "event_id", "body": "body", "path": "topic", "topic": "topic",
                                               "offset": "event_id", "ts": "ts"}, "kafka-cluster", "k", keep=keep)


def _remember(context):
    context.user_data["greeting"] = "hello"


def _answer(context, event):
    n = event.offset % 6
    text = event.body.decode()
    if n == 0:
        return f"{context.user_data['greeting']} {text}"
    if n == 1:
        return 201, text
    if n == 2:
        return {"path": event.path}
    if n == 3:
        raise ValueError("some error")
    if n == 4:
        return H.Response(b"raw", 202, "application/octet-stream", {"h1": "v1", H.NO_ACK_HEADER: True})
    return ["first", (404, "second")]


@query("h1_map_handler", f"""WITH {EVENTS}
SELECT CAST(event_id AS VARCHAR) AS event_id, list_value(200, 201, 200, 500, 202, 200)[1 + event_id % 6] AS status_code,
  list_value('text/plain', 'text/plain', 'application/json', 'text/plain', 'application/octet-stream', 'text/plain')[1 + event_id % 6] AS content_type,
  CASE event_id % 6 WHEN 0 THEN 'hello ' || body WHEN 1 THEN body WHEN 2 THEN '{{"path": "' || topic || '"}}'
    WHEN 3 THEN 'Exception caught in handler - "some error"' WHEN 4 THEN 'raw' ELSE 'first' END AS body,
  event_id % 6 = 4 AS no_ack, CASE WHEN event_id % 6 = 3 THEN 'some error' END AS error FROM ev
UNION ALL SELECT CAST(event_id AS VARCHAR), 404, 'text/plain', 'second', false, NULL FROM ev WHERE event_id % 6 = 5""")
def _h1(spark, sf_dir):
    return H.map_handler(_envelope(spark, sf_dir), _answer, _remember).select(
        "event_id", "status_code", "content_type", F.col("body").cast("string").alias("body"), "no_ack", "error")


@query("h2_response_rules", f"""WITH {EVENTS}
SELECT list_value(200, 201, 200, 500, 202, 200)[1 + event_id % 6] AS status_code,
  list_value('text/plain', 'text/plain', 'application/json', 'text/plain', 'application/octet-stream', 'text/plain')[1 + event_id % 6] AS content_type,
  topic, count(*) AS n FROM ev GROUP BY ALL
UNION ALL SELECT 404, 'text/plain', topic, count(*) FROM ev WHERE event_id % 6 = 5 GROUP BY topic""")
def _h2(spark, sf_dir):
    rows = H.map_handler(_envelope(spark, sf_dir, ("event_id",)), _answer, _remember, keep=("topic",))
    return rows.groupBy("status_code", "content_type", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("h3_with_status", f"""WITH {EVENTS}
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 503 WHEN event_id % 10 = 1 THEN 500
  WHEN process_error THEN CASE WHEN event_id % 2 = 0 THEN 418 ELSE 500 END ELSE status_code END AS status_code FROM ev""")
def _h3(spark, sf_dir):
    n = F.col("event_id") % 10
    rows = events(spark, sf_dir).withColumns({
        "submit_error": F.when(n == 0, "No available workers").when(n == 1, "broken pipe"),
        "process_error": F.when(F.col("process_error"), "bad input"),
        "error_status": F.when(F.col("event_id") % 2 == 0, 418)})
    return H.with_status(rows).select("event_id", "status_code")


def _batches(spark, sf_dir):
    rows = _envelope(spark, sf_dir, ("user_id", "event_id"))
    return B.assign_batches(rows, ["user_id"], "ts", ["event_id"], 10, None)


def _batch_answer(context, batch):
    if int(batch[0].id) % 20 == 0:
        raise RuntimeError("bad batch")
    return [H.Response(f"{i} of {len(batch)}", event_id=e.id) for i, e in enumerate(batch)]


@query("h4_map_batches", """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
g AS (SELECT *, user_id || '/' || (rn // 10) AS batch_id, rn % 10 AS pos, count(*) OVER (PARTITION BY user_id, rn // 10) AS k,
  first_value(event_id) OVER (PARTITION BY user_id, rn // 10 ORDER BY rn) AS head FROM o)
SELECT batch_id, CAST(pos AS INTEGER) AS answer_no, CAST(event_id AS VARCHAR) AS event_id, 200 AS status_code, pos || ' of ' || k AS body FROM g WHERE head % 20 <> 0
UNION ALL SELECT batch_id, 0, NULL, 500, 'Exception caught in handler - "bad batch"' FROM g WHERE head % 20 = 0 AND pos = 0""")
def _h4(spark, sf_dir):
    return H.map_batches(_batches(spark, sf_dir), _batch_answer).select(
        "batch_id", "answer_no", "event_id", "status_code", F.col("body").cast("string").alias("body"))


@query("h5_correlate", f"""WITH {EVENTS}, broken AS (SELECT DISTINCT event_id // 10 AS b FROM ev WHERE process_error)
SELECT CAST(event_id // 10 AS VARCHAR) AS batch_id, CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN event_id // 10 IN (SELECT b FROM broken) THEN 'failure' WHEN event_id % 11 IN (0, 1) THEN 'no_response'
    WHEN event_id % 11 = 2 THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN event_id % 11 NOT IN (0, 1) THEN 200 + CAST(event_id % 11 AS INTEGER) END AS status_code FROM ev
UNION ALL SELECT CAST(event_id // 10 AS VARCHAR), 'x' || event_id, 'orphan', 200 FROM ev WHERE event_id % 11 = 0""")
def _h5(spark, sf_dir):
    rows = events(spark, sf_dir)
    n, batch = F.col("event_id") % 11, F.floor(F.col("event_id") / 10).cast("bigint").cast("string")
    text = F.col("event_id").cast("string")
    known = rows.select(batch.alias("batch_id"), text.alias("event_id"))
    # an answer for each event, some for unknown events or for none, and a later one for most
    first = rows.select(
        batch.alias("batch_id"), F.when(n == 0, F.concat(F.lit("x"), text)).when(n == 1, "").otherwise(text).alias("event_id"),
        (F.lit(200) + n).cast("int").alias("status_code"), F.when(n == 2, "failed").alias("error"),
        F.lit(0).alias("answer_no"))
    later = first.withColumns({"answer_no": F.lit(1), "status_code": F.lit(599), "error": F.when(
        F.col("event_id") != "", "later answer")})
    broken = rows.filter("process_error").select(batch.alias("batch_id")).distinct().select(
        "batch_id", F.lit(None).cast("string").alias("event_id"), F.lit(500).alias("status_code"),
        F.lit("bad batch").alias("error"), F.lit(0).alias("answer_no"))
    return H.correlate(known, first.unionByName(later).unionByName(broken))


@query("h6_timeout", """SELECT conv_id, turn, CASE WHEN conv_id % 50 = 0 AND turn = 0 THEN 408 ELSE 200 END AS status_code FROM conversations""")
def _h6_timeout(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "conversations"))
    slow = (F.col("conv_id") % 50 == 0) & (F.col("turn") == 0)
    headers = F.create_map(F.lit("X-Args"), F.when(slow, "60").otherwise("0"))
    rows = to_envelope(rows, {"body": "text", "headers": headers}, "http", "web", keep=("conv_id", "turn"))
    out = H.shell_handler(rows, "sleep", arguments_header="X-Args", keep=("conv_id", "turn"), timeout=1.0)
    return out.select("conv_id", "turn", "status_code")


@query("h6_shell_handler", """
SELECT conv_id, turn, 200 AS status_code, CAST(strlen(text) AS VARCHAR) AS body FROM conversations""")
def _h6(spark, sf_dir):
    rows = to_envelope(spread(table(spark, sf_dir, "conversations")), {"body": "text"}, "http", "web", keep=("conv_id", "turn"))
    out = H.shell_handler(rows, "wc", ["-c"], keep=("conv_id", "turn"))
    return out.select("conv_id", "turn", "status_code", F.trim(F.regexp_replace(F.col("body").cast("string"), r"\s", "")).alias("body"))


def _fibonacci(context, event):
    a, b = 0, 1
    for _ in range(int(event.body)):
        a, b = b, a + b
    return str(a)


def _fibonacci_sum(context, event):
    asked = [H.Event(body=part) for part in event.body.decode().split(",")]
    return str(sum(int(context.call("fibonacci", e).body) for e in asked))


@query("h7_call", """WITH RECURSIVE f AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b
  UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40)
SELECT c_custkey, CAST((SELECT a FROM f WHERE n = c_nationkey) + (SELECT a FROM f WHERE n = c_custkey % 30) AS VARCHAR) AS body FROM customer""")
def _h7(spark, sf_dir):
    body = F.concat_ws(",", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 30).cast("string"))
    rows = to_envelope(table(spark, sf_dir, "customer"), {"body": body}, "http", "web", keep=("c_custkey",))
    out = H.call(rows, {"fibonacci": _fibonacci, "sum": _fibonacci_sum}, "sum", keep=("c_custkey",))
    return out.select("c_custkey", F.col("body").cast("string").alias("body"))


@query("h8_apply_timeout", f"""WITH {EVENTS}
SELECT event_id, CASE WHEN duration_ms > 120 THEN 408 ELSE status_code END AS status_code,
  CASE WHEN duration_ms > 120 THEN 'timeout' ELSE 'done' END AS outcome FROM ev""")
def _h8(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("outcome", F.lit("done"))
    return H.apply_timeout(rows, "120ms").select("event_id", "status_code", "outcome")


@query("h9_admit", f"""WITH {EVENTS}, q AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method,
  CASE event_id % 3 WHEN 0 THEN 'foo.bar' WHEN 1 THEN 'FOO.bar' ELSE 'baz.bar' END AS origin,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 8 = 2 THEN 'get' ELSE 'TRACE' END AS wanted,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'accept, Content-Type' ELSE 'Not-supported-header' END AS asked, strlen(body) > 8 AS big FROM ev),
p AS (SELECT *, method = 'OPTIONS' AND wanted <> '' AS pre FROM q),
r AS (SELECT *, CASE WHEN big THEN 'body' WHEN lower(origin) <> 'foo.bar' THEN 'origin' WHEN pre AND wanted = 'TRACE' THEN 'method'
  WHEN pre AND asked = 'Not-supported-header' THEN 'headers' END AS reason FROM p)
SELECT event_id, reason, reason IS NULL AS admitted, CASE WHEN reason = 'body' THEN 413 WHEN pre AND reason IS NULL THEN 200 WHEN pre THEN 400 END AS status FROM r""")
def _h9(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id", F.when(k % 2 == 0, "OPTIONS").otherwise("GET").alias("method"), F.create_map(
            F.lit("Origin"), F.when(k % 3 == 0, "foo.bar").when(k % 3 == 1, "FOO.bar").otherwise("baz.bar"),
            F.lit("Access-Control-Request-Method"), F.when(k % 4 == 0, "").when(k % 8 == 2, "get").otherwise("TRACE"),
            F.lit("Access-Control-Request-Headers"), F.when(k % 5 == 0, "").when(k % 5 == 1, "accept, Content-Type")
            .otherwise("Not-supported-header")).alias("headers"), F.col("body").cast("binary").alias("body"))
    return H.admit(rows, H.Cors(origins=("foo.bar",)), max_body=8).select("event_id", "reason", "admitted", "status")
