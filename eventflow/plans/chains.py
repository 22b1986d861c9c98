"""Operators put together: the life of a batched request, and of a polled item."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import envelope as E
from eventflow.operators import handlers as H
from eventflow.operators.batching import assign_batches, assign_poll_batches
from eventflow.plans import query
from eventflow.plans.envelope import item_rows, request_log
from eventflow.plans.tables import spread
from eventflow.sources import polling


def _serve(context, batch):
    """Answers most requests; one kind gets no answer, and one kind breaks its batch."""
    if any(e.path.endswith("7") for e in batch):
        raise RuntimeError("bad page")
    return [H.Response(e.method, 201 if e.method == "POST" else 200, event_id=e.id) for e in batch
            if not e.path.endswith("3")]


@query("request_chain", """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  page_id % 4 <> 1 AS admitted, page_id % 3 = 0 AS post FROM pages),
b AS (SELECT *, (row_number() OVER (PARTITION BY post ORDER BY page_id) - 1) // 5 AS batch_no FROM p WHERE admitted),
o AS (SELECT *, bool_or(suffix(path, '7')) OVER (PARTITION BY post, batch_no) AS broken FROM b)
SELECT page_id, CASE WHEN broken THEN 'failure' WHEN suffix(path, '3') THEN 'no_response' ELSE 'success' END AS outcome,
  CASE WHEN broken THEN 500 WHEN suffix(path, '3') THEN 500 WHEN post THEN 201 ELSE 200 END AS status_code FROM o
UNION ALL SELECT page_id, 'refused', NULL FROM p WHERE NOT admitted""")
def _requests(spark, sf_dir):
    log = spread(request_log(spark, sf_dir)).withColumn("headers", F.map_concat("headers", F.create_map(
        F.lit("Origin"), F.when(F.col("page_id") % 4 == 1, "evil.example").otherwise("good.example"))))
    asked = H.admit(log, H.Cors(origins=("good.example",)))
    refused = asked.filter(~F.col("admitted")).select("page_id", F.lit("refused").alias("outcome"),
                                                      F.col("status").alias("status_code"))
    events = E.normalize_http_log(asked.filter("admitted"), keep=("page_id",)).withColumn("id", F.col("page_id").cast("string"))
    batches = assign_batches(events, ["method"], "ts", ["page_id"], 5, None)
    answers = H.map_batches(batches, _serve)
    known = batches.select("batch_id", F.col("id").alias("event_id"))
    matched = H.correlate(known, answers)
    final = H.with_status(matched.withColumns({
        "submit_error": F.lit(None).cast("string"), "error_status": F.lit(None).cast("int"),
        "process_error": F.when(F.col("outcome") != "success", F.col("outcome"))}))
    return final.select(F.col("event_id").cast("bigint").alias("page_id"), "outcome", "status_code").unionByName(refused)


def _read_item(context, event):
    if int(event.headers["doc"]) % 5 == 0:
        raise ValueError("unreadable")
    return event.headers["__name"]


@query("poll_chain", """WITH i AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS name, source, n_chars FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS rn FROM i WHERE n_chars > 50)
SELECT name, rn // 8 AS batch_no, CASE WHEN doc_id % 5 = 0 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(1800000000 AS BIGINT) END AS secs FROM b""")
def _poll(spark, sf_dir):
    items = spread(item_rows(spark, sf_dir)).withColumn("cycle", F.substring_index("__name", "/", 1))
    found = polling.poll_items(items, None, predicates=("__size > 50",), attributes=("attributes", "cycle", "doc_id"))
    events = E.normalize_items(found, keep=("cycle", "doc_id"))
    batches = assign_poll_batches(events, "cycle", "ts", ["doc_id"], 8)
    answers = H.map_handler(batches, _read_item, keep=("path", "batch_no"))
    done = answers.select(F.col("path").alias("__name"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"), "error")
    stamps = polling.stamp_items(None, done)
    return answers.join(stamps.withColumnRenamed("__name", "path"), "path", "left").select(
        F.col("path").alias("name"), "batch_no", "status_code", "secs")
