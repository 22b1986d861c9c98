"""Native handlers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions import library as lib
from eventflow.operators import envelope as E
from eventflow.plans import query
from eventflow.plans.envelope import request_log
from eventflow.plans.tables import events, table


@query("f1_scan_patterns", r"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '\b(?:\d[ -]*?){13,16}\b') THEN 'Credit card' END,
  CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'SSN' END) AS found FROM documents""")
def _f1(spark, sf_dir):
    rows = lib.scan_patterns(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", F.array_join("found", ",").alias("found"))


@query("f2_reverse_body", "SELECT doc_id, reverse(text) AS body FROM documents")
def _f2(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    return lib.reverse_body(rows)


@query("f3_json_field", """
SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS value,
  CASE WHEN event_id % 50 = 0 THEN 'malformed body' END AS error FROM events""")
def _f3(spark, sf_dir):
    broken = F.when(F.col("event_id") % 50 == 0, F.lit("{k:")).otherwise(F.col("body"))
    rows = events(spark, sf_dir).withColumn("body", broken)
    return lib.json_field(rows, "body", "$.k", "bigint").select("event_id", "value", "error")


@query("f4_date_add_unit", """WITH e AS (SELECT event_id, ts, user_id % 40 - 20 AS v,
  list_value('years', 'M', 'weeks', 'day', 'Hours', 'm', 'seconds', 'fortnight')[1 + event_id % 8] AS unit FROM events)
SELECT event_id, unit, epoch_us(CASE unit WHEN 'years' THEN ts + to_years(CAST(v AS INTEGER)) WHEN 'M' THEN ts + to_months(CAST(v AS INTEGER))
  WHEN 'weeks' THEN ts + to_days(CAST(v * 7 AS INTEGER)) WHEN 'day' THEN ts + to_days(CAST(v AS INTEGER)) WHEN 'Hours' THEN ts + to_hours(v)
  WHEN 'm' THEN ts + to_minutes(v) WHEN 'seconds' THEN ts + to_seconds(v) END) AS shifted_us FROM e""")
def _f4(spark, sf_dir):
    units = ("years", "M", "weeks", "day", "Hours", "m", "seconds", "fortnight")
    rows = events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 40 - 20).alias("v"), F.get(
        F.array(*[F.lit(u) for u in units]), (F.col("event_id") % 8).cast("int")).alias("unit"))
    return lib.date_add_unit(rows, "ts", "v", "unit").select("event_id", "unit", F.unix_micros("shifted").alias("shifted_us"))


@query("f5_slugify", """
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM conversations""")
def _f5(spark, sf_dir):
    return lib.slugify(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "slug")


@query("f6_encrypt_body", "SELECT doc_id, text AS body, 'AES-GCM' AS algorithm, true AS hidden FROM documents")
def _f6(spark, sf_dir):
    conf = "spark.eventflow.body.key"
    if spark.conf.get(conf, None) is None:
        # a key for this run only; a deployment sets its own
        import base64
        import os
        spark.conf.set(conf, base64.b64encode(os.urandom(32)).decode())
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("body"), F.col("text").alias("plain"),
        F.create_map(F.lit("a"), F.lit("b")).alias("headers"))
    secret = lib.encrypt_body(rows, conf).withColumn("hidden", F.col("body") != F.col("plain").cast("binary"))
    return lib.decrypt_body(secret, conf).select(
        "doc_id", F.col("body").cast("string").alias("body"), F.col("headers")["X-Encryption"].alias("algorithm"), "hidden")


@query("f7_render_fields", """
SELECT page_id, CASE WHEN contains(url, '?') THEN
  array_to_string(list_sort(string_split(split_part(url, '?', 2), '&')), ',') ELSE '' END AS rendered FROM pages""")
def _f7(spark, sf_dir):
    rows = E.normalize_http_log(request_log(spark, sf_dir), keep=("page_id",))
    return lib.render_fields(rows).select("page_id", "rendered")
