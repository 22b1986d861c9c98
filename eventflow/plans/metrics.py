"""Metrics and scaling signals over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import metrics as M
from eventflow.plans import chunked, query
from eventflow.plans.tables import EVENTS, events, table

LABELLED = f"""{EVENTS}, lab AS (SELECT *, 'default' AS namespace, 'project-' || (user_id % 3) AS project, 'fn-' || topic AS "function",
  'kafka-cluster' AS trigger_kind, 't' || shard_id AS trigger_id, 'node-' || (user_id % 2) AS instance FROM ev)"""


def labelled(spark, sf_dir):
    return events(spark, sf_dir).withColumns({
        "namespace": F.lit("default"), "project": F.concat(F.lit("project-"), (F.col("user_id") % 3).cast("string")),
        "function": F.concat(F.lit("fn-"), "topic"), "trigger_kind": F.lit("kafka-cluster"),
        "trigger_id": F.concat(F.lit("t"), F.col("shard_id").cast("string")),
        "instance": F.concat(F.lit("node-"), (F.col("user_id") % 2).cast("string"))})


@query("m1_handled_events", f"""WITH {LABELLED}, c AS (
  SELECT namespace, project, "function", trigger_kind, trigger_id, instance,
    count(*) FILTER (NOT process_error) AS success, count(*) FILTER (process_error) AS failure
  FROM lab WHERE event_id % 13 <> 0 GROUP BY ALL),
g AS (SELECT DISTINCT namespace, project, "function", trigger_kind, trigger_id, instance FROM lab)
SELECT g.*, 'success' AS result, coalesce(success, 0) AS "value" FROM g LEFT JOIN c USING (namespace, project, "function", trigger_kind, trigger_id, instance)
UNION ALL SELECT g.*, 'failure', coalesce(failure, 0) FROM g LEFT JOIN c USING (namespace, project, "function", trigger_kind, trigger_id, instance)""")
def _m1(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn(
        "outcome", F.when(F.col("event_id") % 13 == 0, "no_response").otherwise("response"))
    return M.handled_events(rows)


@query("m1_handled_events_rollup", f"""WITH {LABELLED}, c AS (
  SELECT namespace, project, "function", trigger_kind, trigger_id, instance,
    CAST(6 - bit_count(GROUPING(namespace, project, "function", trigger_kind, trigger_id, instance)) AS INTEGER) AS level,
    count(*) FILTER (NOT process_error) AS success, count(*) FILTER (process_error) AS failure
  FROM lab GROUP BY ROLLUP (namespace, project, "function", trigger_kind, trigger_id, instance))
SELECT namespace, project, "function", trigger_kind, trigger_id, instance, level, 'success' AS result, success AS "value" FROM c
UNION ALL SELECT namespace, project, "function", trigger_kind, trigger_id, instance, level, 'failure', failure FROM c""")
def _m1_rollup(spark, sf_dir):
    return M.handled_events(labelled(spark, sf_dir), rollup=True)


@query("m2_worker_outcomes", f"""WITH {EVENTS}
SELECT shard_id AS worker, count(*) FILTER (NOT process_error AND status_code < 400) AS success,
  count(*) FILTER (process_error OR status_code >= 400) AS error FROM ev GROUP BY shard_id""")
def _m2(spark, sf_dir):
    return M.worker_outcomes(events(spark, sf_dir).withColumnRenamed("shard_id", "worker"))


@query("m3_durations", f"""WITH {EVENTS}
SELECT topic, shard_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duration_ms_sum, count(*) AS duration_ms_count,
  sum(CAST(floor(value) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS duration_ms_mean FROM ev GROUP BY ALL""")
def _m3(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("duration_ms", F.col("value"))
    return M.durations(rows, ("topic", "shard_id"))


@query("m4_counter_delta", f"""WITH {EVENTS}
SELECT event_id, handled - coalesce(lag(handled) OVER w, 0) AS handled_delta,
  spent - coalesce(lag(spent) OVER w, 0) AS spent_delta
FROM (SELECT *, event_id * 3 AS handled, event_id * 5 + duration_ms AS spent FROM ev)
WINDOW w AS (PARTITION BY topic, shard_id ORDER BY ts)""")
def _m4(spark, sf_dir, **chunks):
    snaps = events(spark, sf_dir).select(
        "event_id", "topic", "shard_id", "ts", (F.col("event_id") * 3).alias("handled"),
        (F.col("event_id") * 5 + F.col("duration_ms")).alias("spent"))
    return M.counter_delta(snaps, ["topic", "shard_id"], "ts", ["handled", "spent"], **chunks).select(
        "event_id", "handled_delta", "spent_delta")


chunked("m4_counter_delta", _m4)


@query("m5_allocation_stats", f"""WITH {EVENTS}, a AS (SELECT *, 't' || shard_id AS trigger_id,
  CASE WHEN status_code = 500 THEN 'timeout' WHEN status_code = 404 THEN 'after_wait' ELSE 'immediate' END AS result,
  CAST(floor((event_id % 7) * 100 / 6.0) AS BIGINT) AS pct FROM ev)
SELECT trigger_id, count(*) AS allocation_count, count(*) FILTER (result = 'immediate') AS success_immediate,
  count(*) FILTER (result = 'after_wait') AS success_after_wait, count(*) FILTER (result = 'timeout') AS timeout,
  CAST(coalesce(sum(duration_ms) FILTER (result = 'after_wait'), 0) AS BIGINT) AS wait_ms_sum,
  sum(pct) / CAST(count(*) AS DOUBLE) AS available_percentage FROM a GROUP BY trigger_id""")
def _m5(spark, sf_dir):
    status = F.col("status_code")
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("shard_id").cast("string")).alias("trigger_id"),
        F.when(status == 500, "timeout").when(status == 404, "after_wait").otherwise("immediate").alias("result"),
        F.col("value").alias("wait_ms"), (F.col("event_id") % 7).alias("available"), F.lit(6).alias("total"))
    return M.allocation_stats(rows)


@query("m6_rollup_windows", f"""WITH {EVENTS}, s(window_size, us) AS (VALUES ('1m', 60000000), ('2m', 120000000), ('5m', 300000000),
  ('10m', 600000000), ('30m', 1800000000))
SELECT topic AS metric, window_size, epoch_us(ts) - epoch_us(ts) % us AS start_us, count(*) AS n,
  CAST(sum(duration_ms) AS BIGINT) AS total, min(duration_ms) AS low, max(duration_ms) AS high
FROM ev, s GROUP BY ALL""")
def _m6(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("topic").alias("metric"), "ts", F.col("duration_ms").alias("value"))
    return M.rollup_windows(rows).select("metric", "window_size", F.unix_micros("window_start").alias("start_us"),
                                         "n", "total", "low", "high")


FUNCTIONS = """fn AS (SELECT c_custkey AS k, c_name AS name,
  list_value('ready', 'unhealthy', 'scaledToZero', 'building', 'error')[1 + c_custkey % 5] AS state,
  CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 2 END AS replicas,
  CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS min_replicas, c_custkey % 7 = 0 AS disabled FROM customer)"""


def function_states(spark, sf_dir):
    """The customers as functions with replicas, state and scale-to-zero settings."""
    k = F.col("c_custkey")
    states = F.array(*[F.lit(s) for s in ("ready", "unhealthy", "scaledToZero", "building", "error")])
    window = F.when(k % 11 == 0, "ten minutes").otherwise("30m")
    resource = F.array(
        F.struct(F.lit("events").alias("metric_name"), window.alias("window_size"), F.lit(90.0).alias("threshold")),
        F.struct(F.lit("lag").alias("metric_name"), F.lit("1h30m").alias("window_size"), F.lit(140.0).alias("threshold")))
    status = F.struct(F.lit("scaleToZero").alias("last_scale_event"),
                      F.when(k % 2 == 0, F.lit("2024-01-01T00:00:00Z").cast("timestamp")).alias("last_scale_event_time"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.col("c_name").alias("name"), F.get(states, (k % 5).cast("int")).alias("state"),
        F.when(k % 4 == 0, 0).when(k % 4 == 1, -1).when(k % 4 == 2, 2).alias("replicas"),
        F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).alias("min_replicas"), (k % 7 == 0).alias("disabled"),
        F.when(k % 13 != 0, resource).alias("scale_to_zero"), F.when(k % 6 < 2, status).alias("scale_status"))


CANDIDATES = FUNCTIONS + """, cand AS (SELECT * FROM fn WHERE greatest(coalesce(replicas, min_replicas, 1), 0) <= 0 AND state = 'ready'
  AND k % 13 <> 0 AND k % 11 <> 0 AND NOT (k % 6 < 2 AND k % 2 <> 0))"""


@query("m7_idle_candidates", f"WITH {CANDIDATES} SELECT name FROM cand")
def _m7(spark, sf_dir):
    return M.idle_candidates(function_states(spark, sf_dir)).select("name")


@query("m8_idle_functions", f"""WITH {EVENTS}, {CANDIDATES}, t AS (SELECT max(ts) AS now FROM ev),
m AS (SELECT 'Customer#' || lpad(CAST((user_id * 5) % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0') AS "function",
    CASE WHEN event_id % 2 = 0 THEN 'events' ELSE 'lag' END AS metric, t.now - to_microseconds((epoch_us(t.now) - epoch_us(ts)) // 100) AS ts,
    value FROM ev, t)
SELECT name, coalesce((SELECT bool_and(m.value <= CASE metric WHEN 'events' THEN 90 ELSE 140 END) FROM m, t
    WHERE m."function" = c.name AND m.ts > t.now - CASE metric WHEN 'events' THEN INTERVAL 30 MINUTE ELSE INTERVAL 90 MINUTE END
      AND m.ts <= t.now), true) AS idle
FROM cand c""")
def _m8(spark, sf_dir):
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts")).first()[0]
    customers = table(spark, sf_dir, "customer").count()
    now_us = F.unix_micros(F.lit(last))
    age = F.floor((now_us - F.unix_micros("ts")) / F.lit(100)).cast("bigint")
    samples = rows.select(
        F.concat(F.lit("Customer#"), F.lpad(((F.col("user_id") * 5) % customers).cast("string"), 9, "0"))
        .alias("function"), F.when(F.col("event_id") % 2 == 0, "events").otherwise("lag").alias("metric_name"),
        F.timestamp_micros(now_us - age).alias("ts"), "value")
    return M.idle_functions(M.idle_candidates(function_states(spark, sf_dir)), samples, last).select("name", "idle")


@query("m9_stuck_events", f"""WITH {EVENTS}, t AS (SELECT max(ts) AS now FROM ev)
SELECT event_id FROM ev, t WHERE (status_code = 500 OR topic = 'error') AND t.now - ts > INTERVAL 1 HOUR""")
def _m9(spark, sf_dir):
    rows = events(spark, sf_dir)
    ends = rows.filter((F.col("status_code") != 500) & (F.col("topic") != "error"))
    return M.stuck_events(rows.select("event_id", "ts"), ends, "1h", rows.agg(F.max("ts")).first()[0]).select("event_id")


@query("m10_health_transitions", f"""WITH {FUNCTIONS}, last AS (
  SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderkey, o_orderkey) AS ok FROM orders GROUP BY o_custkey),
j AS (SELECT fn.*, ok % 10 <> 0 AND NOT (status = 'F' OR ok % 4 = 1) AS up FROM fn JOIN last ON o_custkey = k)
SELECT name, state AS from_state, CASE state WHEN 'ready' THEN 'unhealthy' ELSE 'ready' END AS to_state FROM j
WHERE NOT disabled AND coalesce(replicas, 1) <> 0 AND (state = 'ready' AND NOT up OR state = 'unhealthy' AND up)""")
def _m10(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def condition(kind, status):
        return F.struct(F.lit(kind).alias("type"), F.lit(status).alias("status"))

    snaps = orders.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("function"),
        key.alias("ts"), F.when(key % 10 == 0, 0).otherwise(1).alias("replicas"),
        F.when(F.col("o_orderstatus") == "F", F.array(condition("Available", "False")))
        .when(key % 4 == 1, F.array(condition("Available", "True"), condition("ReplicaFailure", "True")))
        .otherwise(F.array(condition("Available", "True"), condition("Progressing", "True"))).alias("conditions"))
    return M.health_transitions(function_states(spark, sf_dir), snaps)


@query("m11_to_exposition", f"""WITH {EVENTS}
SELECT 'handled_events_total{{result="' || CASE WHEN process_error THEN 'failure' ELSE 'success' END || '",shard="' || shard_id ||
  '",topic="' || topic || '"}} ' || count(*) AS line FROM ev GROUP BY topic, shard_id, process_error""")
def _m11(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("topic", "shard_id", "process_error").agg(F.count(F.lit(1)).alias("value"))
    return M.to_exposition(counts.select(
        F.lit("handled_events_total").alias("metric"), F.create_map(
            F.lit("topic"), F.col("topic"), F.lit("shard"), F.col("shard_id").cast("string"), F.lit("result"),
            F.when(F.col("process_error"), "failure").otherwise("success")).alias("labels"), "value"))
