"""Delivery operators over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventflow.functions.library import json_field
from eventflow.operators import delivery as D
from eventflow.operators.prefix import Walk
from eventflow.plans import chunked, query
from eventflow.plans.tables import EVENTS, LOG, event_log, events


@query("shard_report", f"""WITH {LOG}
SELECT topic, shard_id, count(*) AS "current",
  greatest(coalesce(max("offset" + 1) FILTER (NOT process_error), 0), 0) AS committed,
  count(*) - greatest(coalesce(max("offset" + 1) FILTER (NOT process_error), 0), 0) AS lag,
  count(*) FILTER (NOT process_error) AS handled_success, count(*) FILTER (process_error) AS handled_failure,
  CAST(sum(CAST(json_extract_string(body, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
FROM log GROUP BY topic, shard_id""")
def shard_report(spark, sf_dir):
    """Events to commit position, lag and counts, one row per (topic, shard)."""
    rows = json_field(event_log(spark, sf_dir), "body", "$.k", "bigint", name="k")
    rows = D.ack_decision(rows, "disable")
    return rows.groupBy("topic", "shard_id").agg(
        F.max(F.col("offset") + 1).alias("current"),
        F.greatest(F.coalesce(F.max(F.when(F.col("acked"), F.col("offset") + 1)), F.lit(0)), F.lit(0)).alias("committed"),
        F.count_if(~F.col("process_error")).alias("handled_success"),
        F.count_if(F.col("process_error")).alias("handled_failure"), F.sum("k").alias("sum_k"),
    ).withColumn("lag", F.col("current") - F.col("committed"))


@query("d1_ack_decision", f"""WITH {EVENTS}, modes(mode) AS (VALUES ('disable'), ('enable'), ('explicitOnly'), ('other'))
SELECT mode, topic, shard_id, CAST(sum(CASE WHEN mode = 'explicitOnly' THEN 0
    WHEN mode = 'enable' THEN CASE WHEN NOT process_error AND event_id % 7 <> 0 THEN 1 ELSE 0 END
    ELSE CASE WHEN NOT process_error THEN 1 ELSE 0 END END) AS BIGINT) AS acked, count(*) AS n
FROM ev, modes GROUP BY ALL""")
def _d1(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("no_ack", F.when(F.col("event_id") % 7 == 0, F.lit(True)))
    rows = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("disable", "enable", "explicitOnly", "other")])))
    return D.ack_decision(rows, F.col("mode")).groupBy("mode", "topic", "shard_id").agg(
        F.count_if("acked").alias("acked"), F.count(F.lit(1)).alias("n"))


KINDS = ("rabbit-mq", "pubsub", "eventhub", "kinesis", "nats", "mqtt")


@query("d2_disposition", f"""WITH {EVENTS}, o AS (
  SELECT *, list_value('rabbit-mq', 'pubsub', 'eventhub', 'kinesis', 'nats', 'mqtt')[1 + event_id % 6] AS kind,
         event_id % 11 = 0 AS submit_error FROM ev)
SELECT event_id, kind, CASE
  WHEN kind = 'rabbit-mq' THEN CASE WHEN submit_error THEN 'unacked' ELSE 'ack' END
  WHEN kind = 'pubsub' THEN CASE WHEN submit_error OR process_error THEN 'nack' ELSE 'ack' END
  WHEN kind = 'eventhub' THEN 'ack' WHEN kind = 'kinesis' THEN 'advance'
  WHEN submit_error THEN 'lost' ELSE 'none' END AS disposition FROM o""")
def _d2(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({
        "kind": F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 6).cast("int")),
        "submit_error": F.col("event_id") % 11 == 0})
    return D.disposition(rows).select("event_id", "kind", "disposition")


@query("d3_commit_frontier", f"""WITH {LOG}
SELECT topic, shard_id, 'kafka' AS style,
  greatest(max("offset" + 1 - 10) FILTER (NOT process_error AND shard_id <> 5), 0) AS committed FROM log GROUP BY ALL
  HAVING count(*) FILTER (NOT process_error AND shard_id <> 5) > 0
UNION ALL SELECT topic, shard_id, 'stream', max("offset" - 10) FILTER (NOT process_error AND shard_id <> 5 AND "offset" >= 10)
  FROM log GROUP BY ALL HAVING count(*) FILTER (NOT process_error AND shard_id <> 5 AND "offset" >= 10) > 0""")
def _d3(spark, sf_dir):
    # nothing of shard 5 is acked, so it has no position
    rows = D.ack_decision(event_log(spark, sf_dir)).withColumn("acked", F.col("acked") & (F.col("shard_id") != 5))
    return (D.commit_frontier(rows, 10, "kafka").withColumn("style", F.lit("kafka"))
            .unionByName(D.commit_frontier(rows, 10, "stream").withColumn("style", F.lit("stream"))))


@query("d4_apply_acks", f"""WITH {EVENTS}
SELECT 'kafka' AS style, topic, shard_id, max(event_id) + 1 AS committed FROM ev
  WHERE NOT process_error AND value >= 5 AND shard_id < 6 GROUP BY ALL
UNION ALL SELECT 'stream', c.topic, c.shard_id, max(e.event_id) - 5 FROM ev e
  JOIN (SELECT DISTINCT topic, shard_id FROM ev WHERE shard_id < 6) c
    ON c.shard_id = e.shard_id AND (e.value < 5 OR e.topic = c.topic)
  WHERE NOT e.process_error AND e.event_id >= 5 GROUP BY ALL""")
def _d4(spark, sf_dir):
    rows = events(spark, sf_dir)
    # what succeeded is acked, now and then for every topic of the shard
    acks = rows.filter(~F.col("process_error")).select(
        F.lit("streamMessageAck").alias("kind"), F.when(F.col("value") < 5, F.lit("/")).otherwise(F.col("topic")).alias("topic"),
        "shard_id", F.col("event_id").alias("offset"))
    claims = rows.filter("shard_id < 6").select("topic", "shard_id").distinct()
    return (D.apply_acks(acks, claims, 0, "kafka").withColumn("style", F.lit("kafka"))
            .unionByName(D.apply_acks(acks, claims, 5, "stream").withColumn("style", F.lit("stream"))))


def _positions(spark, sf_dir):
    rows = D.ack_decision(event_log(spark, sf_dir))
    current = rows.groupBy("topic", "shard_id").agg(F.max(F.col("offset") + 1).alias("current"))
    return rows, current, D.commit_frontier(rows, 0, "kafka")


@query("d5_shard_lags", f"""WITH {LOG}
SELECT topic, shard_id, max("offset") + 1 AS "current",
  CASE WHEN shard_id = 0 THEN 0 ELSE coalesce(max("offset" + 1) FILTER (NOT process_error), 0) END AS committed,
  max("offset") + 1 - CASE WHEN shard_id = 0 THEN 0 ELSE coalesce(max("offset" + 1) FILTER (NOT process_error), 0) END AS lag
FROM log GROUP BY topic, shard_id""")
def _d5(spark, sf_dir):
    _, current, committed = _positions(spark, sf_dir)
    return D.shard_lags(current, committed.filter("shard_id > 0"))


@query("d6_lag_metrics", f"""WITH {LOG}, p AS (
  SELECT topic, shard_id, max("offset") + 1 AS cur, max("offset") - 2 AS processed,
    coalesce(max("offset" + 1 - 10) FILTER (NOT process_error), 0) AS committed FROM log GROUP BY topic, shard_id)
SELECT 'fn-' || topic AS "function", 'main' AS "trigger", 'stream_high_water_mark_processed_lag' AS metric,
  CAST(sum(cur - processed) AS BIGINT) AS "value" FROM p GROUP BY topic
UNION ALL SELECT 'fn-' || topic, 'main', 'stream_high_water_mark_committed_lag', CAST(sum(cur - greatest(committed, 0)) AS BIGINT)
FROM p GROUP BY topic""")
def _d6(spark, sf_dir):
    rows = D.ack_decision(event_log(spark, sf_dir))
    current = rows.groupBy("topic", "shard_id").agg(
        F.max(F.col("offset") + 1).alias("current"), (F.max("offset") - 2).alias("processed"))
    positions = current.join(D.commit_frontier(rows, 10), ["topic", "shard_id"])
    return D.lag_metrics(positions.select(F.concat(F.lit("fn-"), "topic").alias("function"),
                                          F.lit("main").alias("trigger"), "current", "processed", "committed"))


@query("d7_redelivered", f"""WITH {LOG}, c AS (
  SELECT topic, shard_id, CASE WHEN count(*) FILTER (NOT process_error AND shard_id <> 5) > 0
      THEN greatest(max("offset" + 1 - 25) FILTER (NOT process_error), 0) END AS kafka,
    max("offset" - 25) FILTER (NOT process_error AND "offset" >= 25 AND shard_id <> 5) AS stream
  FROM log WHERE shard_id <> 3 GROUP BY topic, shard_id)
SELECT 'kafka' AS style, event_id FROM log LEFT JOIN c USING (topic, shard_id) WHERE kafka IS NULL OR "offset" >= kafka
UNION ALL SELECT 'stream', event_id FROM log LEFT JOIN c USING (topic, shard_id) WHERE stream IS NULL OR "offset" > stream""")
def _d7(spark, sf_dir):
    # nothing of shard 5 is acked, so all of it comes again, offset 0 too
    rows = D.ack_decision(event_log(spark, sf_dir)).withColumn("acked", F.col("acked") & (F.col("shard_id") != 5))
    acked = rows.filter("shard_id <> 3")
    out = None
    for style in ("kafka", "stream"):
        part = D.redelivered(rows, D.commit_frontier(acked, 25, style), style).select(
            F.lit(style).alias("style"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("d8_pending", f"""WITH {EVENTS}
SELECT topic, shard_id, count(*) AS pending FROM ev WHERE status_code <> 200 GROUP BY ALL""")
def _d8(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("offset", F.col("event_id"))
    return D.pending_size(rows, rows.filter(F.col("status_code") == 200).select("topic", "shard_id", "offset"))


@query("d9_dedupe", f"""WITH {EVENTS} SELECT event_id, topic, shard_id, body FROM ev""")
def _d9(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "topic", "shard_id", F.col("event_id").alias("offset"), "body")
    # every record twice, those of one topic four times
    again = rows.unionByName(rows.filter(F.col("topic") == "click"))
    return D.dedupe(rows.unionByName(again).unionByName(rows.filter(F.col("topic") == "click"))).select(
        "event_id", "topic", "shard_id", "body")


@query("d10_discard_drained", f"""WITH {EVENTS}, s AS (
  SELECT shard_id AS worker, ts, CASE WHEN value > 180 THEN 'terminate' WHEN value > 150 THEN 'drain' ELSE 'continue' END AS signal
  FROM ev WHERE value > 100)
SELECT e.event_id, e.shard_id AS worker FROM ev e ASOF LEFT JOIN s ON e.shard_id = s.worker AND e.ts >= s.ts
WHERE coalesce(s.signal, 'continue') = 'continue'""")
def _d10(spark, sf_dir, **chunks):
    rows = events(spark, sf_dir).withColumn("worker", F.col("shard_id"))
    value = F.col("value")
    # slow events make their worker drain, terminate or go on
    signals = rows.filter(value > 100).select("worker", "ts", F.when(value > 180, "terminate").when(value > 150, "drain")
                                              .otherwise("continue").alias("signal"))
    return D.discard_drained(rows.select("event_id", "worker", "ts"), signals, **chunks).drop("ts")


chunked("d10_discard_drained", lambda spark, sf_dir, **chunks: _d10(spark, sf_dir, few=0, **chunks))


def _lengths(batches):
    for rows in batches:
        yield rows.assign(length=rows["text"].str.len())[["conv_id", "turn", "length"]]


@query("d11_ordered_apply", """
SELECT conv_id, turn, length(text) AS length FROM conversations""")
def _d11(spark, sf_dir):
    from eventflow.plans.tables import table
    rows = table(spark, sf_dir, "conversations").withColumns({
        "topic": F.lit("chat"), "shard_id": (F.col("conv_id") % 8).cast("int"),
        "offset": F.col("conv_id") * 1000 + F.col("turn")})
    return D.ordered_apply(rows, _lengths, "conv_id bigint, turn bigint, length bigint", independent=True)


def _totals(batches):
    shard, total = None, 0
    for rows in batches:
        out = []
        for at, text in zip(rows["shard_id"], rows["text"]):
            shard, total = at, (total if at == shard else 0) + len(text)
            out.append(total)
        yield rows.assign(total=out)[["conv_id", "turn", "total"]]


@query("d11_ordered_state", """
SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS BIGINT) AS total FROM conversations""")
def _d11_state(spark, sf_dir):
    from eventflow.plans.tables import table
    rows = table(spark, sf_dir, "conversations").withColumns({
        "topic": F.lit("chat"), "shard_id": (F.col("conv_id") % 8).cast("int"),
        "offset": F.col("conv_id") * 1000 + F.col("turn")})
    return D.ordered_apply(rows, _totals, "conv_id bigint, turn bigint, total bigint")


def _since_error(state, rows):
    """Running total of the users, and how many events came since the last error (0 at an error)."""
    total, quiet, seen = state
    totals = np.cumsum(rows.column("user_id").to_numpy()) + total
    at = np.arange(len(rows))
    last = np.maximum.accumulate(np.where(rows.column("process_error").to_numpy(zero_copy_only=False), at, -1))
    quiets = np.where(last >= 0, at - last, quiet + at + 1)
    return (int(totals[-1]), int(quiets[-1]), bool(seen or last[-1] >= 0)), [totals, quiets]


def _since_error_of_both(a, b):
    return a[0] + b[0], b[1] if b[2] else a[1] + b[1], a[2] or b[2]


SINCE_ERROR = Walk((0, 0, False), _since_error, _since_error_of_both, "total bigint, quiet bigint, seen boolean", "total bigint, quiet bigint")


@query("d11_ordered_scan", f"""WITH {EVENTS}, s AS (SELECT event_id, CASE WHEN event_id % 10 < 8 THEN 0 ELSE shard_id END AS shard, user_id, process_error FROM ev),
n AS (SELECT *, row_number() OVER w AS rn, CAST(sum(user_id) OVER w AS BIGINT) AS total FROM s WINDOW w AS (PARTITION BY shard ORDER BY event_id))
SELECT event_id, total, rn - coalesce(max(CASE WHEN process_error THEN rn END) OVER (PARTITION BY shard ORDER BY event_id), 0) AS quiet FROM n""")
def _d11_scan(spark, sf_dir):
    """One shard holds most events and goes over many chunks."""
    rows = events(spark, sf_dir)
    busy = rows.select("event_id", F.lit("all").alias("topic"), F.when(F.col("event_id") % 10 < 8, 0).otherwise(F.col("shard_id")).alias("shard_id"),
                       F.col("event_id").alias("offset"), "user_id", "process_error")
    return D.ordered_scan(busy, SINCE_ERROR, chunk_rows=700).select("event_id", "total", "quiet")


@query("d12_assign_workers", f"""WITH {EVENTS}, c AS (SELECT topic, shard_id, min(event_id) AS pos FROM ev GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY topic) AS k FROM c)
SELECT 'given' AS how, topic, shard_id, CAST(i % 3 AS INTEGER) AS worker FROM n
UNION ALL SELECT 'suggested', topic, shard_id, CAST(i % CAST(ceil(k / 4.0 * 1.2) AS BIGINT) AS INTEGER) FROM n""")
def _d12(spark, sf_dir, **chunks):
    claims = events(spark, sf_dir).groupBy("topic", "shard_id").agg(F.min("event_id").alias("pos"))
    return (D.assign_workers(claims, workers=3, **chunks).withColumn("how", F.lit("given"))
            .unionByName(D.assign_workers(claims, replicas=4, **chunks).withColumn("how", F.lit("suggested")))
            .select("how", "topic", "shard_id", "worker"))


chunked("d12_assign_workers", _d12, 7)
