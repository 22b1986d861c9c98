"""Streaming operators over the given tables, run once over all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import delivery as D
from eventflow.operators import handlers as H
from eventflow.operators.envelope import to_envelope
from eventflow.plans import query
from eventflow.plans.sources import event_stream, fresh_dir
from eventflow.plans.tables import EVENTS, LOG, event_log
from eventflow.session import written
from eventflow.sources import shard_log, sinks
from eventflow.streaming import batches, lifecycle, process, tables, twins


def _run(spark, stream, mode="append"):
    """Write a stream to a new folder until its input is used up; the folder."""
    out = fresh_dir(spark)
    sinks.run_once(sinks.write_batches(stream, f"{out}/rows", f"{out}/state").outputMode(mode))
    return f"{out}/rows"


@query("b3_batch_stream", """WITH RECURSIVE o AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT user_id, event_id, rn, us AS opened, 1 AS held, 0 AS batch_no, 0 AS pos FROM o WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN us ELSE opened END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 1 ELSE held + 1 END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 0 ELSE pos + 1 END
  FROM b JOIN o n ON n.user_id = b.user_id AND n.rn = b.rn + 1),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, batch_no) AS k, max(batch_no) OVER (PARTITION BY user_id) AS last FROM b)
SELECT user_id, event_id, CAST(batch_no AS BIGINT) AS batch_no, CAST(pos AS INTEGER) AS pos FROM c
WHERE batch_no < last OR k >= 4 OR opened + 108000000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)""")
def _b3(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    out = batches.batch_stream(rows, ["user_id"], "ts", ["event_id"], 4, "30h")
    path = _run(spark, out)
    return spark.read.schema(out.schema).parquet(f"{path}/batch=*").select("user_id", "event_id", "batch_no", "pos")


@query("b3_write_batched", """WITH RECURSIVE o AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT user_id, event_id, rn, us AS opened, 1 AS held, 0 AS batch_no, 0 AS pos FROM o WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN us ELSE opened END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 1 ELSE held + 1 END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 0 ELSE pos + 1 END
  FROM b JOIN o n ON n.user_id = b.user_id AND n.rn = b.rn + 1),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, batch_no) AS k, max(batch_no) OVER (PARTITION BY user_id) AS last,
  first_value(event_id) OVER (PARTITION BY user_id, batch_no ORDER BY pos) AS first FROM b)
SELECT user_id, event_id, user_id || '/' || opened || '/' || first AS batch_id, CAST(pos AS INTEGER) AS pos FROM c
WHERE batch_no < last OR k >= 4 OR opened + 108000000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""")
def _b3_written(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    out = fresh_dir(spark)
    sinks.run_once(batches.write_batched(rows, ["user_id"], "ts", ["event_id"], out, f"{out}/state", 4, "30h"))
    return batches.batched(spark, out).select("user_id", "event_id", "batch_id", "pos")


@query("d3_frontier_stream", f"""WITH {EVENTS}
SELECT topic, shard_id, greatest(coalesce(max(event_id + 1 - 10) FILTER (NOT process_error), 0), 0) AS committed FROM ev GROUP BY ALL""")
def _d3(spark, sf_dir):
    rows = D.ack_decision(event_stream(spark, sf_dir)).withColumn("offset", F.col("event_id"))
    out = twins.frontier_stream(rows, 10)
    return twins.latest_rows(spark, _run(spark, out, "update"), ("topic", "shard_id"), out.schema.add("batch", "integer"))


@query("d8_pending_stream", f"""WITH {EVENTS}
SELECT topic, shard_id, count(*) AS pending FROM ev WHERE process_error OR value < 10 GROUP BY ALL""")
def _d8(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id"))
    acks = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id")).filter(
        ~F.col("process_error") & (F.col("value") >= 10))
    out = twins.pending_stream(rows, acks)
    state = twins.latest_rows(spark, _run(spark, out, "update"), D.POSITION, out.schema.add("batch", "integer"))
    return state.filter(F.col("received") & ~F.col("acked")).groupBy("topic", "shard_id").agg(
        F.count(F.lit(1)).alias("pending"))


@query("d9_dedupe_stream", f"WITH {EVENTS} SELECT event_id, topic, body FROM ev")
def _d9(spark, sf_dir):
    # events of one topic lack a position
    rows = event_stream(spark, sf_dir).withColumn("offset", F.when(F.col("topic") != "error", F.col("event_id")))
    again = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id")).filter(F.col("topic") == "click")
    out = twins.dedupe_stream(rows.unionByName(again)).select("event_id", "topic", "body")
    return spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*")


@query("m6_rollup_stream", f"""WITH {EVENTS}, w AS (SELECT topic AS metric, epoch_us(ts) - epoch_us(ts) % 300000000 AS start_us, count(*) AS n,
  CAST(sum(user_id) AS BIGINT) AS total, min(user_id) AS low, max(user_id) AS high FROM ev GROUP BY ALL)
SELECT * FROM w WHERE start_us + 300000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM ev)""")
def _m6(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.col("topic").alias("metric"), "ts", F.col("user_id").alias("value"))
    out = twins.rollup_stream(rows, "5m")
    done = spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*")
    return done.select("metric", F.unix_micros("window_start").alias("start_us"), "n", "total", "low", "high")


@query("m9_stuck_stream", f"""WITH {EVENTS}, e AS (SELECT event_id, topic, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS end_us FROM ev),
w AS (SELECT least((SELECT max(us) FROM e), (SELECT max(end_us) FROM e WHERE topic <> 'error')) - 600000000 AS wm)
SELECT event_id FROM e, w WHERE (topic = 'error' OR end_us - us > 60000000) AND us + 60000000 < wm""")
def _m9(spark, sf_dir):
    starts = event_stream(spark, sf_dir).select("event_id", "ts")
    took = F.floor(F.col("value") * 1_000_000).cast("bigint")
    ends = event_stream(spark, sf_dir).filter(F.col("topic") != "error").select(
        "event_id", F.timestamp_micros(F.unix_micros("ts") + took).alias("ts"))
    out = twins.stuck_stream(starts, ends, "1m").select("event_id")
    return spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*")


def _check(context, event):
    value = event.offset % 20
    if value == 0:
        raise ValueError("bad event")
    return H.Response(event.body, headers={H.NO_ACK_HEADER: True} if value == 1 else {})


@query("process_stream_http", f"""WITH {EVENTS} SELECT count(*) AS success, count(DISTINCT event_id) AS ids FROM ev""")
def _process_http(spark, sf_dir):
    """Requests have no position; each is one handled event."""
    out = fresh_dir(spark)
    rows = to_envelope(event_stream(spark, sf_dir), {"ts": "ts", "path": "topic", "body": F.lit(b"same")}, "http", "web", trigger_class="sync")
    sinks.run_once(process.process_events(rows, lambda context, event: None, out, f"{out}/state"))
    ids = process.outcomes_of(spark, out).agg(F.countDistinct("id").alias("ids"))
    counts = process.handled(spark, out).filter("result = 'success'").agg(F.sum("value").cast("bigint").alias("success"))
    return counts.withColumn("ids", ids.scalar())


@query("process_stream", f"""WITH {EVENTS}, c AS (SELECT topic, shard_id, greatest(coalesce(max(event_id + 1) FILTER (event_id % 20 <> 1 AND event_id % 40 <> 2), 0), 0) AS committed,
  count(*) FILTER (event_id % 40 <> 2) AS success, count(*) FILTER (event_id % 40 = 2) AS failure, count(*) FILTER (event_id % 20 = 0 OR event_id % 40 = 2) AS answered_500 FROM ev GROUP BY ALL)
SELECT topic, shard_id, committed, answered_500, CAST(sum(success) OVER (PARTITION BY topic) AS BIGINT) AS success,
  CAST(sum(failure) OVER (PARTITION BY topic) AS BIGINT) AS failure FROM c""")
def _process(spark, sf_dir):
    out = fresh_dir(spark)
    broken = F.col("event_id") % 40 == 2
    rows = to_envelope(event_stream(spark, sf_dir), {
        "topic": "topic", "shard_id": "shard_id", "offset": "event_id", "ts": "ts",
        "content_type": F.when(broken, "application/cloudevents+json").otherwise("text/plain"),
        "body": F.when(broken, "{nope").otherwise(F.col("body"))}, "kafka-cluster", "k")
    sinks.run_once(process.process_events(rows, _check, out, f"{out}/state", "enable"))
    counts = process.handled(spark, out).groupBy("topic").pivot("result", ["success", "failure"]).sum("value")
    failed = process.outcomes_of(spark, out).groupBy("topic", "shard_id").agg(
        F.count_if(F.col("status_code") == 500).alias("answered_500"))
    return process.committed(spark, out).join(failed, ["topic", "shard_id"]).join(counts, "topic")


@query("s2_shard_log_stream", f"""WITH {LOG}, half AS (SELECT max(event_id) // 2 AS mid FROM log),
c AS (SELECT topic, shard_id, max("offset" + 1) FILTER (NOT process_error) AS committed FROM log, half WHERE event_id <= mid GROUP BY ALL)
SELECT l.event_id, l.topic, l.shard_id, l."offset" FROM log l LEFT JOIN c USING (topic, shard_id) WHERE l."offset" >= coalesce(committed, 0)""")
def _s2_log(spark, sf_dir):
    """The event log from the commits of its first half, in two runs: what comes between them is neither lost nor repeated."""
    out = fresh_dir(spark)
    rows = written(event_log(spark, sf_dir).select("event_id", "topic", "shard_id", "offset", "process_error"), "log")
    middle = F.floor(rows.agg(F.max("event_id")).scalar() / 2)
    first = rows.filter(F.col("event_id") <= middle)
    shard_log.commit_positions(D.commit_frontier(D.ack_decision(first)), f"{out}/commits")
    stream = shard_log.open_log(spark, f"{out}/log", rows.schema, "earliest", f"{out}/commits", f"{out}/progress", range_rows=1000)
    for part in (first, rows.filter(F.col("event_id") > middle)):
        shard_log.write_log(part, f"{out}/log")
        sinks.run_once(sinks.write_batches(stream, f"{out}/rows", f"{out}/state"))
    return spark.read.schema(rows.schema).parquet(f"{out}/rows/batch=*").select("event_id", "topic", "shard_id", "offset")


@query("d8_changes_stream", f"""WITH {EVENTS}
SELECT topic, shard_id, count(*) AS pending FROM ev WHERE process_error OR value < 10 GROUP BY ALL""")
def _d8_changes(spark, sf_dir):
    """As d8_pending_stream, with a state that is deleted when event and ack have met."""
    rows = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id"))
    acks = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id")).filter(~F.col("process_error") & (F.col("value") >= 10))
    out = lifecycle.event_changes(rows, acks)
    changes = spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*")
    return lifecycle.pending_now(changes).groupBy("topic", "shard_id").agg(F.count(F.lit(1)).alias("pending"))


@query("m9_stuck_changes_stream", f"""WITH {EVENTS}, e AS (SELECT event_id, topic, epoch_us(ts) AS us, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS end_us FROM ev),
w AS (SELECT greatest((SELECT max(us) FROM e), (SELECT max(end_us) FROM e WHERE topic <> 'error')) // 1000 * 1000 - 600000000 AS wm)
SELECT event_id FROM e, w WHERE CASE WHEN topic = 'error' THEN us + 60000000 <= wm ELSE end_us - us >= 60000000 END""")
def _m9_changes(spark, sf_dir):
    """Events not finished in time, found by a timer each; an event that was is forgotten."""
    rows = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id"))
    took = F.floor(F.col("value") * 1_000_000).cast("bigint")
    ends = event_stream(spark, sf_dir).withColumn("offset", F.col("event_id")).filter(F.col("topic") != "error").withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") + took))
    out = lifecycle.event_changes(rows, ends, "1m")
    return spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*").filter("change = 'stuck'").select(F.col("offset").alias("event_id"))


@query("h5_correlate_stream", f"""WITH {EVENTS}, e AS (
  SELECT event_id // 10 AS b, event_id, event_id % 11 AS n, epoch_us(ts) AS us, process_error FROM ev),
lost AS (SELECT b, min(us + 30000000) AS lost_us FROM e WHERE process_error GROUP BY 1),
wm AS (SELECT (max(us) + 120000000) // 1000 * 1000 - 600000000 AS wm FROM e),
waits AS (SELECT e.*, lost_us, CASE WHEN n IN (0, 1) THEN NULL WHEN n = 3 THEN us + 120000000 ELSE us + n * 5000000 END AS said FROM e LEFT JOIN lost USING (b)),
ends AS (SELECT *, CASE WHEN said < us + 60000000 THEN said END AS a, CASE WHEN lost_us < us + 60000000 THEN greatest(lost_us, us) END AS l FROM waits)
SELECT CAST(b AS VARCHAR) AS batch_id, CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN a IS NOT NULL AND a <= coalesce(lost_us, a) THEN CASE WHEN n = 2 THEN 'failure' ELSE 'success' END WHEN l IS NOT NULL THEN 'failure' ELSE 'timeout' END AS outcome,
  CASE WHEN a IS NOT NULL AND a <= coalesce(lost_us, a) THEN 200 + CAST(n AS INTEGER) WHEN l IS NOT NULL THEN NULL ELSE 408 END AS status_code
FROM ends, wm WHERE a IS NOT NULL OR l IS NOT NULL OR us + 60000000 <= wm
UNION ALL SELECT CAST(b AS VARCHAR), 'x' || event_id, 'orphan', 200 FROM e, wm WHERE n = 0 AND us + 600000000 <= wm""")
def _h5_stream(spark, sf_dir):
    """Answers in time, too late, for unknown events, missing, and whole batches that fail."""
    def rows():
        return event_stream(spark, sf_dir).withColumn("batch_id", F.floor(F.col("event_id") / 10).cast("bigint").cast("string"))

    def after(seconds):
        return F.timestamp_micros(F.unix_micros("ts") + (seconds * 1_000_000).cast("bigint"))

    n, text = F.col("event_id") % 11, F.col("event_id").cast("string")
    known = rows().select("batch_id", text.alias("event_id"), "ts")
    said = rows().filter(n != 1).select("batch_id", F.when(n == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("event_id"),
                                        after(F.when(n == 3, 120).otherwise(n * 5)).alias("ts"), (200 + n).cast("int").alias("status_code"),
                                        F.when(n == 2, "failed").alias("error"), F.lit(0).alias("answer_no"))
    again = said.withColumns({"answer_no": F.lit(1), "status_code": F.lit(599)})
    lost = rows().filter("process_error").select("batch_id", F.lit(None).cast("string").alias("event_id"), after(F.lit(30)).alias("ts"),
                                                 F.lit(500).alias("status_code"), F.lit("bad batch").alias("error"), F.lit(0).alias("answer_no"))
    out = lifecycle.correlate_stream(known, said.unionByName(again).unionByName(lost), "1m")
    return spark.read.schema(out.schema).parquet(f"{_run(spark, out)}/batch=*")


@query("d3_latest_table", f"""WITH {EVENTS}
SELECT topic, shard_id, greatest(coalesce(max(event_id + 1 - 10) FILTER (NOT process_error), 0), 0) AS committed FROM ev GROUP BY ALL""")
def _d3_table(spark, sf_dir):
    """As d3_frontier_stream, kept as snapshot and deltas; merged after each batch here."""
    rows = D.ack_decision(event_stream(spark, sf_dir)).withColumn("offset", F.col("event_id"))
    out, path = twins.frontier_stream(rows, 10), fresh_dir(spark)
    sinks.run_once(tables.write_latest(out, f"{path}/rows", f"{path}/state", ("topic", "shard_id"), merge_after=1))
    return tables.latest(spark, f"{path}/rows", ("topic", "shard_id"), out.schema)
