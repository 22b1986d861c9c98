"""Batches over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import batching as B
from eventflow.plans import chunked, query
from eventflow.plans.tables import events


@query("b1_assign_batches", """WITH RECURSIVE o AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT user_id, event_id, rn, us AS opened, 1 AS held, 0 AS batch_no, 0 AS pos FROM o WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN us ELSE opened END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 1 ELSE held + 1 END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN batch_no + 1 ELSE batch_no END,
    CASE WHEN held >= 4 OR us - opened >= 108000000000 THEN 0 ELSE pos + 1 END
  FROM b JOIN o n ON n.user_id = b.user_id AND n.rn = b.rn + 1)
SELECT user_id, event_id, CAST(batch_no AS BIGINT) AS batch_no, CAST(pos AS INTEGER) AS pos, user_id || '/' || batch_no AS batch_id FROM b""")
def _b1(spark, sf_dir, **chunks):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts")
    return B.assign_batches(rows, ["user_id"], "ts", ["event_id"], 4, "30h", **chunks).select(
        "user_id", "event_id", "batch_no", "pos", "batch_id")


chunked("b1_assign_batches", _b1)


@query("b2_assign_poll_batches", """WITH o AS (SELECT event_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS cycle,
  row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) - 1 AS rn FROM events)
SELECT 'max' AS rule, event_id, cycle, rn // 5 AS batch_no, CAST(rn % 5 AS INTEGER) AS pos FROM o
UNION ALL SELECT 'one over', event_id, cycle, rn // 6, CAST(rn % 6 AS INTEGER) FROM o""")
def _b2(spark, sf_dir):
    cycle = F.floor(F.unix_micros("ts") / 3_600_000_000).cast("bigint")
    rows = events(spark, sf_dir).select("event_id", "ts", cycle.alias("cycle"))
    plain = B.assign_poll_batches(rows, "cycle", "ts", ["event_id"], 5).withColumn("rule", F.lit("max"))
    over = B.assign_poll_batches(rows, "cycle", "ts", ["event_id"], 5, one_over=True).withColumn("rule", F.lit("one over"))
    return plain.unionByName(over).select("rule", "event_id", "cycle", "batch_no", "pos")
