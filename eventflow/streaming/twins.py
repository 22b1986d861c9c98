"""Streaming forms of delivery and metric operators, all built-in aggregates and joins.

Late rows: windowed and de-duplicating operators drop rows behind the watermark; the commit
frontier and the pending table keep them, as a maximum does not depend on order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventflow.functions.durations import duration_text_us
from eventflow.operators.delivery import POSITION, commit_frontier

DELAY = "10 minutes"


def frontier_stream(outcomes: DataFrame, window: int = 0, style: str = "kafka") -> DataFrame:
    """Committed position per (topic, shard_id); write in update mode."""
    return commit_frontier(outcomes, window, style)


def pending_stream(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Which positions were received and which acked; write in update mode.

    A position is pending while `received` and not `acked`.  Acks may come before their event.
    """
    both = (events.select(*POSITION, F.lit(1).alias("received"), F.lit(0).alias("acked"))
            .unionByName(acks.select(*POSITION, F.lit(0).alias("received"), F.lit(1).alias("acked"))))
    return both.groupBy(*POSITION).agg((F.max("received") == 1).alias("received"), (F.max("acked") == 1).alias("acked"))


def dedupe_stream(stream: DataFrame, ts: str = "ts", delay: str = DELAY,
                  columns: Sequence[str] = POSITION) -> DataFrame:
    """One row per position, for copies that come within the watermark delay.

    A row that lacks a part of its position is no copy of another and stays; the stream is read twice for that.
    """
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    once = stream.filter(whole).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(columns))
    return once.union(stream.filter(~whole).withWatermark(ts, delay))


def rollup_stream(metrics: DataFrame, size: str, keys: Sequence[str] = ("metric",), ts: str = "ts",
                  value: str = "value", delay: str = DELAY) -> DataFrame:
    """Count, sum, minimum and maximum per key and window; rows later than the watermark are dropped."""
    micros = duration_text_us(size)
    return metrics.withWatermark(ts, delay).groupBy(*keys, F.window(ts, f"{micros} microseconds").alias("w")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"),
        F.max(value).alias("high")).select(*keys, F.col("w.start").alias("window_start"), "n", "total", "low", "high")


def stuck_stream(starts: DataFrame, ends: DataFrame, timeout: str, delay: str = DELAY) -> DataFrame:
    """Started events (event_id, ts) without an end within `timeout`.

    A row comes out once the watermark passes the start plus the timeout.
    """
    micros = duration_text_us(timeout)
    s = starts.select("event_id", "ts").withWatermark("ts", delay).alias("s")
    e = ends.select(F.col("event_id").alias("end_id"), F.col("ts").alias("end_ts")).withWatermark("end_ts", delay).alias("e")
    limit = F.expr(f"INTERVAL '{micros / 1e6:.6f}' SECOND")
    within = (F.col("event_id") == F.col("end_id")) & (F.col("end_ts") >= F.col("ts")) & (F.col("end_ts") <= F.col("ts") + limit)
    return s.join(e, within, "left_outer").filter(F.col("end_id").isNull()).select("event_id", "ts")


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str], schema) -> DataFrame:
    """The newest row per key of an update-mode stream written by `write_batches`."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
    return newest.select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])
