"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventflow.operators.ordered import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Input for Python work: a table of fewer files than cores is spread over the cores.

    Larger tables have tasks enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as outcomes: no shuffle, positions are the event ids."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 8).cast("int").alias("shard_id"),
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "value",
        F.col("props").alias("body"), (value > 150).alias("process_error"),
        F.when(value > 150, 500).when(value > 100, 404).otherwise(200).alias("status_code"),
        F.floor(value).cast("bigint").alias("duration_ms"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with dense offsets from 0 per (topic, shard_id)."""
    numbered = ordered(events(spark, sf_dir), ["topic", "shard_id"], ["event_id"]).row_number("offset").result()
    return numbered.withColumn("offset", F.col("offset") - 1)


# the same inputs for the SQL side
EVENTS = """ev AS (
  SELECT event_id, event_type AS topic, CAST(user_id % 8 AS INTEGER) AS shard_id, ts, user_id, value,
         props AS body, value > 150 AS process_error,
         CASE WHEN value > 150 THEN 500 WHEN value > 100 THEN 404 ELSE 200 END AS status_code,
         CAST(floor(value) AS BIGINT) AS duration_ms
  FROM events)"""

LOG = EVENTS + """, log AS (
  SELECT *, row_number() OVER (PARTITION BY topic, shard_id ORDER BY event_id) - 1 AS "offset" FROM ev)"""
