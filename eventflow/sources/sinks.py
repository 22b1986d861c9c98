"""Streaming sinks that survive a repeated batch, and one-shot runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from eventflow.schema import RECORDED


def run_once(writer: DataStreamWriter, timeout: int | None = None) -> StreamingQuery:
    """Process everything that is there, then stop; with `timeout`, give up after that many seconds."""
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the one-shot run did not finish in time")
    return query


def write_batches(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    """Write each micro-batch to its own folder of `path`.

    A batch that runs again replaces its folder, so a record appears once.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite").format(fmt)
        if fmt == "json":
            writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        writer.save(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def record_events(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Record body, headers and time of every event that is not an HTTP request."""
    rows = stream.filter(F.col("trigger_kind") != "http").select(
        F.col("body").cast("string").alias("body"), "headers", F.col("ts").alias("timestamp"))
    return write_batches(rows, path, checkpoint, "json")


def read_recorded(spark: SparkSession, path: str, ignore: str | None = None) -> DataFrame:
    """The recorded events in time order, without those whose body is `ignore`."""
    rows = spark.read.schema(RECORDED).json(f"{path}/batch=*")
    if ignore is not None:
        rows = rows.filter(~F.col("body").eqNullSafe(ignore))
    return rows.orderBy("timestamp", "body")


def forward(stream: DataFrame, target: Mapping, payload: tuple[str, ...], checkpoint: str,
            key: str | None = None) -> DataStreamWriter:
    """Send processed rows to another stream as key and JSON value.

    `target` is a Kafka-style binding (`kind`, `options`) or a ``landing`` folder (`path`).
    """
    rows = stream.select(
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.to_json(F.struct(*payload)).alias("value"))
    if target["kind"] == "landing":
        return write_batches(rows, target["path"], checkpoint)
    return rows.writeStream.format("kafka").options(**target["options"]).option("checkpointLocation", checkpoint)
