"""A stream of events through a handler, with commit positions and counts, one folder per batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from eventflow.operators.delivery import POSITION, ack_decision, commit_frontier, dedupe
from eventflow.operators.envelope import ensure_id, unwrap_cloudevents
from eventflow.operators.handlers import map_handler
from eventflow.operators.metrics import handled_events

LABELS = ("trigger_kind", "trigger_name", "topic")


COMMITS = "topic string, shard_id int, committed bigint"
COUNTS = "trigger_kind string, trigger_name string, topic string, result string, value bigint"


def handle(events: DataFrame, handler: Callable, init_context: Callable | None = None,
           registry: Mapping[str, Callable] | None = None) -> DataFrame:
    """Events to outcomes: unwrap cloud events, give ids, run the handler.

    A handler's exception is an answer, so its `process_error` is null.  An event that cannot be
    unwrapped does not reach the handler; its error is a process error.
    """
    prepared = ensure_id(unwrap_cloudevents(events))
    kept = (*POSITION, "trigger_kind", "trigger_name", "ts", "id")
    answers = map_handler(prepared.filter(F.col("decode_error").isNull()), handler, init_context, keep=kept,
                          registry=registry).withColumn("process_error", F.lit(None).cast("string"))
    broken = prepared.filter(F.col("decode_error").isNotNull()).select(
        *kept, F.col("id").alias("event_id"), F.lit(500).alias("status_code"), F.col("decode_error").alias("process_error"))
    return answers.unionByName(broken, allowMissingColumns=True)


def process_events(stream: DataFrame, handler: Callable, path: str, checkpoint: str, ack_mode: str = "disable",
                   window: int = 0, style: str = "kafka", init_context: Callable | None = None,
                   registry: Mapping[str, Callable] | None = None) -> DataStreamWriter:
    """Run a handler over a stream of events and keep what came of it.

    Each micro-batch writes ``outcomes`` (its answers) and, from those and the folders of the batch
    before, ``commits`` (position per topic and shard) and ``handled`` (counts by label) as they
    stand after it.  The handler runs once per attempt, as the tables read the written outcomes.  A
    batch that runs again replaces its folders; older folders may be removed at any time.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

        def before(name: str, schema: str) -> DataFrame:
            if batch_id == 0:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(f"{path}/{name}/batch={batch_id - 1}")

        outcomes = handle(batch, handler, init_context, registry)
        write(outcomes, "outcomes")
        written = spark.read.schema(outcomes.schema).parquet(f"{path}/outcomes/batch={batch_id}")
        write(commit_frontier(ack_decision(written, ack_mode), window, style, before("commits", COMMITS)), "commits")
        # an event with a list of answers is one handled event; without a position its id tells it from others
        once = dedupe(written.select(*POSITION, *LABELS[:2], "process_error", "id").withColumn("offset", F.coalesce("offset", F.lit(-1)))
                      .withColumns({"topic": F.coalesce("topic", F.lit("")), "shard_id": F.coalesce("shard_id", F.lit(-1))}), (*POSITION, "id"))
        once = once.withColumn("topic", F.when(F.col("topic") != "", F.col("topic")))
        counts = handled_events(once, labels=LABELS).unionByName(before("handled", COUNTS))
        write(counts.groupBy(*LABELS, "result").agg(F.sum("value").alias("value")), "handled")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def outcomes_of(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes written so far."""
    return spark.read.parquet(f"{path}/outcomes/batch=*")


def _newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """Commit position per topic and shard after the newest batch; it never moves back."""
    return _newest(spark, f"{path}/commits", COMMITS)


def handled(spark: SparkSession, path: str) -> DataFrame:
    """Handled events by label and result after the newest batch."""
    return _newest(spark, f"{path}/handled", COUNTS)
