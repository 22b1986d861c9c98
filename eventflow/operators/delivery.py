"""What a delivered event means for its source: acks, commits, lag, redelivery, order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from eventflow.operators.ordered import CHUNK_ROWS, count_not_after, ordered
from eventflow.operators.prefix import Walk, scan_rows

SHARD = ("topic", "shard_id")
POSITION = ("topic", "shard_id", "offset")


def has_error(df: DataFrame, name: str) -> Column:
    """True where an error column (boolean, or text with null for none) tells of an error."""
    if name not in df.columns:
        return F.lit(False)
    if dict(df.dtypes)[name] == "boolean":
        return F.coalesce(F.col(name), F.lit(False))
    return F.col(name).isNotNull() & (F.col(name) != "")


def ack_decision(outcomes: DataFrame, mode: str | Column = "disable") -> DataFrame:
    """Add `acked`: whether the event's position is marked without an explicit ack.

    ``enable`` also honours `no_ack` (a boolean column); ``explicitOnly`` never marks; any other
    mode acts as ``disable``.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    no_error = ~has_error(outcomes, "process_error") & ~has_error(outcomes, "submit_error")
    no_ack = F.coalesce(F.col("no_ack"), F.lit(False)) if "no_ack" in outcomes.columns else F.lit(False)
    return outcomes.withColumn("acked", F.when(mode == "explicitOnly", F.lit(False))
                               .when(mode == "enable", no_error & ~no_ack)
                               .otherwise(no_error))


def disposition(outcomes: DataFrame, kind: str = "kind") -> DataFrame:
    """Add `disposition`: what the source is told about each event, by source kind.

    ``none`` means the source has no acknowledgement and the event reached a worker.
    """
    submit, process = has_error(outcomes, "submit_error"), has_error(outcomes, "process_error")
    k = F.col(kind)
    return outcomes.withColumn("disposition", F.when(
        k == "rabbit-mq", F.when(submit, "unacked").otherwise("ack")).when(
        k == "pubsub", F.when(submit | process, "nack").otherwise("ack")).when(
        k == "eventhub", F.lit("ack")).when(
        k == "kinesis", F.lit("advance")).when(
        k.isin("nats", "mqtt"), F.when(submit, "lost").otherwise("none")))


def _next_position(offset: Column, window: int, style: str) -> Column:
    if style == "kafka":
        return offset + 1 - window
    if style == "stream":
        return F.when(offset >= window, offset - window)
    raise ValueError(f"unknown commit style: {style}")


def commit_frontier(outcomes: DataFrame, window: int = 0, style: str = "kafka",
                    prior: DataFrame | None = None) -> DataFrame:
    """Committed position per (topic, shard_id) after the acked events.

    Kafka style commits the next offset less the ack window; stream style commits the sequence
    number less the window once there are that many.  A shard without such an event has no row, as
    nothing is marked there.  The position is never negative and never
    below `prior` (topic, shard_id, committed).  A plain maximum: late rows do no harm, and the
    same call works on a streaming frame in update mode (without `prior`).
    """
    reached = F.max(F.when(F.col("acked"), _next_position(F.col("offset"), window, style)))
    out = outcomes.groupBy(*SHARD).agg(
        F.when(reached.isNotNull(), F.greatest(reached, F.lit(0))).cast("bigint").alias("committed")).filter("committed is not null")
    if prior is None:
        return out
    before = prior.select(*SHARD, F.col("committed").alias("__prior"))
    return out.join(before, list(SHARD), "full_outer").select(
        *SHARD, F.greatest("committed", "__prior").cast("bigint").alias("committed"))


def apply_acks(acks: DataFrame, claims: DataFrame, window: int = 0, style: str = "kafka") -> DataFrame:
    """Committed position per claimed (topic, shard_id) from explicit ack messages.

    Messages for other topics and shards are ignored.  In stream style the topic ``/`` stands for
    every claimed topic, and the ack window applies.
    """
    acks = acks.filter(F.col("kind") == "streamMessageAck")
    position = F.col("offset") + 1 if style == "kafka" else _next_position(F.col("offset"), window, style)
    # one row per (topic, shard) before the join, so a hot shard costs nothing there
    reached = acks.groupBy(*SHARD).agg(F.max(position).alias("committed"))
    mine = claims.select(*SHARD).distinct()
    out = mine.join(reached, list(SHARD), "inner")
    if style == "stream":
        anywhere = (reached.filter(F.col("topic") == "/").drop("topic")
                    .join(mine, "shard_id").select(*SHARD, "committed"))
        out = out.unionByName(anywhere).groupBy(*SHARD).agg(F.max("committed").alias("committed"))
    return out.filter(F.col("committed").isNotNull()).select(*SHARD, F.col("committed").cast("bigint"))


def shard_lags(current: DataFrame, committed: DataFrame, keys: tuple[str, ...] = SHARD) -> DataFrame:
    """`current - committed` per shard; a shard without a commit has committed 0."""
    return current.join(committed.select(*keys, "committed"), list(keys), "left").select(
        *keys, "current", F.coalesce("committed", F.lit(0)).cast("bigint").alias("committed"),
        (F.col("current") - F.coalesce("committed", F.lit(0))).cast("bigint").alias("lag"))


def lag_metrics(positions: DataFrame, labels: tuple[str, ...] = ("function", "trigger")) -> DataFrame:
    """Processed and committed high-water lag per label set, one metric per row.

    `positions` has current, processed and committed per shard; the shards of a label set add up.
    """
    sums = positions.groupBy(*labels).agg(
        F.sum(F.col("current") - F.coalesce("processed", F.lit(0))).alias("stream_high_water_mark_processed_lag"),
        F.sum(F.col("current") - F.coalesce("committed", F.lit(0))).alias("stream_high_water_mark_committed_lag"))
    return sums.unpivot(list(labels), ["stream_high_water_mark_processed_lag",
                                       "stream_high_water_mark_committed_lag"], "metric", "value")


def redelivered(log: DataFrame, commits: DataFrame, style: str = "kafka", most: int = 100_000) -> DataFrame:
    """Records delivered (again) after a restart: Kafka from the committed offset on, stream after it.

    Shards without a commit are delivered whole.  `commits` has a row per shard; it is counted, and
    up to `most` rows are broadcast, so that the log is not shuffled.  Beyond, the join is Spark's choice.
    """
    at = commits.select(*SHARD, F.col("committed").alias("__committed"))
    past = (F.col("offset") >= F.col("__committed")) if style == "kafka" else (F.col("offset") > F.col("__committed"))
    at = F.broadcast(at) if at.limit(most + 1).count() <= most else at
    return (log.join(at, list(SHARD), "left").filter(F.col("__committed").isNull() | past).drop("__committed"))


def pending(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events received and not acked yet.  Repeated acks are combined before the shuffle."""
    return events.join(acks.select(*POSITION).distinct(), list(POSITION), "left_anti")


def pending_size(events: DataFrame, acks: DataFrame) -> DataFrame:
    """How many events are pending per (topic, shard_id)."""
    return pending(events, acks).groupBy(*SHARD).agg(F.count(F.lit(1)).alias("pending"))


def dedupe(df: DataFrame, columns: tuple[str, ...] = POSITION) -> DataFrame:
    """One row per (topic, shard_id, offset).  Copies are combined before the shuffle.

    A row that lacks one of these is no copy of another and stays.
    """
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    if df.isStreaming:  # no column may be added to what the state is kept by
        return df.filter(whole).dropDuplicates(list(columns)).union(df.filter(~whole))
    return df.withColumn("__own", F.when(~whole, F.uuid())).dropDuplicates([*columns, "__own"]).drop("__own")


FEW_SIGNALS = 100_000


def discard_drained(events: DataFrame, signals: DataFrame, chunk_rows: int = CHUNK_ROWS, few: int = FEW_SIGNALS) -> DataFrame:
    """Drop events that arrive while their worker is drained or terminating.

    The latest signal at or before the event decides: ``drain`` and ``terminate`` drop it,
    ``continue`` or no signal keeps it.  On equal times the signal comes first; of several signals
    at one time the most severe counts.  The signals are counted: up to `few` are an index, a sorted array
    per worker that is broadcast and searched by halves, and the events stay where they are.  More are an as-of join as a
    union in time order, cut into chunks so that a busy worker is no single task.
    """
    marks = signals.groupBy("worker", "ts").agg(F.max("signal").alias("__signal"))
    if marks.limit(few + 1).count() <= few:
        return _discard_indexed(events, marks)
    marks = marks.withColumns({"__side": F.lit(0), "__tie": F.lit(0).cast("bigint")})
    plain = [name for name, kind in events.dtypes if not kind.startswith(("map", "variant", "struct", "array"))]
    both = (events.withColumns({"__signal": F.lit(None).cast("string"), "__side": F.lit(1),
                                "__tie": F.xxhash64(*plain)})
            .unionByName(marks, allowMissingColumns=True))
    scan = (ordered(both, ["worker"], ["ts", "__side", "__tie"], chunk_rows)
            .last_value("__signal", "__state").result())
    dropped = F.coalesce(F.col("__state").isin("drain", "terminate"), F.lit(False))
    return scan.filter((F.col("__side") == 1) & ~dropped).drop("__signal", "__side", "__tie", "__state")


def _discard_indexed(events: DataFrame, marks: DataFrame) -> DataFrame:
    mark = F.struct(F.col("ts").alias("t"), F.col("__signal").alias("s"))
    index = marks.filter("ts is not null").groupBy(F.col("worker").alias("__worker")).agg(F.sort_array(F.collect_list(mark)).alias("__marks"))
    index = index.select("__worker", F.transform("__marks", lambda m: m["t"]).alias("__times"), F.transform("__marks", lambda m: m["s"]).alias("__signals"))
    most = index.agg(F.max(F.size("__times"))).first()[0] or 0
    rows = events.join(F.broadcast(index), F.col("worker").eqNullSafe(F.col("__worker")), "left")
    passed = F.when(F.col("ts").isNotNull(), count_not_after(F.col("__times"), F.size("__times"), F.col("ts"), most))
    signal = F.get("__signals", passed - 1)
    return rows.filter(~F.coalesce(signal.isin("drain", "terminate"), F.lit(False))).drop("__worker", "__times", "__signals")


def ordered_apply(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str,
                  partitions: int | None = None, independent: bool = False) -> DataFrame:
    """Run `fn` over Arrow batches whose rows follow (topic, shard_id, offset).

    All rows of a shard are handled by one call of `fn`, one after another, so `fn` may keep state
    from row to row; a call may see several shards, one behind the other.  A large shard is then one
    long task.  With `independent`, ranges of the order are tasks and a large shard is spread over
    several, for an `fn` that handles each row on its own.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *(POSITION if independent else SHARD)).sortWithinPartitions(*POSITION)
    return placed.mapInPandas(fn, schema)


def ordered_scan(df: DataFrame, walk: Walk, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with a running state of each (topic, shard_id) in offset order, as columns.

    Where `ordered_apply` handles a shard in one task, this handles a busy shard in many: `walk` also says how the states of two
    runs of events combine (see `prefix.Walk`).  Offsets must be unique within a shard.
    """
    return scan_rows(df, SHARD, ["offset"], walk, chunk_rows)


def assign_workers(claims: DataFrame, workers: int | None = None, replicas: int | None = None,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `worker`: the claim's position within its topic, modulo the number of workers.

    Without `workers` the number is ``ceil(shards / replicas * 1.2)`` over the claimed shards of
    the topic.
    """
    if (workers is None) == (replicas is None):
        raise ValueError("give either workers or replicas")
    numbered = ordered(claims, ["topic"], ["pos"], chunk_rows).row_number("__n").result()
    if workers is not None:
        return numbered.withColumn("worker", ((F.col("__n") - 1) % workers).cast("int")).drop("__n")
    counts = claims.groupBy("topic").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(replicas) * F.lit(1.2)).alias("__w"))
    return (numbered.join(counts, "topic")
            .withColumn("worker", ((F.col("__n") - 1) % F.col("__w")).cast("int")).drop("__n", "__w"))
