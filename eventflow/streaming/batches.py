"""Size-or-timeout batches on a stream: as state per key, or batch by batch for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventflow.functions.durations import duration_text_us
from eventflow.operators.batching import DEFAULT_SIZE, DEFAULT_TIMEOUT, assign_batches
from eventflow.operators.ordered import CHUNK_ROWS
from eventflow.sources.shard_log import file_place


def batch_stream(stream: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], size: int = DEFAULT_SIZE,
                 timeout: str = DEFAULT_TIMEOUT, delay: str = "10 minutes") -> DataFrame:
    """Closed batches of a stream: its rows with `batch_no` and `pos`, as in `assign_batches`.

    A batch closes at `size` rows, at a row `timeout` or more after its first, or when the
    watermark (`delay` behind the latest event) passes that time.  Rows of one micro-batch are put
    in order, so a task holds one key's rows of a micro-batch (the source bounds its size); a row
    later than the watermark is dropped.  State per key is one open batch, at most `size` rows.
    """
    keys, order, limit = list(keys), ["order_us", *tie], duration_text_us(timeout)
    rows = stream.withColumn("order_us", F.unix_micros(ts))
    names = [c for c in rows.columns if c not in keys]
    held_type = T.ArrayType(T.StructType([rows.schema[c] for c in names]))
    state_type = T.StructType([T.StructField("opened", T.LongType()), T.StructField("batch_no", T.LongType()),
                               T.StructField("held", held_type)])
    out_type = T.StructType([*rows.schema, T.StructField("batch_no", T.LongType()), T.StructField("pos", T.IntegerType())])

    def frame(key: tuple, batches: list[tuple[int, list[tuple]]]) -> pd.DataFrame:
        made = [(*row, number, pos) for number, held in batches for pos, row in enumerate(held)]
        out = pd.DataFrame(made, columns=[*names, "batch_no", "pos"], dtype="object")
        for name, value in zip(keys, key):
            out[name] = value
        return out[out_type.names]

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, number, held = state.get if state.exists else (0, -1, [])
        held = [tuple(r) for r in held]
        closed = []
        if not state.hasTimedOut:
            fresh = pd.concat(list(parts)).sort_values(order)
            for now, row in zip(fresh["order_us"].tolist(), fresh[names].itertuples(index=False, name=None)):
                if held and (len(held) >= size or now - opened >= limit):
                    closed.append((number, held))
                    held = []
                if not held:
                    opened, number = now, number + 1
                held.append(row)
        # whole milliseconds, never before the timeout
        due = -(-(opened + limit) // 1000)
        if held and (len(held) >= size or due <= state.getCurrentWatermarkMs()):
            closed.append((number, held))
            held = []
        state.update((opened, number, held))
        if held:
            state.setTimeoutTimestamp(due)
        if closed:
            yield frame(key, closed)

    return (rows.withWatermark(ts, delay).groupBy(*keys)
            .applyInPandasWithState(take, out_type, state_type, "append", GroupStateTimeout.EventTimeTimeout)
            .drop("order_us"))


def write_batched(stream: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], path: str, checkpoint: str,
                  size: int = DEFAULT_SIZE, timeout: str = DEFAULT_TIMEOUT, delay: str = "10m",
                  chunk_rows: int = CHUNK_ROWS) -> DataStreamWriter:
    """The same batches for keys too busy for one task, written to ``closed`` below `path`.

    Each micro-batch joins its rows to the ``open`` ones of the micro-batch before (less than
    `size` per key) and batches them with `assign_batches`, which spreads a hot key over tasks.
    Rows get `batch_id` (key values, the microsecond the batch opened, `tie` of its first row) and
    `pos`.  Rows later than the watermark are dropped.  A micro-batch that runs again replaces its
    folders.  Its work tables are removed once its batches are written, and so are the open rows and the watermark of
    micro-batches that cannot run again: only ``closed`` grows.
    """
    keys, tie, limit, late = list(keys), list(tie), duration_text_us(timeout), duration_text_us(delay)
    schema, batch_keys = stream.schema, [*keys, "batch_no"]

    def save(fresh: DataFrame, batch_id: int) -> None:
        spark = fresh.sparkSession

        def folder(name: str, number: int = batch_id) -> str:
            return f"{path}/{name}/batch={number}"

        rows, mark = fresh, None
        if batch_id > 0:
            mark = spark.read.schema("mark bigint").parquet(folder("mark", batch_id - 1)).first()["mark"]
            held = spark.read.schema(schema).parquet(folder("open", batch_id - 1))
            rows = (fresh if mark is None else fresh.filter(F.unix_micros(ts) >= mark)).unionByName(held)
        rows.write.mode("overwrite").parquet(folder("rows"))
        rows = spark.read.schema(schema).parquet(folder("rows"))
        last = rows.agg(F.max(F.unix_micros(ts)) - late).first()[0]
        mark = max((m for m in (mark, last) if m is not None), default=None)
        spark.createDataFrame([(mark,)], "mark bigint").coalesce(1).write.mode("overwrite").parquet(folder("mark"))

        numbered = assign_batches(rows, keys, ts, tie, size, timeout, chunk_rows).drop("batch_id")
        numbered.write.mode("overwrite").parquet(folder("numbered"))
        numbered = spark.read.schema(numbered.schema).parquet(folder("numbered"))
        batches = numbered.groupBy(*batch_keys).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(ts)).alias("opened"),
            F.min_by(F.concat_ws("/", *[F.col(c).cast("string") for c in tie]), "pos").alias("first"))
        newest = batches.groupBy(*keys).agg(F.max("batch_no").alias("batch_no"))
        waiting = (F.col("n") < size) & (F.col("opened") + limit > F.lit(mark))
        # groups of (key, batch) are at most `size` rows, so these joins have no hot keys
        open_now = batches.filter(waiting).join(newest, batch_keys, "left_semi").select(*batch_keys)
        numbered.join(open_now, batch_keys, "left_semi").select(*schema.names).write.mode("overwrite").parquet(folder("open"))
        done = numbered.join(batches, batch_keys).join(open_now, batch_keys, "left_anti")
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("opened").cast("string"), "first")
        done.select(*schema.names, name.alias("batch_id"), "pos").write.mode("overwrite").parquet(folder("closed"))

        for kind, number in (("rows", batch_id), ("numbered", batch_id), ("open", batch_id - 2), ("mark", batch_id - 2)):
            files, old = file_place(folder(kind, number))
            if files.get_file_info(old).type == pyarrow.fs.FileType.Directory:
                files.delete_dir(old)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def batched(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all closed batches that `write_batched` wrote."""
    return spark.read.parquet(f"{path}/closed/batch=*")
