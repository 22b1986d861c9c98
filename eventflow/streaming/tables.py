"""Tables kept by update-mode streams: a snapshot, the batches since, and a pointer to the snapshot that counts.

Each micro-batch writes its rows as one folder.  When there are `merge_after` of them, snapshot and folders become the next snapshot,
the pointer moves on, and what the pointer before last needed is removed.  So a table that is read after a year costs its rows, and
a few folders.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from eventflow.sources.shard_log import file_place, read_positions, write_positions

MERGE_AFTER = 10


def _folders(path: str, prefix: str) -> dict[int, str]:
    """Numbered folders below `path` that were written whole."""
    files, root = file_place(path)
    infos = files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    named = {int(i.base_name.removeprefix(prefix)): i.path for i in infos if i.type == pyarrow.fs.FileType.Directory and i.base_name.startswith(prefix)}
    done = files.get_file_info([f"{p}/_SUCCESS" for p in named.values()])
    return {n: p for (n, p), i in zip(named.items(), done) if i.type == pyarrow.fs.FileType.File}


def _newest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    values = [c for c in columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in columns])


def _rows(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, upto: int) -> DataFrame:
    """The newest row per key of the snapshot that counts and the batches after it."""
    deltas = _folders(f"{path}/delta", "batch=")
    parts = [spark.read.schema(schema).parquet(f"{path}/delta/batch={n}").withColumn("batch", F.lit(n)) for n in sorted(deltas) if n > upto]
    if upto >= 0:
        parts.append(spark.read.schema(schema).parquet(f"{path}/snapshot/upto={upto}").withColumn("batch", F.lit(upto)))
    rows = spark.createDataFrame([], schema).withColumn("batch", F.lit(-1))
    for part in parts:  # at most `MERGE_AFTER` and one
        rows = rows.unionByName(part)
    return _newest(rows, keys, schema.names)


def _pointer(path: str) -> int:
    return read_positions(f"{path}/pointer").get("upto", -1)


def write_latest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], merge_after: int = MERGE_AFTER,
                 gone: Column | None = None) -> DataStreamWriter:
    """Keep the newest row per key of an update-mode stream; rows for which `gone` holds leave the table at the next merge.

    A batch that runs again replaces its folder, or is passed over if the snapshot has it already.  Keys may be null.
    """
    schema = stream.schema

    def save(batch: DataFrame, number: int) -> None:
        spark, upto = batch.sparkSession, _pointer(path)
        if number <= upto:  # its rows are in the snapshot; its state is still to be made
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.write.mode("overwrite").parquet(f"{path}/delta/batch={number}")
        if number - upto < merge_after:
            return
        rows = _rows(spark, path, keys, schema, upto)
        if gone is not None:
            rows = rows.filter(~F.coalesce(gone, F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{path}/snapshot/upto={number}")
        write_positions({"upto": number}, f"{path}/pointer")
        # readers of the pointer before may still be at its snapshot and the batches behind it
        files, _ = file_place(path)
        for folder, prefix, keep in (("delta", "batch=", upto), ("snapshot", "upto=", upto - 1)):
            for n, old in _folders(f"{path}/{folder}", prefix).items():
                if n <= keep:
                    files.delete_dir(old)

    return stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """The table as the batches so far have left it."""
    return _rows(spark, path, keys, schema, _pointer(path))
