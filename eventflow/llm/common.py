"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


FILE_ROWS = 250_000


def stored(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """`df` written to the cluster's shared folder and read back.

    Cuts the lineage and fixes row numbers: what follows reads files that outlive any executor.  Where it is known that there
    are at most `most` (short) rows, they are written by no more tasks than these need.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def filled(column: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def matching(df: DataFrame, keys: DataFrame, on: list[str], bound: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of a wide table with keys (a stored table): keys are broadcast up to `bound` rows, else shuffled.

    Either way the same rows come out.
    """
    few = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def kept() -> dict:
    """What a worker process keeps from task to task.

    Functions that are sent with a task bring module variables of their own, which end with it; so this lies in a module.
    """
    return sys.modules.setdefault("eventflow_kept", ModuleType("eventflow_kept")).__dict__.setdefault("objects", {})


def remembered(kind: type, *key):
    """One object per worker process and key."""
    name, held = (kind.__module__, kind.__qualname__, *key), kept()
    if name not in held:
        held[name] = kind(*key)
    return held[name]


def give_back() -> None:
    """Return freed memory to the system, which Arrow's and C's allocators would keep until the worker ends."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def forget(but: type | None = None) -> None:
    """Give up what earlier operators keep in this worker, other than remembered objects of the kind `but`."""
    held, stays = kept(), but and (but.__module__, but.__qualname__)
    if gone := [name for name in held if name[:2] != stays]:
        for name in gone:
            del held[name]
        gc.collect()
    give_back()  # also what the last task has freed


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of at most about `most` of texts go to the workers, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def built(make: Callable, sent):
    """What `make` makes of a broadcast's plain value, made once in a worker; of each `make` only the newest is kept."""
    name, value, held = (make.__module__, make.__qualname__), sent.value, kept()
    if name not in held or held[name][0] is not value:
        held[name] = (value, make(value))
    return held[name][1]


def text_groups(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of an Arrow column in lists of about `limit` bytes of UTF-8, nulls as empty texts; a longer text is alone.

    Only the texts of one list are Python strings at a time.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        before = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield [t or "" for t in column.slice(begin, stop - begin).to_pylist()]
        begin = stop
