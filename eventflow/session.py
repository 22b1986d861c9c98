"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Every entry is a public Spark setting.  None of them changes results; they keep hot keys,
# spills and streaming state under control on a large cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # building a plan records no call sites, which makes wide plans much quicker to build
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # large streaming state stays out of the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "eventflow", master: str | None = None, **overrides: str) -> SparkSession:
    """Create (or reuse) a session with `SETTINGS`; keyword names use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in overrides.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in this store, outside the heap.

    A session made elsewhere has another default; streams that go on from a checkpoint keep the store they began with.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, however often it is read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates and streaming checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master without that setting
    falls back to a fresh temporary folder; a cluster without it is refused, because a folder on
    one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="eventflow-")
