"""Incremental polling of an item table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SYSTEM_COLUMNS = ("__name", "__mtime_secs", "__mtime_nsecs", "__obj_type", "__size")


def poll_items(items: DataFrame, stamps: DataFrame | None = None, paths: Sequence[str] = (),
               suffixes: Sequence[str] = (), predicates: Sequence[str | Column] = (),
               attributes: Sequence[str] = (), incremental: bool = True, shard: int = 0, shards: int = 1,
               since: int | None = None) -> DataFrame:
    """Items to process, with the system columns and the requested attributes.

    Keeps items below any of `paths`, with any of `suffixes`, for which every predicate holds, and,
    if incremental, changed after the stamp of the last successful run (second, then nanosecond).
    Without stamps (the first poll) the change test is skipped.  The name and predicate filters
    come before the join and reach the scan.

    `shards` pollers share the items: this one, number `shard`, takes those that `owner` gives it.  `since`, from
    `poll_floor`, lets the scan skip what was changed before that second.
    """
    if not 0 <= shard < shards:
        raise ValueError(f"no shard {shard} of {shards}")
    chosen = items
    if since is not None and incremental:
        chosen = chosen.filter(F.col("__mtime_secs") >= since)
    if paths:
        chosen = chosen.filter(reduce(lambda a, b: a | b, (F.col("__name").startswith(p) for p in paths)))
    if suffixes:
        chosen = chosen.filter(reduce(lambda a, b: a | b, (F.col("__name").endswith(s) for s in suffixes)))
    for predicate in predicates:
        chosen = chosen.filter(predicate)
    if shards > 1:
        chosen = chosen.filter(owner("__name", shards) == shard)
    if incremental and stamps is not None:
        known = stamps.select("__name", F.col("secs").alias("__s"), F.col("nsecs").alias("__ns"))
        newer = F.col("__s").isNull() | (
            F.struct(F.col("__mtime_secs"), F.col("__mtime_nsecs")) > F.struct(
                F.col("__s").alias("__mtime_secs"), F.col("__ns").alias("__mtime_nsecs")))
        chosen = chosen.join(known, "__name", "left").filter(newer)
    return chosen.select(*SYSTEM_COLUMNS, *attributes)


def owner(name: str | Column, shards: int) -> Column:
    """The poller of an item: the one whose hash with the item's name is greatest.

    One poller more takes 1 of `shards` + 1 of the items, from all others alike; none moves between those.
    """
    marks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(name, i).alias("hash"), i.alias("shard")))
    return F.array_max(marks)["shard"]


def poll_floor(items: DataFrame, stamps: DataFrame, slack: int = 0) -> int | None:
    """A second before which nothing is left to poll: `since` of the next polls; None if there are no items.

    That of the earliest item without a stamp of its last change, else of the latest item, less `slack` seconds for
    items that appear later than they say.  Give it all items of the paths polled, and the stamps of all pollers.
    """
    left = poll_items(items, stamps).agg(F.min("__mtime_secs")).first()[0]
    floor = items.agg(F.max("__mtime_secs")).first()[0] if left is None else left
    return None if floor is None else floor - slack


def stamp_items(stamps: DataFrame | None, processed: DataFrame) -> DataFrame:
    """The stamp table after a run: items processed without error get the time of the run.

    `processed` has `__name`, `at` (timestamp) and `error`; failed items keep their old stamp, so
    the next poll finds them again.
    """
    fresh = processed.filter(F.col("error").isNull()).groupBy("__name").agg(F.max("at").alias("__at")).select(
        "__name", F.unix_seconds("__at").alias("secs"), (F.unix_micros("__at") % 1_000_000 * 1000).alias("nsecs"))
    if stamps is None:
        return fresh
    kept = stamps.select("__name", "secs", "nsecs").join(fresh.select("__name"), "__name", "left_anti")
    return kept.unionByName(fresh)
