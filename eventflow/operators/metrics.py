"""Counters, durations, windows and the scaling signals derived from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventflow.functions.durations import duration_text_us, duration_us
from eventflow.functions.maps import sorted_pairs
from eventflow.operators.delivery import has_error
from eventflow.operators.ordered import CHUNK_ROWS, ordered

# label hierarchy, outermost first
LABELS = ("namespace", "project", "function", "trigger_kind", "trigger_id", "instance")

# fixed values: window size presets
WINDOW_PRESETS = ("1m", "2m", "5m", "10m", "30m")


def handled_events(outcomes: DataFrame, rollup: bool = False, labels: Sequence[str] = LABELS) -> DataFrame:
    """Handled events by `result` (success or failure) and labels.

    Success means no process error.  Events whose `outcome` is ``no_response`` count as neither.
    With `rollup` there are subtotals along the label hierarchy, with `level` telling how many
    labels are set.
    """
    labels = [c for c in labels if c in outcomes.columns]
    failed = has_error(outcomes, "process_error")
    counted = F.col("outcome") != "no_response" if "outcome" in outcomes.columns else F.lit(True)
    counts = outcomes.groupBy(*labels).agg(F.count_if(counted & ~failed).alias("success"),
                                           F.count_if(counted & failed).alias("failure"))
    if rollup:
        # the subtotals come from the counts, not from the events
        counts = counts.rollup(*labels).agg(
            F.sum("success").alias("success"), F.sum("failure").alias("failure"),
            (F.lit(len(labels)) - F.bit_count(F.grouping_id())).cast("int").alias("level"))
    ids = [*labels, "level"] if rollup else labels
    return counts.unpivot(ids, ["success", "failure"], "result", "value")


def worker_outcomes(outcomes: DataFrame, keys: Sequence[str] = ("worker",)) -> DataFrame:
    """Per worker: a success has no error and a status below 400."""
    good = ~has_error(outcomes, "process_error") & (F.coalesce("status_code", F.lit(200)) < 400)
    return outcomes.groupBy(*keys).agg(F.count_if(good).alias("success"), F.count_if(~good).alias("error"))


def durations(outcomes: DataFrame, keys: Sequence[str] = ("worker",)) -> DataFrame:
    """Sum, count and mean of durations, each cut to whole milliseconds first."""
    ms = F.floor("duration_ms").cast("bigint")
    return outcomes.groupBy(*keys).agg(
        F.sum(ms).alias("duration_ms_sum"), F.count(ms).alias("duration_ms_count"),
        (F.sum(ms) / F.count(ms)).alias("duration_ms_mean"))


def counter_delta(snaps: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `<col>_delta`: growth of each counter since the key's previous snapshot (the first: from 0).

    One snapshot per key and time.  Keys of any size: see `ordered`.
    """
    scan = ordered(snaps, keys, [ts], chunk_rows).lag({f"__p_{c}": c for c in cols}).result()
    return scan.withColumns({f"{c}_delta": F.col(c) - F.coalesce(f"__p_{c}", F.lit(0)) for c in cols}).drop(
        *[f"__p_{c}" for c in cols])


def allocation_stats(allocs: DataFrame, keys: Sequence[str] = ("trigger_id",)) -> DataFrame:
    """Worker allocations from a log with `result` (immediate, after_wait, timeout), `wait_ms`,
    `available` and `total` workers.  A total of 0 has no percentage.  Waits count only where a worker came; each availability is
    cut to a whole percent."""
    result = F.col("result")
    percent = F.floor(F.try_divide(F.col("available") * 100, "total")).cast("bigint")
    return allocs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("allocation_count"),
        F.count_if(result == "immediate").alias("success_immediate"),
        F.count_if(result == "after_wait").alias("success_after_wait"),
        F.count_if(result == "timeout").alias("timeout"),
        F.coalesce(F.sum(F.when(result == "after_wait", F.floor("wait_ms").cast("bigint"))), F.lit(0))
        .alias("wait_ms_sum"),
        (F.sum(percent) / F.count(F.lit(1))).alias("available_percentage"))


def rollup_windows(metrics: DataFrame, sizes: Sequence[str] = WINDOW_PRESETS, keys: Sequence[str] = ("metric",),
                   ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum, minimum and maximum per key and tumbling window, for several window sizes.

    The rows are aggregated once, to the greatest common window; all sizes come from that.
    """
    micros = [duration_text_us(s) for s in sizes]
    step = math.gcd(*micros)

    def start_of(column: Column, width: Column | int) -> Column:
        return column - F.pmod(column, F.lit(width) if isinstance(width, int) else width)

    base = metrics.groupBy(*keys, start_of(F.unix_micros(ts), step).alias("__base")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"),
        F.max(value).alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(u).cast("bigint").alias("us"))
                                 for s, u in zip(sizes, micros)]))
    spread = base.withColumn("__w", wanted)
    return spread.groupBy(*keys, F.col("__w.size").alias("window_size"),
                          F.timestamp_micros(start_of(F.col("__base"), F.col("__w.us"))).alias("window_start")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high"))


def computed_min_replicas() -> Column:
    """`replicas` if given, else `min_replicas`, else 1; never negative."""
    return F.greatest(F.coalesce("replicas", "min_replicas", F.lit(1)), F.lit(0))


def idle_candidates(functions: DataFrame) -> DataFrame:
    """Functions that may be scaled to zero.

    The computed minimum of replicas is 0, the state is ``ready``, there is a scale-to-zero spec
    whose windows all parse, and a scale status, if any, has a time.
    """
    parses = F.forall("scale_to_zero", lambda r: duration_us(r["window_size"]).isNotNull())
    status_ok = F.col("scale_status").isNull() | F.col("scale_status.last_scale_event_time").isNotNull()
    return functions.filter((computed_min_replicas() <= 0) & (F.col("state") == "ready")
                            & F.col("scale_to_zero").isNotNull() & parses & status_ok)


def idle_functions(candidates: DataFrame, metrics: DataFrame, now: datetime | Column) -> DataFrame:
    """Add `idle`: every scale metric stayed at or below its threshold over its own window.

    A metric without samples in its window counts as idle.  Metrics are (function, metric_name,
    ts, value).
    """
    now = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    now_us = F.unix_micros(now)
    resources = candidates.select(F.col("name").alias("function"), F.explode("scale_to_zero").alias("r")).select(
        "function", F.col("r.metric_name").alias("metric_name"), F.col("r.threshold").alias("threshold"),
        duration_us(F.col("r.window_size")).alias("window_us"))
    # no sample older than the widest window matters; the bounds are on the plain column, for the scan
    widest = resources.agg(F.max("window_us")).scalar()
    recent = metrics.filter((F.col("ts") <= now) & (F.col("ts") > F.timestamp_micros(now_us - widest)))
    # one row per function leaves each task: samples are reduced before the shuffle after the join
    seen = (recent.join(resources, ["function", "metric_name"])
            .filter(now_us - F.unix_micros("ts") < F.col("window_us"))
            .groupBy("function").agg(F.bool_and(F.col("value") <= F.col("threshold")).alias("__quiet")))
    return (candidates.join(seen.withColumnRenamed("function", "name"), "name", "left")
            .withColumn("idle", F.coalesce("__quiet", F.lit(True))).drop("__quiet"))


def stuck_events(starts: DataFrame, ends: DataFrame, timeout: str, now: datetime | Column) -> DataFrame:
    """Events started, not finished, and running longer than `timeout` at `now`."""
    now = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    # a constant bound on the plain column, for the scan
    late = starts.filter(F.col("ts") < F.timestamp_micros(F.unix_micros(now) - duration_text_us(timeout)))
    return late.join(ends.select("event_id").distinct(), "event_id", "left_anti")


def health_transitions(functions: DataFrame, conditions: DataFrame) -> DataFrame:
    """Functions whose latest condition snapshot changes their state.

    Available needs a replica, and no Available=False, ReplicaFailure or Progressing=False.  An
    available ``unhealthy`` function turns ``ready``, an unavailable ``ready`` one ``unhealthy``.
    Disabled functions, functions with 0 replicas and all other states are left alone.
    """
    latest = conditions.groupBy("function").agg(
        F.max_by(F.struct("replicas", "conditions"), "ts").alias("__s"))
    watched = functions.filter(F.col("state").isin("ready", "unhealthy") & ~F.coalesce("disabled", F.lit(False))
                               & (F.coalesce("replicas", F.lit(1)) != 0))
    joined = watched.join(latest.withColumnRenamed("function", "name"), "name")
    broken = F.exists(F.coalesce("__s.conditions", F.array().cast("array<struct<type:string,status:string>>")),
                      lambda c: ((c["type"] == "Available") & (c["status"] == "False"))
                      | (c["type"] == "ReplicaFailure")
                      | ((c["type"] == "Progressing") & (c["status"] == "False")))
    available = (F.coalesce("__s.replicas", F.lit(0)) > 0) & ~broken
    target = (F.when(available & (F.col("state") == "unhealthy"), "ready")
              .when(~available & (F.col("state") == "ready"), "unhealthy"))
    return joined.select("name", F.col("state").alias("from_state"), target.alias("to_state")).filter(
        F.col("to_state").isNotNull())


def to_exposition(metrics: DataFrame) -> DataFrame:
    """Metric rows (`metric`, `labels` map, `value`) as exposition text, one `line` per row."""
    def quoted(key: Column, value: Column) -> Column:
        safe = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                         F.lit("\n"), F.lit("\\n"))
        return F.concat(key, F.lit('="'), safe, F.lit('"'))

    number = F.col("value")
    whole = number == F.floor(number)
    text = F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    labels = F.when(F.size("labels") > 0, F.concat(
        F.lit("{"), sorted_pairs(F.col("labels"), quoted, ","), F.lit("}"))).otherwise(F.lit(""))
    return metrics.select(F.concat("metric", labels, F.lit(" "), text).alias("line"))
