"""Tables of function and trigger configurations: listing, checks, defaults, exports, reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventflow.functions.durations import duration_us
from eventflow.functions.labels import selector
from eventflow.functions.maps import empty_map

STREAM_KIND = "shard-stream"
KAFKA_KINDS = ("kafka-cluster", "kafka")

# fixed values: attributes of stream triggers
STREAM_ATTRIBUTES = {"consumer_group": "consumerGroup", "container": "containerName", "path": "streamPath"}

# fixed values: limits and defaults of trigger settings
MAX_WORKERS = 100_000
DEFAULT_WORKERS = 1
DEFAULT_WORKER_WAIT_MS = 10_000
DEFAULT_TERMINATION = "10s"
DEFAULT_BATCH_SIZE = 10
DEFAULT_BATCH_TIMEOUT = "1s"

# fixed values: source types of scale metrics
METRIC_SOURCES = ("Resource", "Pods", "External", "Object", "ContainerResource")


def triggers_by_kind(functions: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """One row per function and trigger of the given kinds: function, trigger, config."""
    rows = functions.select(F.col("name").alias("function"), F.explode("triggers").alias("trigger", "config"))
    return rows.filter(F.col("config.kind").isin(list(kinds)))


def streams_of(functions: DataFrame, kinds: Iterable[str] = (STREAM_KIND,), attributes: Mapping[str, str] = STREAM_ATTRIBUTES) -> DataFrame:
    """The streams that functions read by triggers of `kinds`, with key ``function@trigger``; `attributes` maps columns to trigger attributes."""
    return triggers_by_kind(functions, kinds).select(
        F.concat("function", F.lit("@"), "trigger").alias("stream"),
        *[F.try_element_at(F.col("config.attributes"), F.lit(a)).alias(n) for n, a in attributes.items()])


def match_labels(df: DataFrame, text: str, column: str = "labels") -> DataFrame:
    """Rows whose label map satisfies a selector."""
    return df.filter(selector(text)(F.col(column)))


def permitted(resources: DataFrame, grants: DataFrame, members: Sequence[str], action: str = "read",
              override: bool = False) -> tuple[DataFrame, DataFrame]:
    """The resources some member may access, and the names of the others.

    Without members, or with `override`, nothing is filtered.  `resources` has `name` and `resource`;
    `grants` has member, resource and action.
    """
    if not members or override:
        return resources, resources.select("name").limit(0)
    allowed = grants.filter(F.col("member").isin(list(members)) & (F.col("action") == action)).select(
        "resource").distinct()
    return (resources.join(allowed, "resource", "left_semi"),
            resources.join(allowed, "resource", "left_anti").select("name"))


def with_gateways(functions: DataFrame, gateways: DataFrame) -> DataFrame:
    """One row per function and upstream entry of a gateway; functions without one appear once.

    The list of a function's gateways has no size limit, so it stays rows.
    """
    upstreams = gateways.select(F.col("name").alias("gateway"), F.explode("upstreams").alias("u")).select(
        F.col("u.function").alias("name"), "gateway")
    # an inner join, which Spark can split on either side, and the functions it leaves out
    without = functions.join(upstreams.select("name").distinct(), "name", "left_anti")
    return functions.join(upstreams, "name").unionByName(without.withColumn("gateway", F.lit(None).cast("string")))


def export_view(functions: DataFrame, prev_state: Column | str = "state", scrub: bool = True,
                prefix: str = "") -> DataFrame:
    """Functions ready for export.

    Unless `scrub` is off, the namespace and the passwords and secrets of triggers are blank.  The
    resource version is blank, and annotations tell to skip build and deploy and give the former
    state.
    """
    state = F.col(prev_state) if isinstance(prev_state, str) else prev_state
    marks = F.create_map(F.lit(f"{prefix}skip-build"), F.lit("true"), F.lit(f"{prefix}skip-deploy"), F.lit("true"),
                         F.lit(f"{prefix}prev-state"), state)
    mark_names = [f"{prefix}skip-build", f"{prefix}skip-deploy", f"{prefix}prev-state"]
    own = F.map_filter(F.coalesce("annotations", empty_map()), lambda k, v: ~k.isin(mark_names))
    changed = {"resource_version": F.lit(""), "annotations": F.map_concat(own, marks)}
    if scrub:
        changed |= {"namespace": F.lit(""), "triggers": F.transform_values(
            "triggers", lambda k, t: t.withField("password", F.lit("")).withField("secret", F.lit("")))}
    return functions.withColumns(changed)


def violations(functions: DataFrame, annotation_prefix: str = "", stream_kinds: Sequence[str] = (STREAM_KIND,),
               kafka_kinds: Sequence[str] = KAFKA_KINDS) -> DataFrame:
    """One row per broken rule: name, trigger (null for rules of the function), rule.

    Triggers of `stream_kinds` do not scale; they and those of `kafka_kinds` need static allocation for explicit acks, which
    an annotation named by the (first) kind may give.
    """
    low, high = F.col("min_replicas"), F.col("max_replicas")
    kinds = F.transform(F.map_values("triggers"), lambda t: t["kind"])
    http = F.size(F.filter(kinds, lambda k: k == "http"))
    streams = F.exists(kinds, lambda k: k.isin(*stream_kinds))

    def metric(rule: str, broken) -> Column:
        return F.when(F.exists(F.col("auto_scale_metrics"), broken), F.lit(rule))

    def name_of(m):
        return F.coalesce(m["metric_name"], F.lit(""))

    def source_of(m):
        return F.coalesce(m["source_type"], F.lit(""))

    of_function = [
        F.when(low.isNotNull() & high.isNull() & (low == 0), "max replicas must be set when min replicas is zero"),
        F.when(low > high, "min replicas above max replicas"),
        F.when(high == 0, "max replicas must be above zero"),
        F.when((low == 0) & F.col("disable_default_http") & (http == 0), "scale to zero without http trigger"),
        F.when(http > 1, "more than one http trigger"),
        F.when(streams & (low != high), "stream trigger does not scale"),
        metric("scale metric without name", lambda m: name_of(m) == ""),
        metric("scale metric without source type", lambda m: source_of(m) == ""),
        metric("scale metric with unknown source type",
               lambda m: (source_of(m) != "") & ~source_of(m).isin(*METRIC_SOURCES)),
        metric("scale metric without threshold", lambda m: F.coalesce(m["threshold"], F.lit(0)) == 0),
        metric("scale metric with negative threshold", lambda m: m["threshold"] < 0),
    ]
    own = functions.select("name", F.lit(None).cast("string").alias("trigger"),
                           F.explode(F.array_compact(F.array(*of_function))).alias("rule"))
    t = F.col("t")
    prefix = F.when(t["kind"].isin(*kafka_kinds), "kafka").when(t["kind"].isin(*stream_kinds), stream_kinds[0])
    annotated = F.try_element_at("annotations", F.concat(F.lit(annotation_prefix), prefix, F.lit("-worker-allocation-mode")))
    mode = F.coalesce(F.try_element_at(t["attributes"], F.lit("workerAllocationMode")), annotated, F.lit(""))
    explicit = t["explicit_ack_mode"].isin("enable", "explicitOnly")
    of_trigger = [
        F.when(F.col("trigger") == "", "trigger without key"),
        F.when(F.col("trigger") != F.coalesce(t["name"], F.lit("")), "trigger key and name differ"),
        F.when(t["num_workers"] > MAX_WORKERS, "too many workers"),
        F.when(prefix.isNotNull() & explicit & ~mode.isin("", "static"), "explicit ack needs static allocation"),
        F.when(t["batch"].isNotNull() & (F.coalesce(t["batch"]["size"], F.lit(0)) <= 0), "batch size below 1"),
        F.when(t["batch"].isNotNull() & duration_us(F.coalesce(t["batch"]["timeout"], F.lit(""))).isNull(),
               "bad batch timeout"),
    ]
    each = functions.select("name", "annotations", F.explode("triggers").alias("trigger", "t")).select(
        "name", "trigger", F.explode(F.array_compact(F.array(*of_trigger))).alias("rule"))
    return own.unionByName(each)


def search(df: DataFrame, text: str, name: str = "name", content: str = "content") -> DataFrame:
    """Rows whose name or content holds a text; all rows for an empty text."""
    if not text:
        return df
    return df.filter(F.contains(name, F.lit(text)) | F.contains(content, F.lit(text)))


def import_report(results: DataFrame, only_failed: bool = False) -> DataFrame:
    """The report of an import: kind, project, name, status, reason, can_be_auto_fixed.

    `results` are steps with seq, kind (project or function), project, name, step (start, skipped,
    failed, success), reason and can_be_auto_fixed.  A project is skipped, else failed with its
    first failure, else a success, else unknown; a function appears as a success, as failed with
    its last failure, or both.
    """
    step, why = F.col("step"), F.struct("reason", "can_be_auto_fixed")
    failed = step == "failed"
    projects = results.filter(F.col("kind") == "project").groupBy("project").agg(
        F.bool_or(step == "skipped").alias("skipped"), F.bool_or(step == "success").alias("success"),
        F.bool_or(failed).alias("failed"), F.min_by(why, F.when(failed, F.col("seq"))).alias("why"))
    status = (F.when(F.col("skipped"), "skipped").when(F.col("failed"), "failed").when(F.col("success"), "success")
              .otherwise("unknown"))
    shown = F.when(status == "failed", F.col("why"))
    top = projects.select(F.lit("project").alias("kind"), "project", F.col("project").alias("name"),
                          status.alias("status"), shown["reason"].alias("reason"),
                          shown["can_be_auto_fixed"].alias("can_be_auto_fixed"))
    functions = results.filter((F.col("kind") == "function") & step.isin("success", "failed")).groupBy(
        "project", "name", step.alias("status")).agg(F.max_by(why, "seq").alias("why"))
    own = F.when(F.col("status") == "failed", F.col("why"))
    rows = top.unionByName(functions.select(
        F.lit("function").alias("kind"), "project", "name", "status", own["reason"].alias("reason"),
        own["can_be_auto_fixed"].alias("can_be_auto_fixed")))
    return rows.filter(F.col("status") == "failed") if only_failed else rows


def stale_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that failed up to their backoff limit, or succeeded.  No limit never matches."""
    return jobs.filter((F.col("backoff_limit") <= F.col("failed")) | (F.col("succeeded") > 0))


def canary_split(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Add `upstream`: `percent` of the keys go to ``canary``, the others to ``primary``.

    A key always goes the same way.
    """
    if not 1 <= percent <= 100:
        raise ValueError("the canary percentage must be between 1 and 100")
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return df.withColumn("upstream", F.when(slot < percent, "canary").otherwise("primary"))


def with_defaults(triggers: DataFrame) -> DataFrame:
    """Fill unset trigger settings; an attribute beats an annotation, and a negative wait is unset.

    Columns: num_workers, worker_wait_ms, termination_timeout, explicit_ack_mode, batch (struct of
    mode, size, timeout), attributes, annotations.  Adds worker_allocation_mode.  Batch settings are
    filled where batching is enabled.
    """
    def given(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    def of(column: str, key: str) -> Column:
        return F.nullif(F.try_element_at(column, F.lit(key)), F.lit(""))

    batch = F.col("batch")
    filled = batch.withField("size", F.coalesce(F.nullif(batch["size"], F.lit(0)), F.lit(DEFAULT_BATCH_SIZE))).withField(
        "timeout", F.coalesce(F.nullif(batch["timeout"], F.lit("")), F.lit(DEFAULT_BATCH_TIMEOUT)))
    annotated_ack = of("annotations", "explicit-ack-mode")
    ack = F.when(annotated_ack.isin("enable", "explicitOnly"), annotated_ack)
    return triggers.withColumns({
        "num_workers": F.coalesce(F.nullif("num_workers", F.lit(0)), F.lit(DEFAULT_WORKERS)),
        "worker_wait_ms": F.coalesce(F.when(F.col("worker_wait_ms") >= 0, F.col("worker_wait_ms")), F.lit(DEFAULT_WORKER_WAIT_MS)),
        "termination_timeout": F.coalesce(given("termination_timeout"), F.lit(DEFAULT_TERMINATION)),
        "explicit_ack_mode": F.coalesce(ack, given("explicit_ack_mode"), F.lit("disable")),
        "worker_allocation_mode": F.coalesce(of("attributes", "workerAllocationMode"),
                                             of("annotations", "worker-allocation-mode"), F.lit("pool")),
        "batch": F.when(batch["mode"] == "enable", filled).otherwise(batch)})
