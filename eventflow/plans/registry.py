"""Configuration tables over the given tables: customers are functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions.labels import dedupe_list, list_minus
from eventflow.operators import registry as R
from eventflow.operators import secrets as S
from eventflow.plans import query
from eventflow.plans.tables import events, spread, table


def function_configs(spark, sf_dir):
    """The customers as function configurations with up to four triggers each."""
    k = F.col("c_custkey")

    def attributes(**values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    def trigger(kind, name, workers, ack, batch, attrs):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), workers.cast("int").alias("num_workers"),
                        F.lit("u").alias("url"), F.lit("pw").alias("password"), F.lit("sec").alias("secret"),
                        ack.alias("explicit_ack_mode"), batch.alias("batch"), attrs.alias("attributes"))

    no_batch = F.lit(None).cast("struct<mode:string,size:int,timeout:string>")
    batch = F.struct(F.lit("enable").alias("mode"), F.when(k % 9 == 0, 0).otherwise(5).alias("size"),
                     F.when(k % 15 == 0, "soon").otherwise("500ms").alias("timeout"))
    none = F.lit(None).cast("string")
    web = trigger("http", F.lit("web"), F.lit(1), none, no_batch, attributes(port=F.lit("80")))
    web2 = trigger("http", F.lit("other"), F.lit(1), none, no_batch, attributes(port=F.lit("81")))
    log = trigger("kafka-cluster", F.lit("log"), F.when(k % 7 == 0, 200_000).otherwise(4),
                  F.when(k % 4 == 0, "enable").otherwise("disable"), batch,
                  attributes(topic=F.lit("t"), workerAllocationMode=F.when(k % 8 == 0, "pool").otherwise("static")))
    stream = trigger(R.STREAM_KIND, F.lit("stream"), F.lit(1), F.lit("explicitOnly"), no_batch,
                     attributes(consumerGroup=F.concat(F.lit("g"), (k % 3).cast("string")),
                                containerName=F.lit("box"), streamPath=F.concat(F.lit("/s/"), k.cast("string"))))
    every = F.create_map(F.lit("web"), F.when(k % 2 == 0, web), F.lit("web2"), F.when(k % 10 == 0, web2),
                         F.lit("log"), F.when(k % 3 == 0, log), F.lit("stream"), F.when(k % 5 == 0, stream))
    metric = F.array(F.struct(F.when(k % 17 == 0, "").otherwise("cpu").alias("metric_name"),
                              F.when(k % 19 == 0, "Nodes").when(k % 23 == 0, "").otherwise("Pods").alias("source_type"),
                              F.when(k % 29 == 0, 0).when(k % 31 == 0, -1).otherwise(5).alias("threshold")))
    return table(spark, sf_dir, "customer").select(
        k, F.col("c_name").alias("name"), F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("labels"),
        F.when(k % 2 == 0, F.create_map(F.lit("owner"), F.lit("me"), F.lit("prev-state"), F.lit("old"))).otherwise(
            F.create_map(F.lit("shard-stream-worker-allocation-mode"), F.lit("pool"))).alias("annotations"),
        F.when(k % 6 == 0, 0).when(k % 6 == 1, 3).alias("min_replicas"), F.when(k % 4 == 0, 2).when(k % 4 == 1, 0).alias("max_replicas"),
        (k % 3 == 1).alias("disable_default_http"), F.when(k % 2 == 0, "ready").otherwise("imported").alias("state"),
        F.lit("17").alias("resource_version"), metric.alias("auto_scale_metrics"),
        F.map_filter(every, lambda k, v: v.isNotNull()).alias("triggers"))


@query("r1_triggers_by_kind", """
SELECT c_name AS "function", 'web' AS "trigger", 'http' AS kind, 1 AS workers FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_name, 'web2', 'http', 1 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_name, 'log', 'kafka-cluster', CASE WHEN c_custkey % 7 = 0 THEN 200000 ELSE 4 END FROM customer WHERE c_custkey % 3 = 0""")
def _r1(spark, sf_dir):
    return R.triggers_by_kind(function_configs(spark, sf_dir), ["http", "kafka-cluster"]).select(
        "function", "trigger", F.col("config.kind").alias("kind"), F.col("config.num_workers").alias("workers"))


@query("r2_streams_of", """
SELECT c_name || '@stream' AS stream, 'g' || (c_custkey % 3) AS consumer_group, 'box' AS container, '/s/' || c_custkey AS path
FROM customer WHERE c_custkey % 5 = 0""")
def _r2(spark, sf_dir):
    return R.streams_of(function_configs(spark, sf_dir))


@query("r2_streams_of_kinds", """
SELECT c_name || '@log' AS stream, 't' AS topic, CASE WHEN c_custkey % 8 = 0 THEN 'pool' ELSE 'static' END AS allocation
FROM customer WHERE c_custkey % 3 = 0""")
def _r2_kinds(spark, sf_dir):
    return R.streams_of(function_configs(spark, sf_dir), ["kafka-cluster"], {"topic": "topic", "allocation": "workerAllocationMode"})


@query("r3_match_labels", """
SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3 AND c_nationkey NOT IN (5, 6)""")
def _r3(spark, sf_dir):
    return R.match_labels(function_configs(spark, sf_dir),
                          "segment in (BUILDING, MACHINERY),nation!=3,nation notin (5,6),nation,!absent").select("name")


@query("r4_permitted", """WITH g AS (SELECT 'm' || (o_custkey % 4) AS member, '/projects/' || o_custkey AS resource,
  CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS action FROM orders),
a AS (SELECT DISTINCT resource FROM g WHERE member IN ('m1', 'm2') AND action = 'read')
SELECT c_name AS name, ('/projects/' || c_custkey) IN (SELECT resource FROM a) AS kept FROM customer""")
def _r4(spark, sf_dir):
    resources = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("/projects/"), F.col("c_custkey").cast("string")).alias("resource"))
    grants = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("member"),
        F.concat(F.lit("/projects/"), F.col("o_custkey").cast("string")).alias("resource"),
        F.when(F.col("o_orderkey") % 2 == 0, "read").otherwise("write").alias("action"))
    kept, filtered = R.permitted(resources, grants, ["m1", "m2"])
    return kept.select("name", F.lit(True).alias("kept")).unionByName(filtered.select("name", F.lit(False).alias("kept")))


@query("r5_with_gateways", """WITH u AS (SELECT o_custkey AS k, 'gw-' || (o_orderkey % 50) AS gateway FROM orders
  UNION ALL SELECT (o_custkey + 1) AS k, 'gw-' || (o_orderkey % 50) FROM orders)
SELECT c_name AS name, gateway FROM customer LEFT JOIN u ON k = c_custkey""")
def _r5(spark, sf_dir):
    def named(key):
        return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))

    gateways = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("gw-"), (F.col("o_orderkey") % 50).cast("string")).alias("name"), F.array(
            F.struct(named(F.col("o_custkey")).alias("function"), F.lit(90).alias("percentage")),
            F.struct(named(F.col("o_custkey") + 1).alias("function"), F.lit(10).alias("percentage"))).alias("upstreams"))
    return R.with_gateways(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), gateways)


def config_documents(spark, sf_dir):
    """Each customer as a JSON configuration with and without secrets."""
    k = F.col("c_custkey")
    key = k.cast("string")
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_name").alias("name"), F.format_string(
        '{"metadata": {"name": "%s"}, "spec": {"build": {"codeEntryAttributes": {"password": "%s", "workDir": "/w"}}, '
        '"image": "i", "not-a-password": %s, "triggers": {"t1": {"password": "%s", "attributes": {"password": "a%s"}}}, '
        '"volumes": [{"volume": {"flexVolume": {"options": {"accesskey": "%s"}}}}]}}',
        F.col("c_name"), F.concat(F.lit("p"), key), key, F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("t"), key)),
        key, F.when(k % 3 == 0, "$ref:/spec/volumes[0]/volume/flexvolume/options/accesskey").otherwise("vol"))
        .alias("config"))


def _leaf(path):
    return F.get_json_object("config", path)


@query("r6_scrub", """
SELECT c_name AS name, '$ref:/spec/build/codeentryattributes/password' AS password, '/w' AS work_dir, c_custkey AS number,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '$ref:/spec/triggers/t1/password' END AS trigger_password,
  '$ref:/spec/volumes[0]/volume/flexvolume/options/accesskey' AS access_key FROM customer""")
def _r6(spark, sf_dir):
    redacted, _ = S.scrub(config_documents(spark, sf_dir))
    return redacted.select(
        "name", _leaf("$.spec.build.codeEntryAttributes.password").alias("password"),
        _leaf("$.spec.build.codeEntryAttributes.workDir").alias("work_dir"),
        _leaf("$.spec['not-a-password']").cast("bigint").alias("number"),
        _leaf("$.spec.triggers.t1.password").alias("trigger_password"),
        _leaf("$.spec.volumes[0].volume.flexVolume.options.accesskey").alias("access_key"))


@query("r6_secrets", """
SELECT c_name AS name, '$ref:/spec/build/codeentryattributes/password' AS secret_key, '"p' || c_custkey || '"' AS "value",
  'ref_JHJlZjovc3BlYy9idWlsZC9jb2RlZW50cnlhdHRyaWJ1dGVzL3Bhc3N3b3Jk' AS encoded FROM customer
UNION ALL SELECT c_name, '$ref:/spec/triggers/t1/attributes/password', '"a' || c_custkey || '"', 'ref_' || replace(to_base64(encode('$ref:/spec/triggers/t1/attributes/password')), '=', '_') FROM customer
UNION ALL SELECT c_name, '$ref:/spec/triggers/t1/password', '"t' || c_custkey || '"', 'ref_' || replace(to_base64(encode('$ref:/spec/triggers/t1/password')), '=', '_') FROM customer WHERE c_custkey % 2 <> 0
UNION ALL SELECT c_name, '$ref:/spec/volumes[0]/volume/flexvolume/options/accesskey', CASE WHEN c_custkey % 3 = 0 THEN '"old"' ELSE '"vol"' END,
  'ref_' || replace(to_base64(encode('$ref:/spec/volumes[0]/volume/flexvolume/options/accesskey')), '=', '_') FROM customer""")
def _r6_secrets(spark, sf_dir):
    docs = config_documents(spark, sf_dir)
    existing = docs.select("name", F.lit("$ref:/spec/volumes[0]/volume/flexvolume/options/accesskey").alias("secret_key"),
                           F.lit('"old"').alias("value"))
    _, secrets = S.scrub(docs, existing=existing)
    return secrets.withColumn("encoded", S.encoded_key("secret_key", "ref_"))


@query("r7_restore", """
SELECT c_name AS name, 'p' || c_custkey AS password, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 't' || c_custkey END AS trigger_password,
  'a' || c_custkey AS attribute_password, true AS had_refs, true AS same FROM customer""")
def _r7(spark, sf_dir):
    docs = config_documents(spark, sf_dir)
    redacted, secrets = S.scrub(docs)
    back = S.restore(S.has_refs(redacted), secrets)
    both = back.join(docs.withColumnRenamed("config", "original"), "name")
    return both.select("name", _leaf("$.spec.build.codeEntryAttributes.password").alias("password"),
                       _leaf("$.spec.triggers.t1.password").alias("trigger_password"),
                       _leaf("$.spec.triggers.t1.attributes.password").alias("attribute_password"),
                       F.col("has_refs").alias("had_refs"), (F.col("config") == F.col("original")).alias("same"))


@query("r8_export_view", """
SELECT c_name AS name, '' AS namespace, '' AS resource_version, 'true' AS skip_build, 'true' AS skip_deploy,
  CASE WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'imported' END AS prev_state, CASE WHEN c_custkey % 2 = 0 THEN 'me' END AS owner,
  CASE WHEN c_custkey % 3 = 0 THEN '' END AS password, CASE WHEN c_custkey % 3 = 0 THEN '' END AS secret,
  CASE WHEN c_custkey % 3 = 0 THEN 'u' END AS url FROM customer""")
def _r8(spark, sf_dir):
    out = R.export_view(function_configs(spark, sf_dir))
    marks, log = F.col("annotations"), F.col("triggers")["log"]
    return out.select("name", "namespace", "resource_version", marks["skip-build"].alias("skip_build"),
                      marks["skip-deploy"].alias("skip_deploy"), marks["prev-state"].alias("prev_state"),
                      marks["owner"].alias("owner"), log["password"].alias("password"), log["secret"].alias("secret"),
                      log["url"].alias("url"))


@query("r9_violations_kinds", """WITH f AS (SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS low,
  CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS high FROM customer)
SELECT name, NULL AS "trigger", 'stream trigger does not scale' AS rule FROM f WHERE k % 3 = 0 AND low <> high
UNION ALL SELECT name, 'log', 'explicit ack needs static allocation' FROM f WHERE k % 3 = 0 AND k % 8 = 0""")
def _r9_kinds(spark, sf_dir):
    return R.violations(function_configs(spark, sf_dir), stream_kinds=["kafka-cluster"], kafka_kinds=[]).filter(
        F.col("rule").isin("stream trigger does not scale", "explicit ack needs static allocation"))


@query("r9_violations", """WITH f AS (SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS low,
  CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS high FROM customer)
SELECT name, NULL AS "trigger", 'max replicas must be set when min replicas is zero' AS rule FROM f WHERE low = 0 AND high IS NULL
UNION ALL SELECT name, NULL, 'min replicas above max replicas' FROM f WHERE low > high
UNION ALL SELECT name, NULL, 'max replicas must be above zero' FROM f WHERE high = 0
UNION ALL SELECT name, NULL, 'scale to zero without http trigger' FROM f WHERE low = 0 AND k % 3 = 1 AND k % 2 <> 0
UNION ALL SELECT name, NULL, 'more than one http trigger' FROM f WHERE k % 10 = 0
UNION ALL SELECT name, NULL, 'stream trigger does not scale' FROM f WHERE k % 5 = 0 AND low <> high
UNION ALL SELECT name, NULL, 'scale metric without name' FROM f WHERE k % 17 = 0
UNION ALL SELECT name, NULL, 'scale metric without source type' FROM f WHERE k % 23 = 0 AND k % 19 <> 0
UNION ALL SELECT name, NULL, 'scale metric with unknown source type' FROM f WHERE k % 19 = 0
UNION ALL SELECT name, NULL, 'scale metric without threshold' FROM f WHERE k % 29 = 0
UNION ALL SELECT name, NULL, 'scale metric with negative threshold' FROM f WHERE k % 31 = 0 AND k % 29 <> 0
UNION ALL SELECT name, 'web2', 'trigger key and name differ' FROM f WHERE k % 10 = 0
UNION ALL SELECT name, 'log', 'too many workers' FROM f WHERE k % 21 = 0
UNION ALL SELECT name, 'log', 'explicit ack needs static allocation' FROM f WHERE k % 24 = 0
UNION ALL SELECT name, 'stream', 'explicit ack needs static allocation' FROM f WHERE k % 5 = 0 AND k % 2 <> 0
UNION ALL SELECT name, 'log', 'batch size below 1' FROM f WHERE k % 9 = 0
UNION ALL SELECT name, 'log', 'bad batch timeout' FROM f WHERE k % 15 = 0""")
def _r9(spark, sf_dir):
    return R.violations(function_configs(spark, sf_dir))


@query("r10_search", "SELECT doc_id FROM documents WHERE contains(source, 'the') OR contains(text, 'the')")
def _r10(spark, sf_dir):
    return R.search(table(spark, sf_dir, "documents"), "the", "source", "text").select("doc_id")


@query("r11_import_report", """WITH s AS (SELECT event_id AS seq, 'p' || (user_id % 40) AS project, 'f' || (user_id % 13) AS name,
  CASE WHEN event_id % 3 = 0 THEN 'project' ELSE 'function' END AS kind, 'why ' || event_id AS reason, event_id % 2 = 0 AS fixable,
  CASE WHEN user_id % 40 = 1 AND event_id % 50 = 3 THEN 'skipped' WHEN user_id % 40 < 12 AND value > 120 THEN 'failed'
    WHEN user_id % 40 < 30 THEN 'success' ELSE 'start' END AS step FROM events),
p AS (SELECT project, bool_or(step = 'skipped') AS sk, bool_or(step = 'failed') AS fa, bool_or(step = 'success') AS su,
  arg_min(reason, seq) FILTER (step = 'failed') AS r, arg_min(fixable, seq) FILTER (step = 'failed') AS x FROM s WHERE kind = 'project' GROUP BY project)
SELECT 'project' AS kind, project, project AS name, CASE WHEN sk THEN 'skipped' WHEN fa THEN 'failed' WHEN su THEN 'success' ELSE 'unknown' END AS status,
  CASE WHEN NOT sk AND fa THEN r END AS reason, CASE WHEN NOT sk AND fa THEN x END AS can_be_auto_fixed FROM p
UNION ALL SELECT 'function', project, name, step, CASE WHEN step = 'failed' THEN arg_max(reason, seq) END, CASE WHEN step = 'failed' THEN arg_max(fixable, seq) END
FROM s WHERE kind = 'function' AND step IN ('success', 'failed') GROUP BY project, name, step""")
def _r11(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id") % 40
    steps = events(spark, sf_dir).select(
        k.alias("seq"), F.concat(F.lit("p"), u.cast("string")).alias("project"),
        F.concat(F.lit("f"), (F.col("user_id") % 13).cast("string")).alias("name"),
        F.when(k % 3 == 0, "project").otherwise("function").alias("kind"),
        F.concat(F.lit("why "), k.cast("string")).alias("reason"), (k % 2 == 0).alias("can_be_auto_fixed"),
        F.when((u == 1) & (k % 50 == 3), "skipped").when((u < 12) & (F.col("value") > 120), "failed")
        .when(u < 30, "success").otherwise("start").alias("step"))
    return R.import_report(steps)


@query("r12_stale_jobs", """WITH j AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS backoff_limit,
  o_custkey % 4 AS failed, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS succeeded FROM orders)
SELECT name FROM j WHERE backoff_limit <= failed OR succeeded > 0""")
def _r12(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        k.alias("name"), F.when(k % 3 != 0, k % 5).alias("backoff_limit"), (F.col("o_custkey") % 4).alias("failed"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("succeeded"))
    return R.stale_jobs(jobs).select("name")


@query("r13_lists", """WITH e AS (SELECT event_id, list_value(user_id % 5, event_id % 3, user_id % 5, event_id % 7) AS l FROM events)
SELECT event_id, array_to_string(list_transform(list_filter(list_transform(range(1, 5), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ',') AS distinct_items,
  array_to_string(list_transform(list_filter(l, lambda x: x <> 1 AND x <> 2), lambda x: CAST(x AS VARCHAR)), ',') AS left_items FROM e""")
def _r13(spark, sf_dir):
    u, k = F.col("user_id"), F.col("event_id")
    items = F.array(u % 5, k % 3, u % 5, k % 7)
    gone = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))

    def joined(column):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")

    return events(spark, sf_dir).select("event_id", joined(dedupe_list(items)).alias("distinct_items"),
                                        joined(list_minus(items, gone)).alias("left_items"))


@query("r14_canary_split", """
SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'canary' ELSE 'primary' END AS upstream FROM events""")
def _r14(spark, sf_dir):
    return R.canary_split(events(spark, sf_dir), "user_id", 20).select("event_id", "upstream")


@query("r15_with_defaults", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(event_id % 3 AS INTEGER) END AS num_workers,
  CASE WHEN event_id % 2 = 0 THEN 10000 ELSE 500 END AS worker_wait_ms, CASE WHEN event_id % 4 = 0 THEN '10s' ELSE '3s' END AS termination_timeout,
  CASE WHEN event_id % 7 = 0 THEN 'explicitOnly' WHEN event_id % 5 = 0 THEN 'enable' ELSE 'disable' END AS explicit_ack_mode,
  CASE WHEN event_id % 6 = 0 THEN 'static' WHEN event_id % 7 = 0 THEN 'annotated' ELSE 'pool' END AS worker_allocation_mode,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 10 WHEN event_id % 3 = 0 THEN 0 ELSE 8 END AS batch_size,
  CASE WHEN event_id % 2 = 0 THEN '1s' ELSE '' END AS batch_timeout FROM events""")
def _r15(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id", (k % 3).cast("int").alias("num_workers"), F.when(k % 2 != 0, 500).alias("worker_wait_ms"),
        F.when(k % 4 == 0, "").otherwise("3s").alias("termination_timeout"),
        F.when(k % 5 == 0, "enable").alias("explicit_ack_mode"),
        F.struct(F.when(k % 2 == 0, "enable").otherwise("disable").alias("mode"),
                 F.when(k % 3 == 0, 0).otherwise(8).alias("size"), F.lit("").alias("timeout")).alias("batch"),
        F.create_map(F.lit("workerAllocationMode"), F.when(k % 6 == 0, "static").otherwise("")).alias("attributes"),
        F.create_map(F.lit("explicit-ack-mode"), F.when(k % 7 == 0, "explicitOnly").otherwise(""),
                     F.lit("worker-allocation-mode"), F.when(k % 7 == 0, "annotated").otherwise("")).alias("annotations"))
    return R.with_defaults(rows).select(
        "event_id", "num_workers", "worker_wait_ms", "termination_timeout", "explicit_ack_mode", "worker_allocation_mode",
        F.col("batch.size").alias("batch_size"), F.col("batch.timeout").alias("batch_timeout"))
