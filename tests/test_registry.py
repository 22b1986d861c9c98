from __future__ import annotations

import json
import re
import random

import pytest
from pyspark.sql import functions as F

from eventflow.functions.labels import selector
from eventflow.operators import registry as R
from eventflow.operators import secrets as S

# each secret stands at another kind of sensitive path; what must stay is next to it
DOCUMENT = {
    "metadata": {"name": "mill", "annotations": {"grain.example/kafka-sasl-password": "rye", "grain.example/owner": "jo"}},
    "spec": {
        "build": {"codeEntryAttributes": {"Password": "barley", "branch": "dev", "headers": {"authorization": "oat", "x-mill-session-key": "spelt", "accept": "*"}}},
        "volumes": [{"volume": {"flexVolume": {"options": {"accessKey": 12}, "driver": "d"}}}],
        "triggers": {"belt": {"kind": "kafka", "secret": "", "attributes": {"caCert": "millet", "sasl": {"oauth": {"clientSecret": ["hops"]}}, "topic": "password"}}},
    }}
SECRETS = {
    "/metadata/annotations/grain.example/kafka-sasl-password": "rye",
    "/spec/build/codeentryattributes/password": "barley",
    "/spec/build/codeentryattributes/headers/authorization": "oat",
    "/spec/build/codeentryattributes/headers/x-mill-session-key": "spelt",
    "/spec/volumes[0]/volume/flexvolume/options/accesskey": 12,
    "/spec/triggers/belt/attributes/cacert": "millet",
    "/spec/triggers/belt/attributes/sasl/oauth/clientsecret[0]": None,  # below the sensitive path, so it stays
}


def test_scrub_and_restore(spark):
    rows = [("mill", json.dumps(DOCUMENT)), ("bare", "{}"), ("none", None), ("torn", '{"spec": ')]
    df = spark.createDataFrame(rows, "name string, config string")
    redacted, secrets = S.scrub(df)
    taken = {r.secret_key.removeprefix("$ref:"): json.loads(r.value) for r in secrets.collect()}
    assert taken == {k: v for k, v in SECRETS.items() if v is not None}
    left = {r.name: r for r in redacted.collect()}
    clean = json.loads(left["mill"].config)
    assert not any(word in left["mill"].config for word in ("rye", "barley", "oat\"", "spelt", "millet"))
    assert clean["metadata"]["annotations"]["grain.example/owner"] == "jo" and clean["spec"]["triggers"]["belt"]["secret"] == ""
    assert clean["spec"]["build"]["codeEntryAttributes"]["Password"] == "$ref:/spec/build/codeentryattributes/password"
    assert left["torn"].config is None and "malformed" in left["torn"].config_error
    assert all(left[n].config_error is None for n in ("mill", "bare", "none"))
    back = {r.name: r.config for r in S.restore(redacted, secrets).collect()}
    assert json.loads(back["mill"]) == DOCUMENT and back["none"] is None and back["bare"] == "{}"
    assert {r.name: r.has_refs for r in S.has_refs(redacted).collect()} == {"mill": True, "bare": False, "none": False, "torn": False}
    assert {r.name: r.has_refs for r in S.has_refs(df).collect()} == {"mill": False, "bare": False, "none": False, "torn": None}
    again, more = S.scrub(redacted, existing=secrets)
    assert {r.secret_key.removeprefix("$ref:"): json.loads(r.value) for r in more.collect()} == taken
    assert json.loads(again.filter("name = 'mill'").first().config) == clean


def test_paths_are_the_regular_expressions():
    patterns = [*S.SENSITIVE_PATHS, "^/a/b", "^/a/bc*/d$", "^/a/x-.+-k$", "password$", "^/(a|b)/c$", "^/a/[^/]+/e$", r"^/l\\[\\d+\\]/p$", "^/s/i$", "^/n//m$"]
    keys = ["a", "A", "b", "bc", "B", "c", "d", "e", "x-1/2-k", "spec", "Spec", "triggers", "volumes", "volume", "flexVolume", "options", "accessKey", "attributes",
            "password", "metadata", "annotations", "x/kafka-ca-cert", "l", "p", "\u017f", "s", "i", "\u0130", "\u0131", "", "n", "m", "sasl", "build", "codeEntryAttributes", "headers"]
    rng = random.Random(5)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.1:
            return 1
        if kind < 0.25:
            return [tree(depth - 1) for _ in range(2)]
        return {k: tree(depth - 1) for k in rng.sample(keys, 9)}

    def wanted(node, path, chosen):
        if isinstance(node, dict):
            return [p for k, v in node.items() for p in wanted(v, f"{path}/{k}", chosen)]
        if isinstance(node, list):
            return [p for i, v in enumerate(node) for p in wanted(v, f"{path}[{i}]", chosen)]
        return [path] if any(re.search(p, path, re.IGNORECASE) for p in chosen) else []

    found = 0
    for chosen in (patterns, S.SENSITIVE_PATHS, patterns[-9:-6] + patterns[-3:], [r"^/l\[\d+\]/p$", "^/s/i$", "^/spec/triggers/.+/password$"]):
        paths = S.Paths(chosen)
        for document in [tree(4) for _ in range(30)] + [{"spec": {"triggers": tree(4)}, "l": [{"p": 1}]}, [tree(2)], 1]:
            seen = []
            S._walk(document, "", lambda path, value: seen.append(path), paths)
            assert seen == wanted(document, "", chosen)
            found += len(seen)
    assert found > 500


def test_walk_leaves_out_what_no_pattern_reaches():
    paths = S.Paths(S.SENSITIVE_PATHS)
    assert paths.dead(paths.down(paths.begin, "status")) and not paths.dead(paths.down(paths.begin, "spec"))
    spec = paths.down(paths.begin, "Spec")
    assert paths.dead(paths.down(spec, "env")) and not paths.dead(paths.down(spec, "volumes"))


def test_new_secret_beats_old(spark):
    df = spark.createDataFrame([("f", json.dumps({"spec": {"triggers": {"t": {"password": "new"}}}}))], "name string, config string")
    old = spark.createDataFrame([("f", "$ref:/spec/triggers/t/password", '"old"'), ("f", "$ref:/other", '"o"')],
                                "name string, secret_key string, value string")
    _, secrets = S.scrub(df, existing=old)
    assert {r.secret_key: r.value for r in secrets.collect()} == {"$ref:/spec/triggers/t/password": '"new"', "$ref:/other": '"o"'}


def test_secret_keys():
    path = "Spec/Build/CodeEntryAttributes/password"
    name = S.encode_secret_key(path, "ref_")
    assert "=" not in name and S.decode_secret_key(name, "ref_") == path


@pytest.mark.parametrize("text,labels,want", [
    ("", {"a": "b"}, True), ("", None, True), ("z=w", {"a": "b", "c": "d"}, False), ("a=b", None, False),
    ("a=b", {"a": "b"}, True), ("a==b,c=d", {"a": "b", "c": "d"}, True), ("a!=b", {"a": "b"}, False), ("a!=b", {}, True),
    ("a in (x, b)", {"a": "b"}, True), ("a in (x)", {}, False), ("a notin (b,c)", {"a": "b"}, False),
    ("a notin (b,c)", {}, True), ("a", {"a": ""}, True), ("!a", {"a": ""}, False), ("!a", {}, True),
    ("x.y/a=b", {"x.y/a": "b"}, True), ("a=", {"a": ""}, True)])
def test_selectors(spark, text, labels, want):
    df = spark.createDataFrame([(labels,)], "labels map<string,string>")
    assert df.select(selector(text)(F.col("labels")).alias("m")).first().m is want


@pytest.mark.parametrize("text", ["!@#$", "a b", "a=b c", "in (a)", "a in b", "=b"])
def test_bad_selectors(text):
    with pytest.raises(ValueError):
        selector(text)


TRIGGER = ("struct<kind:string,name:string,num_workers:int,url:string,password:string,secret:string,explicit_ack_mode:string,"
           "batch:struct<mode:string,size:int,timeout:string>,attributes:map<string,string>>")


@pytest.mark.parametrize("mode,allocation,broken", [
    ("disable", "static", False), ("disable", "pool", False), ("enable", "static", False), ("enable", "pool", True),
    ("explicitOnly", "static", False), ("explicitOnly", "pool", True)])
@pytest.mark.parametrize("kind", ["kafka-cluster", "shard-stream"])
def test_explicit_ack_needs_static(spark, mode, allocation, broken, kind):
    df = spark.sql(f"""SELECT 'f' AS name, cast(null AS map<string,string>) AS annotations, cast(null AS int) AS min_replicas,
        cast(null AS int) AS max_replicas, false AS disable_default_http,
        cast(array() AS array<struct<metric_name:string,source_type:string,threshold:int>>) AS auto_scale_metrics,
        cast(map('t', named_struct('kind', '{kind}', 'name', 't', 'num_workers', 1, 'url', '', 'password', '', 'secret', '',
          'explicit_ack_mode', '{mode}', 'batch', null, 'attributes', map('workerAllocationMode', '{allocation}'))) AS map<string,{TRIGGER}>) AS triggers""")
    rules = [r.rule for r in R.violations(df).collect()]
    assert rules == (["explicit ack needs static allocation"] if broken else [])


def test_permissions(spark):
    resources = spark.createDataFrame([("a", "/a"), ("b", "/b")], "name string, resource string")
    grants = spark.createDataFrame([("m", "/a", "read"), ("m", "/b", "write"), ("x", "/b", "read")],
                                   "member string, resource string, action string")
    kept, gone = R.permitted(resources, grants, ["m"])
    assert [r.name for r in kept.collect()] == ["a"] and [r.name for r in gone.collect()] == ["b"]
    for members, override in (([], False), (["m"], True)):
        kept, gone = R.permitted(resources, grants, members, override=override)
        assert kept.count() == 2 and gone.count() == 0


def test_canary(spark):
    df = spark.range(20_000).select((F.col("id") % 10_000).alias("k"))
    rows = R.canary_split(df, "k", 20).groupBy("upstream").count().collect()
    share = {r.upstream: r["count"] / 20_000 for r in rows}
    assert abs(share["canary"] - 0.2) < 0.02
    ways = R.canary_split(df, "k", 20).groupBy("k").agg(F.countDistinct("upstream").alias("n"))
    assert ways.filter("n > 1").count() == 0
    assert R.canary_split(df, "k", 100).filter("upstream = 'primary'").count() == 0
    for percent in (0, 101):
        with pytest.raises(ValueError):
            R.canary_split(df, "k", percent)


def test_health_and_search(spark):
    from eventflow.operators.metrics import health_transitions

    functions = spark.createDataFrame(
        [("up", "unhealthy", 1, False), ("down", "ready", 1, False), ("failing", "ready", 1, False), ("stuck", "ready", 1, False),
         ("fine", "ready", 1, False), ("off", "ready", 1, True), ("zero", "ready", 0, False), ("asleep", "scaledToZero", 1, False),
         ("empty", "ready", 1, False)], "name string, state string, replicas int, disabled boolean")
    rows = [("up", 1, 1, [("Available", "True")]), ("down", 1, 1, [("Available", "True")]), ("down", 2, 1, [("Available", "False")]),
            ("failing", 1, 1, [("ReplicaFailure", "True")]), ("stuck", 1, 1, [("Progressing", "False"), ("Available", "True")]),
            ("fine", 1, 1, [("Progressing", "True")]), ("off", 1, 1, [("Available", "False")]),
            ("zero", 1, 1, [("Available", "False")]), ("asleep", 1, 1, [("Available", "False")]), ("empty", 1, 0, [])]
    conditions = spark.createDataFrame(rows, "function string, ts int, replicas int, conditions array<struct<type:string,status:string>>")
    got = {r.name: r.to_state for r in health_transitions(functions, conditions).collect()}
    assert got == {"up": "ready", "down": "unhealthy", "failing": "unhealthy", "stuck": "unhealthy", "empty": "unhealthy"}
    docs = spark.createDataFrame([("a", "text b"), ("b", "x"), ("c", "y")], "name string, content string")
    assert [r.name for r in R.search(docs, "b").collect()] == ["a", "b"] and R.search(docs, "").count() == 3
