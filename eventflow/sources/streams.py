"""Stream triggers as Spark sources: options, start positions, topic routing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from eventflow.functions.durations import duration_text_us
from eventflow.session import written

# fixed values: Kafka trigger defaults
FETCH_DEFAULT_BYTES = 1024 * 1024
FETCH_MIN_BYTES = 1

# fixed values: settings that annotations may give, and the names of those that are not called as the setting is
ANNOTATED_TEXTS = ("sessionTimeout", "heartbeatInterval", "maxWaitTime", "retryBackoff", "accessKey", "accessCertificate", "caCert",
                   "tls.minVersion", "sasl.user", "sasl.password", "sasl.mechanism", "sasl.oauth.clientId", "sasl.oauth.clientSecret",
                   "sasl.oauth.tokenURL")
ANNOTATED_NUMBERS = ("fetchMin", "fetchDefault", "fetchMax")
ANNOTATED_SWITCHES = ("tls.enable", "tls.insecureSkipVerify", "sasl.enable")
ANNOTATED_LISTS = ("sasl.oauth.scopes",)
OTHER_NAMES = {"accessCertificate": "access-cert", "tls.minVersion": "tls-minimum-version", "tls.enable": "tls-enabled",
               "sasl.enable": "sasl-enabled"}
SWITCHES = {**dict.fromkeys(("1", "t", "T", "TRUE", "true", "True"), True), **dict.fromkeys(("0", "f", "F", "FALSE", "false", "False"), False)}

# a micro-batch is bounded, and with it what one key can bring to a stateful operator at once
MAX_OFFSETS_PER_TRIGGER = 5_000_000
MAX_FILES_PER_TRIGGER = 1_000


def annotated(trigger: Mapping, annotations: Mapping[str, str], prefix: str = "") -> dict:
    """The trigger with the settings that annotations of its function give: ``<prefix>kafka-<setting>``, words joined by dashes.

    What the attributes name themselves wins.  A number or switch that does not read as one is an error.
    """
    attributes = json.loads(json.dumps(dict(trigger.get("attributes") or {})))

    def number(text: str) -> int:
        return int(text)

    def switch(text: str) -> bool:
        if text not in SWITCHES:
            raise ValueError(f"not a switch: '{text}'")
        return SWITCHES[text]

    for settings, read in ((ANNOTATED_TEXTS, str), (ANNOTATED_NUMBERS, number), (ANNOTATED_SWITCHES, switch),
                           (ANNOTATED_LISTS, lambda text: text.split(","))):
        for setting in settings:
            name = OTHER_NAMES.get(setting) or re.sub("(?<=[a-z])(?=[A-Z])", "-", setting).replace(".", "-").lower()
            value = annotations.get(f"{prefix}kafka-{name}")
            if not value:
                continue
            *parents, last = setting.split(".")
            place = attributes
            for parent in parents:
                place = place.setdefault(parent, {})
            place.setdefault(last, read(value))
    return {**trigger, "attributes": attributes}


def kafka_options(trigger: Mapping) -> dict[str, str]:
    """Options of Spark's Kafka source for a trigger configuration.

    Topics and a consumer group are required; brokers come from the attributes, else from the
    trigger's url.  The initial offset defaults to latest.  With `partitions`, only these of each topic are read.
    """
    attributes = dict(trigger.get("attributes") or {})
    topics = attributes.get("topics") or []
    if not topics:
        raise ValueError("topics must be set")
    if not attributes.get("consumerGroup"):
        raise ValueError("consumer group must be set")
    brokers = attributes.get("brokers") or ([trigger["url"]] if trigger.get("url") else [])
    if not brokers:
        raise ValueError("brokers must be passed either in url or in the attributes")
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        **({"assign": json.dumps({t: [int(p) for p in attributes["partitions"]] for t in topics})} if attributes.get("partitions")
           else {"subscribe": ",".join(topics)}),
        "kafka.group.id": attributes["consumerGroup"],
        "startingOffsets": initial_offset(attributes.get("initialOffset")),
        "includeHeaders": "true",
        "maxOffsetsPerTrigger": str(attributes.get("maxOffsetsPerTrigger") or MAX_OFFSETS_PER_TRIGGER),
        "kafka.fetch.min.bytes": str(attributes.get("fetchMin") or FETCH_MIN_BYTES),
        "kafka.max.partition.fetch.bytes": str(attributes.get("fetchDefault") or FETCH_DEFAULT_BYTES),
    }
    if attributes.get("fetchMax"):
        options["kafka.fetch.max.bytes"] = str(attributes["fetchMax"])
    for name, option, default in (("sessionTimeout", "kafka.session.timeout.ms", "10s"),
                                  ("heartbeatInterval", "kafka.heartbeat.interval.ms", "3s"),
                                  ("maxWaitTime", "kafka.fetch.max.wait.ms", "250ms"),
                                  ("retryBackoff", "kafka.retry.backoff.ms", "2s")):
        options[option] = str(duration_text_us(attributes.get(name) or default) // 1000)
    tls, sasl = attributes.get("tls") or {}, attributes.get("sasl") or {}
    secure = bool(attributes.get("caCert") or tls.get("enable"))
    if secure or sasl.get("enable"):
        options["kafka.security.protocol"] = ("SASL_" if sasl.get("enable") else "") + ("SSL" if secure else "PLAINTEXT")
    if secure:
        lowest = tls.get("minVersion") or "1.2"
        options["kafka.ssl.enabled.protocols"] = "TLSv1.2,TLSv1.3" if lowest == "1.2" else "TLSv1.3"
        if attributes.get("caCert"):
            options["kafka.ssl.truststore.type"] = "PEM"
            options["kafka.ssl.truststore.certificates"] = _certificate(attributes["caCert"])
        if attributes.get("accessKey") and attributes.get("accessCertificate"):
            options["kafka.ssl.keystore.type"] = "PEM"
            options["kafka.ssl.keystore.key"] = _certificate(attributes["accessKey"])
            options["kafka.ssl.keystore.certificate.chain"] = _certificate(attributes["accessCertificate"])
        if tls.get("insecureSkipVerify"):
            options["kafka.ssl.endpoint.identification.algorithm"] = ""
    if sasl.get("enable"):
        options |= _sasl(sasl)
    return options


def _certificate(flat: str) -> str:
    """A PEM text whose line breaks came as spaces."""
    head, dashes, rest = flat.partition("-----BEGIN ")
    if "\n" in flat or not dashes:
        return flat
    title, _, body = rest.partition("-----")
    body, _, tail = body.partition("-----END ")
    return f"-----BEGIN {title}-----\n" + "\n".join(body.split()) + f"\n-----END {tail.strip()}\n"


def _sasl(sasl: Mapping) -> dict[str, str]:
    mechanism = (sasl.get("mechanism") or "PLAIN").upper()
    if mechanism == "OAUTHBEARER":
        oauth = sasl.get("oauth") or {}
        module = ("org.apache.kafka.common.security.oauthbearer.OAuthBearerLoginModule required "
                  f'clientId="{oauth.get("clientId", "")}" clientSecret="{oauth.get("clientSecret", "")}" '
                  f'scope="{" ".join(oauth.get("scopes") or [])}";')
        extra = {"kafka.sasl.oauthbearer.token.endpoint.url": oauth.get("tokenURL", "")}
    else:
        login = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
        module = (f"org.apache.kafka.common.security.{login} required "
                  f'username="{sasl.get("user", "")}" password="{sasl.get("password", "")}";')
        extra = {}
    return {"kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": module, **extra}


def initial_offset(value: str | None) -> str:
    """``earliest`` or ``latest`` in any case; latest if not given."""
    lower = (value or "latest").lower()
    if lower not in ("earliest", "latest"):
        raise ValueError(f"initial offset must be either 'earliest' or 'latest', not '{value}'")
    return lower


def kinesis_options(trigger: Mapping) -> dict[str, str]:
    """Options of a Kinesis source for a trigger configuration."""
    attributes = dict(trigger.get("attributes") or {})
    iterator = attributes.get("iteratorType") or "LATEST"
    if iterator not in ("TRIM_HORIZON", "LATEST"):
        raise ValueError(f"unsupported iterator type: {iterator}")
    options = {"streamName": attributes["streamName"], "region": attributes.get("regionName", ""),
               "startingPosition": iterator,
               "pollingPeriodMs": str(duration_text_us(attributes.get("pollingPeriod") or "500ms") // 1000)}
    if attributes.get("shards"):
        options["shards"] = ",".join(attributes["shards"])
    return options


def eventhub_options(trigger: Mapping) -> dict[str, str]:
    """Options for an event hub through its Kafka endpoint."""
    attributes = dict(trigger.get("attributes") or {})
    namespace = attributes["namespace"]
    connection = (f"Endpoint=sb://{namespace}.servicebus.windows.net/;SharedAccessKeyName="
                  f"{attributes.get('sharedAccessKeyName', '')};SharedAccessKey={attributes.get('sharedAccessKeyValue', '')}")
    return kafka_options({"attributes": {
        "topics": [attributes["eventHubName"]], "consumerGroup": attributes.get("consumerGroup") or "$Default",
        "brokers": [f"{namespace}.servicebus.windows.net:9093"], "initialOffset": attributes.get("initialOffset"),
        "partitions": attributes.get("partitions"), "tls": {"enable": True},
        "sasl": {"enable": True, "mechanism": "PLAIN", "user": "$ConnectionString", "password": connection}}})


def starting_offsets(starts: DataFrame) -> str:
    """The `startingOffsets` of Spark's Kafka source for the rows of `resolve_start`: one row per partition of the topics read."""
    offsets: dict[str, dict[str, int]] = {}
    for topic, shard, at in starts.select("topic", "shard_id", "start_at").collect():
        offsets.setdefault(topic, {})[str(shard)] = at
    return json.dumps(offsets, sort_keys=True)


def open_stream(spark: SparkSession, trigger: Mapping, schema: StructType | str | None = None,
                starts: DataFrame | None = None) -> DataFrame:
    """A streaming frame for a trigger configuration, with bounded micro-batches; brokers start at `starts` (`resolve_start`).

    Kinds: ``kafka-cluster`` and ``eventhub`` (Spark's Kafka source), ``kinesis`` (a Kinesis source
    on the class path), and ``landing``: files of one `format` that arrive in `path`, read with
    `schema`.
    """
    kind = trigger.get("kind")
    if kind in ("kafka-cluster", "kafka", "eventhub"):
        options = eventhub_options(trigger) if kind == "eventhub" else kafka_options(trigger)
        if starts is not None:
            options["startingOffsets"] = starting_offsets(starts)
        return spark.readStream.format("kafka").options(**options).load()
    if kind == "kinesis":
        return spark.readStream.format("aws-kinesis").options(**kinesis_options(trigger)).load()
    if kind == "landing":
        attributes = dict(trigger.get("attributes") or {})
        if schema is None:
            raise ValueError("a landing stream needs a schema")
        reader = spark.readStream.format(attributes.get("format") or "parquet").schema(schema)
        for option, default in (("maxFilesPerTrigger", MAX_FILES_PER_TRIGGER), ("pathGlobFilter", None),
                                ("recursiveFileLookup", None)):
            value = attributes.get(option, default)
            if value is not None:
                reader = reader.option(option, str(value))
        return reader.load(attributes["path"])
    raise ValueError(f"unknown stream trigger kind: {kind}")


def resolve_start(claims: DataFrame, commits: DataFrame, start: str = "latest",
                  group: str | None = None) -> DataFrame:
    """Where each claimed (topic, shard_id) starts: `start_at` and whether it came from a commit.

    A commit wins over the configured start.  `start` is earliest / TRIM_HORIZON, latest / LATEST,
    or a number to seek to; claims carry the `earliest` and `latest` positions.
    """
    if start in ("TRIM_HORIZON", "LATEST"):
        start = "earliest" if start == "TRIM_HORIZON" else "latest"
    if str(start).lstrip("-").isdigit():
        fallback = F.lit(int(start)).cast("bigint")
    else:
        fallback = F.col(initial_offset(start))
    if group is not None:
        commits = commits.filter(F.col("group") == group)
    known = commits.select("topic", "shard_id", "committed")
    return claims.join(known, ["topic", "shard_id"], "left").select(
        "topic", "shard_id", F.coalesce("committed", fallback).alias("start_at"),
        F.col("committed").isNotNull().alias("from_commit"))


def topic_pattern(pattern: str, syntax: str) -> str:
    """Regular expression of a subscription pattern, by the public protocol rules.

    ``mqtt``: levels are split by ``/``, ``+`` is one level, a last ``#`` is any number of levels
    (its parent included).  ``amqp``: words are split by ``.``, ``*`` is one word, ``#`` is any
    number of words.
    """
    if syntax == "exact":
        return "^" + _quote(pattern) + "$"
    if syntax == "mqtt":
        levels = pattern.split("/")
        if "#" in levels[:-1] or any(("#" in x or "+" in x) and len(x) > 1 for x in levels):
            raise ValueError(f"bad topic filter: {pattern}")
        tail = levels[-1] == "#"
        body = "/".join("[^/]*" if x == "+" else _quote(x) for x in (levels[:-1] if tail else levels))
        # a leading wildcard does not reach topics of the broker itself
        guard = r"(?!\$)" if levels[0] in ("+", "#") else ""
        if not tail:
            return f"^{guard}{body}$"
        return f"^{guard}{body}(?:/.*)?$" if len(levels) > 1 else f"^{guard}.*$"
    if syntax == "amqp":
        out = ""
        words = pattern.split(".")
        words = [w for i, w in enumerate(words) if w != "#" or words[i - 1:i] != ["#"]]  # one "#" is as good as several
        if words == ["#"]:
            return "^.*$"
        for i, word in enumerate(words):
            if word == "#":
                # any number of words, each with the dot that parts it from its neighbours
                out += r"(?:\.[^.]*)*" if i else r"(?:[^.]*\.)*?"
                continue
            piece = r"[^.]*" if word == "*" else _quote(word)
            after_hash = out.endswith("*?")
            out += piece if i == 0 or after_hash else r"\." + piece
        return f"^{out}$"
    raise ValueError(f"unknown pattern syntax: {syntax}")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-/ " else "\\" + c for c in text)


def route_by_topic(df: DataFrame, subscriptions: Sequence[tuple[str, str]], syntax: str = "exact",
                   column: str = "topic") -> DataFrame:
    """One row per event and consumer that subscribes to its topic, as column `consumer`.

    `subscriptions` are (consumer, topic or pattern) pairs from the configuration.  A consumer gets
    an event once, however many of its patterns match.  No join: the patterns are part of the plan.
    """
    by_consumer: dict[str, list[str]] = {}
    for consumer, pattern in subscriptions:
        by_consumer.setdefault(consumer, []).append(pattern)
    hits = []
    for consumer, patterns in by_consumer.items():
        if syntax == "exact":
            match = F.col(column).isin(patterns)
        else:
            match = reduce(lambda a, b: a | b, (F.col(column).rlike(topic_pattern(p, syntax)) for p in patterns))
        hits.append(F.when(match, F.lit(consumer)))
    return df.withColumn("consumer", F.explode(F.array_compact(F.array(*hits))))


class TopicTrie:
    """Subscription patterns by topic level; `one` is a wildcard for a level, `many` for any number of levels."""

    def __init__(self) -> None:
        self.below: dict[str, TopicTrie] = {}
        self.one: TopicTrie | None = None
        self.many: TopicTrie | None = None
        self.loops = False
        self.consumers: set[str] = set()

    @classmethod
    def of(cls, subscriptions: Sequence[tuple[str, str]], syntax: str) -> TopicTrie:
        root = cls()
        for consumer, pattern in subscriptions:
            topic_pattern(pattern, syntax)  # refuses what is no pattern
            node = root
            for level in [pattern] if syntax == "exact" else pattern.split(SEPARATORS[syntax]):
                if syntax != "exact" and level == "#":
                    node.many = node.many or cls()
                    node = node.many
                    node.loops = True
                elif syntax != "exact" and level == WILDCARDS[syntax]:
                    node.one = node.one or cls()
                    node = node.one
                else:
                    node = node.below.setdefault(level, cls())
            node.consumers.add(consumer)
        return root

    def match(self, topic: str, syntax: str) -> set[str]:
        """The consumers with a pattern that fits: all paths of the trie that the topic's levels allow, taken side by side."""
        levels = [topic] if syntax == "exact" else topic.split(SEPARATORS[syntax])
        hidden = syntax == "mqtt" and topic.startswith("$")  # not reached by a leading wildcard
        here = {self} if hidden else self._closed({self})
        for i, level in enumerate(levels):
            after = set()
            for node in here:
                if level in node.below:
                    after.add(node.below[level])
                if node.one is not None and not (hidden and i == 0):
                    after.add(node.one)
                if node.loops:
                    after.add(node)
            here = self._closed(after)
        return set().union(*(node.consumers for node in here))

    @staticmethod
    def _closed(nodes: set[TopicTrie]) -> set[TopicTrie]:
        """With the nodes that no further level leads to."""
        todo = list(nodes)
        while todo:
            if (more := todo.pop().many) is not None and more not in nodes:
                nodes.add(more)
                todo.append(more)
        return nodes


# fixed values of the protocols
SEPARATORS, WILDCARDS = {"mqtt": "/", "amqp": "."}, {"mqtt": "+", "amqp": "*"}
FEW_TOPICS = 100_000


def route_by_trie(df: DataFrame, subscriptions: Sequence[tuple[str, str]], syntax: str = "exact", column: str = "topic",
                  few: int = FEW_TOPICS) -> DataFrame:
    """The same rows as `route_by_topic`, for any number of subscriptions.

    The patterns are a trie over topic levels that is walked once for each distinct topic; events meet their consumers by an equal
    topic.  The topics are counted: up to `few` are broadcast, more are joined as Spark sees fit.
    """
    listed = [(str(c), p) for c, p in subscriptions]
    TopicTrie.of(listed, syntax)
    sent = df.sparkSession.sparkContext.broadcast((listed, syntax))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, kind = sent.value
        trie = None
        for batch in batches:
            trie = trie or TopicTrie.of(patterns, kind)
            topics = batch.column("__topic")
            found = [sorted(trie.match(t, kind)) for t in topics.to_pylist()]
            yield pa.RecordBatch.from_arrays([topics, pa.array(found, pa.list_(pa.string()))], ["__topic", "__consumers"])

    topics = df.select(F.col(column).alias("__topic")).filter("__topic is not null").distinct()
    routes = written(topics.mapInArrow(walk, "__topic string, __consumers array<string>").filter(F.size("__consumers") > 0), "routes")
    routes = F.broadcast(routes) if routes.limit(few + 1).count() <= few else routes
    joined = df.join(routes, F.col(column) == F.col("__topic"))
    return joined.withColumn("consumer", F.explode("__consumers")).drop("__topic", "__consumers")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Events of several sources as one frame; each row keeps its trigger kind and name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
