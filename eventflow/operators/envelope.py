"""Records of every source kind as one event layout, and events as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventflow.functions.maps import any_case, empty_map, entries_any_case, entry_any_case, last_wins_map
from eventflow.schema import ENVELOPE, STRING_MAP


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_envelope(df: DataFrame, mapping: Mapping[str, Column | str], kind: str, name: str,
                trigger_class: str = "async", keep: tuple[str, ...] = ()) -> DataFrame:
    """Project `df` to the event layout.

    `mapping` names the source column of each attribute; the others become typed nulls, except
    that maps are empty and `size` is the body's byte count.  `keep` passes source columns on.
    """
    unknown = set(mapping) - set(ENVELOPE.names)
    if unknown:
        raise ValueError(f"not event attributes: {sorted(unknown)}")
    given = {"trigger_kind": F.lit(kind), "trigger_name": F.lit(name), "trigger_class": F.lit(trigger_class),
             **{k: _column(v) for k, v in mapping.items()}}
    columns = []
    for attribute in ENVELOPE:
        if attribute.name in given:
            value = given[attribute.name]
            value = value if attribute.name == "body_object" else value.cast(attribute.dataType)
            if attribute.dataType == STRING_MAP:
                value = F.coalesce(value, empty_map())
        elif attribute.dataType == STRING_MAP:
            value = empty_map()
        elif attribute.name == "size" and "body" in given:
            value = F.octet_length(given["body"].cast("binary")).cast("bigint")
        else:
            value = F.lit(None).cast(attribute.dataType)
        columns.append(value.alias(attribute.name))
    return df.select(*columns, *keep)


def normalize_kafka(df: DataFrame, name: str = "kafka", keep: tuple[str, ...] = ()) -> DataFrame:
    """Kafka source rows as events; of repeated header keys the last counts."""
    headers = last_wins_map(F.col("headers.key").cast("array<string>"), F.col("headers.value").cast("array<string>"))
    return to_envelope(df, {
        "body": "value", "shard_id": "partition", "path": "topic", "topic": "topic", "offset": "offset",
        "ts": "timestamp", "headers": headers}, "kafka-cluster", name, keep=keep)


def normalize_shard_records(df: DataFrame, kind: str = "shard-stream", name: str | None = None,
                            keep: tuple[str, ...] = ()) -> DataFrame:
    """Shard records as events: ``shard-stream``, ``kinesis`` or ``eventhub``.

    Event hub records carry an array of data sections, of which the first is the body.  Position
    columns are used where the record has them.
    """
    mapping: dict[str, Column | str] = {"body": "data"}
    if kind == "eventhub":
        mapping["body"] = F.get(F.col("data"), F.lit(0))
    elif kind not in ("shard-stream", "kinesis"):
        raise ValueError(f"unknown shard source: {kind}")
    present = set(df.columns)
    if "stream_path" in present:
        mapping["topic"] = "stream_path"
    if "shard_id" in present:
        mapping["shard_id"] = "shard_id"
    if "sequence" in present:
        mapping["offset"] = "sequence"
    if {"arrival_sec", "arrival_nsec"} <= present:
        mapping["ts"] = item_time(F.col("arrival_sec"), F.col("arrival_nsec"))
    return to_envelope(df, mapping, kind, name or kind, keep=keep)


def item_time(seconds: Column, nanos: Column) -> Column:
    """Timestamp of whole seconds plus nanoseconds, to the microsecond."""
    return F.timestamp_micros(seconds.cast("bigint") * 1_000_000
                              + F.floor(nanos.cast("bigint") / F.lit(1000)).cast("bigint"))


def normalize_queue(df: DataFrame, kind: str, name: str | None = None, url: str | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Queue messages as events: ``rabbit-mq``, ``mqtt``, ``nats`` or ``pubsub``.

    `url` is the broker address of an MQTT trigger.
    """
    mapping: dict[str, Column | str] = {"body": "payload"}
    if kind == "rabbit-mq":
        mapping |= {"id": "message_id", "method": "type", "url": "reply_to", "headers": "headers",
                    "path": F.concat(F.coalesce("exchange", F.lit("")), F.lit("/"),
                                     F.coalesce("routing_key", F.lit(""))),
                    "content_type": "content_type", "ts": "ts"}
    elif kind == "mqtt":
        mapping |= {"id": "message_id", "path": "topic", "topic": "topic", "url": F.lit(url)}
    elif kind == "nats":
        mapping |= {"path": "subject", "headers": "headers"}
    elif kind == "pubsub":
        mapping |= {"path": "topic", "url": "topic", "headers": "headers"}
    else:
        raise ValueError(f"unknown queue kind: {kind}")
    return to_envelope(df, mapping, kind, name or kind, keep=keep)


def query_fields(url: Column) -> Column:
    """The query arguments of a URL as a map, decoded; of repeated names the last counts."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    return last_wins_map(
        F.transform(parts, lambda p: decoded(F.substring_index(p, "=", 1))),
        F.transform(parts, lambda p: F.when(F.contains(p, F.lit("=")), decoded(F.substr(p, F.instr(p, "=") + 1)))
                    .otherwise(F.lit(""))))


def normalize_http_log(df: DataFrame, name: str = "http", keep: tuple[str, ...] = ()) -> DataFrame:
    """Request log rows (method, url, headers, body, ts) as events."""
    path = F.try_parse_url("url", F.lit("PATH"))
    return to_envelope(df, {
        "method": "method", "url": "url", "path": F.when(path == "", F.lit("/")).otherwise(path),
        "fields": query_fields(F.col("url")), "headers": "headers",
        "content_type": any_case("headers", "Content-Type"), "body": "body", "ts": "ts"},
        "http", name, trigger_class="sync", keep=keep)


def normalize_schedule(ticks: DataFrame, body: str = "", headers: Mapping[str, str] | None = None,
                       path: str | None = None, method: str | None = None, kind: str = "cron",
                       name: str = "cron") -> DataFrame:
    """Scheduled ticks (column `tick`) as events that all carry the configured template."""
    items = [F.lit(x) for pair in (headers or {}).items() for x in pair]
    return to_envelope(ticks, {
        "ts": "tick", "body": F.lit(body), "path": F.lit(path), "method": F.lit(method),
        "headers": F.create_map(*items) if items else empty_map()}, kind, name)


def normalize_items(df: DataFrame, name: str = "item-poller", keep: tuple[str, ...] = ()) -> DataFrame:
    """Polled items (system columns and an `attributes` map) as events; headers hold both."""
    system = ("__name", "__mtime_secs", "__mtime_nsecs", "__obj_type", "__size")
    own = F.map_filter(F.coalesce("attributes", empty_map()), lambda k, v: ~k.isin(*system))
    given = F.create_map(*[x for c in system for x in (F.lit(c), F.col(c).cast("string"))])
    return to_envelope(df, {
        "headers": F.map_concat(own, given), "ts": item_time(F.col("__mtime_secs"), F.col("__mtime_nsecs")),
        "size": "__size", "path": "__name", "url": "__name"}, "item-poller", name, trigger_class="batch",
        keep=keep)


def unwrap_cloudevents(df: DataFrame) -> DataFrame:
    """Replace the attributes of events that wrap a cloud event.

    Structured form: the content type starts with ``application/cloudevents`` and the body is a
    JSON object.  Binary form: the header ``CE-CloudEventsVersion`` is not empty and the
    ``CE-*`` headers (in any case) hold the attributes.  A structured body that does not parse keeps the row
    unchanged with `decode_error` set; a binary time that does not parse is null.
    """
    content_type = F.coalesce("content_type", F.lit(""))
    structured = content_type.startswith("application/cloudevents")
    # columns of their own, so that documents are parsed and headers looked through once
    df = df.withColumns({"__doc": F.when(structured, F.try_parse_json(F.col("body").cast("string"))),
                         "__ce": entries_any_case("headers", "CE-")})
    binary = ~structured & (entry_any_case(F.col("__ce"), "CE-CloudEventsVersion") != "")

    def doc(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("__doc", path, kind)

    time_text = doc("$.eventTime")
    event_time = F.try_to_timestamp(time_text)
    no_object = ~F.coalesce(F.schema_of_variant("__doc").startswith("OBJECT"), F.lit(False))
    bad = structured & (no_object | (time_text.isNotNull() & event_time.isNull()))
    good = structured & ~bad
    data = doc("$.data", "variant")
    is_object = F.schema_of_variant(data).startswith("OBJECT")

    def pick(name: str, from_doc: Column, from_header: Column | None) -> Column:
        chosen = F.when(good, from_doc)
        if from_header is not None:
            chosen = chosen.when(binary, from_header)
        return chosen.otherwise(F.col(name)).alias(name)

    def ce(name: str) -> Column:
        return entry_any_case(F.col("__ce"), f"CE-{name}")

    changed = {
        "id": pick("id", doc("$.eventID"), ce("EventID")),
        "trigger_kind": pick("trigger_kind", doc("$.source"), ce("Source")),
        "trigger_name": pick("trigger_name", doc("$.source"), ce("Name")),
        "trigger_class": pick("trigger_class", F.lit("unsupported"), F.lit("unsupported")),
        "content_type": pick("content_type", F.coalesce(doc("$.contentType"), F.lit("")), None),
        "headers": pick("headers", F.coalesce(doc("$.extensions", "map<string,string>"), empty_map()), None),
        "ts": pick("ts", event_time, F.try_to_timestamp(ce("EventTime"))),
        "type": pick("type", doc("$.eventType"), ce("EventType")),
        "type_version": pick("type_version", doc("$.eventTypeVersion"), ce("EventTypeVersion")),
        "version": pick("version", doc("$.cloudEventsVersion"), ce("CloudEventsVersion")),
        "body": pick("body", F.when(F.schema_of_variant(data) == "STRING", doc("$.data").cast("binary")), None),
        "body_object": pick("body_object", F.when(is_object, data), None),
    }
    error = F.when(bad, F.lit("Failed to wrap structured cloud event"))
    kept = [changed.get(c, F.col(c)) for c in df.columns if c not in ("__doc", "__ce")]
    return df.select(*kept, error.alias("decode_error"))


def ensure_id(df: DataFrame, deterministic: bool = True) -> DataFrame:
    """Give an id to events without one; existing ids stay.

    Deterministic ids hash (topic, shard_id, offset), so a retried task yields the same id.  An event that lacks any of
    these has no identity but its own arrival and gets a random id; write such events before using them twice.
    """
    names = ("topic", "shard_id", "offset")
    placed = F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & F.col(names[2]).isNotNull()
    position = F.concat_ws("/", *[F.col(n).cast("string") for n in names])
    fresh = F.when(placed, F.sha2(position, 256)).otherwise(F.uuid()) if deterministic else F.uuid()
    return df.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), fresh))


def encode_event(df: DataFrame, name: str = "encoded") -> DataFrame:
    """Add the JSON text of each event.

    The body is base64, or the object itself where the event has one; the time is in whole
    seconds since the epoch.
    """
    def text(column: str) -> Column:
        return F.coalesce(column, F.lit(""))

    head = [
        text("content_type").alias("content_type"),
        text("content_type").alias("content-type"),
        F.struct(text("trigger_kind").alias("kind"), text("trigger_name").alias("name")).alias("trigger"),
        F.col("fields"), F.col("headers"), text("id").alias("id"), text("method").alias("method"),
        text("path").alias("path"), F.coalesce(F.octet_length("body"), F.lit(0)).alias("size"),
        F.unix_seconds("ts").alias("timestamp"), text("url").alias("url"),
        F.coalesce("shard_id", F.lit(0)).alias("shard_id"), F.coalesce("num_shards", F.lit(0)).alias("num_shards"),
        text("type").alias("type"), text("type_version").alias("type_version"), text("version").alias("version"),
        F.coalesce("offset", F.lit(0)).alias("offset"), text("topic").alias("topic")]
    plain = F.to_json(F.struct(*head, F.coalesce(F.base64("body"), F.lit("")).alias("body")))
    nested = F.to_json(F.struct(*head, F.col("body_object").alias("body")))
    return df.withColumn(name, F.when(F.col("body_object").isNotNull(), nested).otherwise(plain))


_RESULT = ("array<struct<body:string, content_type:string, headers:map<string,string>, status_code:int, "
           "body_encoding:string, event_id:string>>")


# what a result's attributes must be, as far as they are there
_TYPES = {"status_code": ("BIGINT",), "body": ("STRING",), "content_type": ("STRING",), "body_encoding": ("STRING",),
          "event_id": ("STRING",), "headers": ("OBJECT",)}


def _is_results(document: Column) -> Column:
    """Whether a document is an object, or a list of objects, whose attributes have the right types."""
    def fits(item: Column) -> Column:
        good = F.schema_of_variant(item).startswith("OBJECT")
        for name, kinds in _TYPES.items():
            kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
            good = good & F.coalesce(kind.rlike(f"^(?:VOID|{'|'.join(kinds)})"), F.lit(True))
        return F.coalesce(good, F.lit(False))

    listed = F.try_variant_get(document, "$", "array<variant>")
    return F.when(F.schema_of_variant(document).startswith("ARRAY"), F.coalesce(F.forall(listed, fits), F.lit(False))).otherwise(fits(document))


def decode_results(df: DataFrame, column: str = "data") -> DataFrame:
    """One row per handler result in a JSON text that holds one result or a list of them.

    Adds the result's attributes, `decoded_body`, and `result_error` for text that is not JSON, is neither an object nor a
    list of objects, or has an attribute of another type, and for an unknown body encoding.
    """
    # each step is a column that the next one uses more than once, so none is repeated
    parsed = df.withColumn("__doc", F.try_parse_json(column)).withColumn("__good", F.coalesce(_is_results(F.col("__doc")), F.lit(False))).drop("__doc")
    results = F.when(F.col("__good"), F.from_json(column, _RESULT))
    rows = parsed.select("*", (~F.col("__good")).alias("__bad"), F.explode_outer(results).alias("__r"))
    encoding = F.col("__r.body_encoding")
    body = F.col("__r.body")
    decoded = (F.when(encoding == "text", body.cast("binary"))
               .when(encoding == "base64", F.try_to_binary(body, F.lit("base64"))))
    error = (F.when(F.col("__bad"), F.lit("Failed to unmarshal result"))
             .when(F.col("__r").isNull(), None)
             .when(~F.coalesce(encoding, F.lit("")).isin("text", "base64"),
                   F.format_string('Unknown body encoding - "%s"', F.coalesce(encoding, F.lit(""))))
             .when(decoded.isNull() & body.isNotNull(), F.lit("Failed to decode body")))
    return rows.select(*df.columns, "__r.status_code", "__r.content_type", "__r.headers",
                       F.col("__r.event_id").alias("result_event_id"), "__r.body_encoding", decoded.alias("decoded_body"), error.alias("result_error"))
