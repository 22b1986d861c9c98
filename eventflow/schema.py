"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("trigger_kind", T.StringType()),
    T.StructField("trigger_name", T.StringType()),
    T.StructField("trigger_class", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("headers", STRING_MAP),
    T.StructField("fields", STRING_MAP),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("shard_id", T.IntegerType()),
    T.StructField("num_shards", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("type_version", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("body_object", T.VariantType()),
])

RESPONSE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("headers", STRING_MAP),
    T.StructField("no_ack", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
])

RECORDED = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("headers", STRING_MAP),
    T.StructField("timestamp", T.TimestampType()),
])
