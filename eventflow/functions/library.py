"""Small handlers as native expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventflow.functions.maps import sorted_pairs

# fixed values: the named patterns of the compliance scan
SCAN_PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "Credit card": r"\b(?:\d[ -]*?){13,16}\b",
}


def scan_patterns(df: DataFrame, column: str, patterns: Mapping[str, str] | None = None,
                  name: str = "found") -> DataFrame:
    """Add the sorted names of the patterns found in a text."""
    patterns = SCAN_PATTERNS if patterns is None else patterns
    hits = [F.when(F.col(column).rlike(p), F.lit(n)) for n, p in sorted(patterns.items())]
    return df.withColumn(name, F.array_compact(F.array(*hits)))


def reverse_body(df: DataFrame, column: str = "body") -> DataFrame:
    """Reverse a text body by characters."""
    return df.withColumn(column, F.reverse(F.col(column).cast("string")))


def json_field(df: DataFrame, column: str, path: str, kind: str = "string", name: str = "value") -> DataFrame:
    """Add one field of a JSON body, and `error` where the body is not JSON."""
    document = F.try_parse_json(F.col(column).cast("string"))
    return df.withColumns({name: F.try_variant_get(document, path, kind),
                           "error": F.when(document.isNull() & F.col(column).isNotNull(), F.lit("malformed body"))})


# fixed values: units of time and their short forms
DATE_UNITS = {"year": "y", "quarter": "Q", "month": "M", "week": "w", "day": "d", "hour": "h", "minute": "m",
              "second": "s", "millisecond": "ms"}


def date_add_unit(df: DataFrame, ts: str, value: str, unit: str, name: str = "shifted") -> DataFrame:
    """Add `value` `unit`s to a timestamp; an unknown unit gives null.

    Units are singular or plural in any case, or short, where ``M`` is a month and ``m`` a minute.
    """
    lower = F.lower(unit)
    shifted = F.lit(None).cast("timestamp")
    for long, short in reversed(DATE_UNITS.items()):
        shifted = F.when(lower.isin(long, long + "s") | (F.col(unit) == short),
                         F.timestamp_add(long.upper(), F.col(value).cast("int"), F.col(ts))).otherwise(shifted)
    return df.withColumn(name, shifted)


def slugify(df: DataFrame, column: str, name: str = "slug") -> DataFrame:
    """Lower-case ASCII letters and digits joined by single dashes.  Other characters separate."""
    dashed = F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]+", "-")
    return df.withColumn(name, F.btrim(dashed, F.lit("-")))


def encrypt_body(df: DataFrame, key_conf: str, column: str = "body", header: str = "X-Encryption") -> DataFrame:
    """AES-GCM encrypt a body; the algorithm goes to a header.

    `key_conf` names a session setting that holds the base64 key.  The key enters as a subquery over
    a one-row table, so plan texts do not show it.
    """
    return df.withColumns({
        column: F.aes_encrypt(F.col(column).cast("binary"), _key(df, key_conf), F.lit("GCM")),
        "headers": F.map_concat(F.map_filter("headers", lambda k, v: k != header),
                                F.create_map(F.lit(header), F.lit("AES-GCM")))})


def decrypt_body(df: DataFrame, key_conf: str, column: str = "body") -> DataFrame:
    """The inverse of `encrypt_body`; null where the key does not fit."""
    return df.withColumn(column, F.try_aes_decrypt(F.col(column), _key(df, key_conf), F.lit("GCM")))


def _key(df: DataFrame, key_conf: str) -> Column:
    spark = df.sparkSession
    return spark.createDataFrame([(spark.conf.get(key_conf),)], "key string").select(F.unbase64("key")).scalar()


def render_fields(df: DataFrame, column: str = "fields", name: str = "rendered") -> DataFrame:
    """Add the fields as sorted ``k=v`` pairs joined by commas."""
    return df.withColumn(name, sorted_pairs(F.col(column), lambda k, v: F.concat(k, F.lit("="), v), ","))


