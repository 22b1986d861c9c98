"""Log lines of functions: parsing, brief errors, repeats, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventflow.functions import logtext as L
from eventflow.operators.ordered import CHUNK_ROWS, ordered
from eventflow.session import written

EVENT_LOG_BYTES = 4096
HOT_SHARE = 10_000


_FIELDS = "struct<" + ",".join(f"`{k}`:variant" for k in L.LINE_KEYS) + ">"


def parse_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add the parsed fields of each line; `raw` marks lines that are not log records.

    A record is a JSON object with time (or datetime), level and message; `with` values must be
    strings.  Adds time, clock, level, message, name, worker, text, formatted and brief.
    """
    # each step is a projection of its own, so that no parse is repeated
    stripped = F.ltrim(L.strip_line(F.col(column)))
    df = lines.withColumn("__d", F.when(stripped.startswith("{"), F.try_parse_json(stripped)))
    df = df.withColumn("__s", F.try_variant_get("__d", "$", _FIELDS))
    df = df.withColumns({f"__k_{k}": F.coalesce(F.schema_of_variant(F.col("__s")[k]), F.lit("VOID")) for k in L.LINE_KEYS})

    def kind(name: str):
        return F.col(f"__k_{name}")

    def string(name: str):
        return F.when(kind(name) == "STRING", F.try_variant_get(F.col("__s")[name], "$", "string"))

    def is_object(name: str):
        return kind(name).startswith("OBJECT")

    def map_of(name: str, values: str):
        return F.when(is_object(name), F.try_variant_get(F.col("__s")[name], "$", f"map<string,{values}>"))

    is_number = kind("time").isin("BIGINT", "DOUBLE", "FLOAT") | kind("time").startswith("DECIMAL")
    known = sum((F.col("__s")[k].isNotNull().cast("int") for k in L.LINE_KEYS), F.lit(0))
    df = df.withColumns({
        "__level": string("level"), "__message": string("message"), "__name": string("name"),
        "__stamp": F.when(kind("datetime") == "STRING", L.datetime_text(string("datetime"))).otherwise(string("time")),
        "__millis": F.when((kind("datetime") == "VOID") & is_number,
                           F.floor(F.try_variant_get(F.col("__s")["time"], "$", "double")).cast("bigint")),
        "__with": map_of("with", "string"), "__more": string("more"), "__more_map": map_of("more", "string"),
        "__every": F.when(F.col("__s").isNotNull(), F.try_variant_get("__d", "$", "map<string,variant>")),
        "__known": known})
    with_ok = (kind("with") == "VOID") | F.coalesce(F.forall(
        F.map_values(map_of("with", "variant")), lambda v: F.schema_of_variant(v).isin("STRING", "VOID")), F.lit(False))
    extra = F.when(F.size("__every") > F.col("__known"), F.map_filter(
        "__every", lambda k, v: ~k.isin(*L.LINE_KEYS) & (F.schema_of_variant(v) == "STRING")))
    df = df.withColumns({
        "__time": F.coalesce(L.text_time(F.col("__stamp")), F.timestamp_millis("__millis")),
        "__fine": (F.col("__level") != "") & F.col("__message").isNotNull() & kind("name").isin("STRING", "VOID")
        & kind("datetime").isin("STRING", "VOID") & with_ok,
        "__extra": F.transform_values(extra, lambda k, v: F.try_variant_get(v, "$", "string"))})
    df = df.withColumns({
        "raw": ~F.coalesce(F.col("__fine") & F.col("__time").isNotNull(), F.lit(False)),
        "__worker": L.worker_id(F.try_element_at("__with", F.lit("worker_id")), F.col("__name")),
        "__clock": F.when(F.col("__stamp").isNotNull(), L.text_clock(F.col("__stamp"))).otherwise(
            F.date_format(F.timestamp_millis("__millis"), "HH:mm:ss.SSS")),
        "__text": F.when(F.col("__fine"), L.message_and_args(
            F.col("__message"), F.col("__with"), F.col("__more"), F.col("__more_map"), F.col("__extra")))})

    def kept(name: str):
        return F.when(~F.col("raw"), F.col(f"__{name}")).alias(name)

    return df.select(
        *lines.columns, "raw", *[kept(n) for n in ("time", "clock", "level", "message", "name", "worker", "text")],
        F.when(F.col("raw"), F.col(column)).otherwise(
            L.format_line(F.col("__clock"), F.col("__level"), F.col("__text"))).alias("formatted"),
        F.when(~F.col("raw"), L.is_brief(F.col("__level"), F.col("__message"), F.col("__worker"))).alias("brief"))


def suppress_after_panic(parsed: DataFrame, keys: Sequence[str] = ("stream",), order: str = "seq",
                         column: str = "line") -> DataFrame:
    """Add `brief_raw`: raw lines before the stream's first line that starts a panic or call stack.

    That line's position is one minimum per stream, so no stream is put in order for it.  Such a
    line is never a record, so finding it needs no parsing.
    """
    stops = F.col(column).startswith("panic: Wrapper") | F.col(column).startswith("Call stack:")
    first = parsed.filter(stops).groupBy(*keys).agg(F.min(order).alias("__stop"))
    return (parsed.join(first, list(keys), "left")
            .withColumn("brief_raw", F.col("raw") & (F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))))
            .drop("__stop"))


def collapse_repeats(df: DataFrame, keys: Sequence[str], order: str, column: str,
                     chunk_rows: int = CHUNK_ROWS, at_most: int | None = None) -> DataFrame:
    """One row per run of equal neighbouring values, in `order` within `keys`.

    Gives the keys, the order value of the run's first row, `repeats`, the value, and `collapsed`:
    ``[repeated N times] value`` for runs of more than one.  `at_most` is a known bound of the
    number of rows.
    """
    # wrapped, so that "no row before" and "null before" differ
    wrapped = df.withColumn("__value", F.struct(F.col(column).alias("v")))
    scan = ordered(wrapped, keys, [order], chunk_rows, at_most).lag({"__previous": "__value"})
    begins = F.col("__previous").isNull() | ~F.col(column).eqNullSafe(F.col("__previous.v"))
    scan = scan.with_columns({"__begin": F.when(begins, F.col(order))}).last_value("__begin", "__start")
    runs = scan.rows.groupBy(*keys, F.col("__start").alias(order), column).agg(F.count(F.lit(1)).alias("repeats"))
    text = F.when(F.col("repeats") > 1, F.concat(
        F.lit("[repeated "), F.col("repeats").cast("string"), F.lit(" times] "), column)).otherwise(F.col(column))
    return runs.select(*keys, order, "repeats", column, text.alias("collapsed"))


def log_report(lines: DataFrame, keys: Sequence[str] = ("stream",), order: str = "seq", column: str = "line",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The report of each stream, one row per report line.

    `part` is ``formatted`` (every line) or ``brief`` (errors, repeats collapsed); lines follow
    `order` within (stream, part).  A report is not put into one text, as a stream has no size
    limit; write it sorted by (keys, part, order).  The parsed lines are written once to the shared
    folder, as the report reads them several times.
    """
    seen = [*keys, order, *{column, "text", "formatted", "brief", "raw", "brief_raw"}]
    marked = written(suppress_after_panic(parse_logs(lines, column), keys, order, column).select(*seen), "parsed")
    formatted = marked.select(*keys, F.lit("formatted").alias("part"), order,
                              L.unescape(F.col("formatted")).alias("text"))
    short = marked.filter((F.coalesce("brief", F.lit(False)) & (F.col("raw") | (F.col("text") != ""))) | F.col("brief_raw")).select(
        *keys, order, F.when(F.col("raw"), F.col(column)).otherwise(F.col("text")).alias("__text"))
    brief = collapse_repeats(short, keys, order, "__text", chunk_rows).select(
        *keys, F.lit("brief").alias("part"), order, L.unescape(F.col("collapsed")).alias("text"))
    return formatted.unionByName(brief)


def filter_level(logs: DataFrame, minimum: str, column: str = "level") -> DataFrame:
    """Lines at or above a level."""
    return logs.filter(L.level_rank(F.col(column)) >= L.level_rank(F.lit(minimum)))


def event_logs(logs: DataFrame, keys: Sequence[str] = ("event_id",), order: str = "seq",
               column: str = "entry") -> DataFrame:
    """The log entries (JSON texts) of an event as one JSON array, if below 4096 bytes.

    Sizes are summed first, so that only entries of small arrays are brought together.  Events
    with a great share of all entries are dropped before the shuffle.
    """
    sizes = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                    (F.sum(F.octet_length(column)) + F.count(F.lit(1)) + 1).alias("__bytes"))
    total = sizes.agg(F.sum("__n")).scalar()
    # no more than HOT_SHARE events can each hold more than that part of all entries
    hot = sizes.filter((F.col("__bytes") >= EVENT_LOG_BYTES) & (F.col("__n") * HOT_SHARE > total)).select(*keys)
    small = sizes.filter(F.col("__bytes") < EVENT_LOG_BYTES).select(*keys)
    entries = F.sort_array(F.collect_list(F.struct(order, column)))
    rest = logs.join(F.broadcast(hot), list(keys), "left_anti").join(small, list(keys), "left_semi")
    return rest.groupBy(*keys).agg(
        F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: e[column]), ","), F.lit("]")).alias("logs"))
