"""Reading one log line: fields, time, worker, arguments, formatted text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventflow.functions.maps import sorted_pairs

# fixed values: keys of a log line that are not extra arguments
LINE_KEYS = ("time", "level", "message", "name", "more", "datetime", "with")

# fixed values: messages that are never brief, and messages that always are
IGNORED_SUBSTRINGS = (
    "Unexpected termination of child process",
    "Failed to read from event connection",
    "Failed to read control message",
)
KNOWN_FAILURES = ("Failed to connect to broker",)

_CLOCK = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})$"
_WORKER_NAME = r"^processor\..*\.w[0-9]+\..*"


def strip_line(line: Column) -> Column:
    """The JSON text of a line: without one leading ``l`` and one trailing comma."""
    body = F.when(line.startswith("l"), F.substr(line, F.lit(2))).otherwise(line)
    return F.when(body.endswith(","), F.left(body, F.length(body) - 1)).otherwise(body)


def text_time(text: Column) -> Column:
    """Timestamp of a text like 2020-02-27T12:10:04.805Z, or with an offset with or without colon."""
    with_colon = F.when(text.endswith("Z"), text).otherwise(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.when(text.rlike(_CLOCK), F.try_to_timestamp(with_colon))


def text_clock(text: Column) -> Column:
    """HH:MM:SS.mmm as the text has it, in its own offset."""
    fraction = F.regexp_extract(text, r"T\d{2}:\d{2}:\d{2}\.(\d+)", 1)
    return F.concat(F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(fraction, 1, 3), 3, "0"))


def datetime_text(text: Column) -> Column:
    """A ``YYYY-MM-DD HH:MM:SS,mmm`` text in the form `text_time` reads."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, "^([^ ]*) ", "$1T"), "^([^,]*),", "$1."), F.lit("Z"))


def log_time(value: Column) -> Column:
    """Timestamp of a time given as text: epoch milliseconds, or any of the text layouts."""
    number = value.rlike(r"^-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?$")
    millis = F.floor(F.when(number, value.try_cast("double"))).cast("bigint")
    return (F.when(number, F.timestamp_millis(millis)).when(F.contains(value, F.lit(" ")), text_time(datetime_text(value)))
            .otherwise(text_time(value)))


def worker_id(given: Column, name: Column) -> Column:
    """The given worker id, else the third part of a worker's logger name without its first letter."""
    inferred = F.substr(F.get(F.split(name, r"\."), F.lit(2)), F.lit(2))
    return F.coalesce(F.nullif(given, F.lit("")), F.when(name.rlike(_WORKER_NAME), inferred), F.lit(""))


def quoted_pairs(mapping: Column) -> Column:
    """``k="v"`` pairs of a map, sorted by key."""
    return sorted_pairs(mapping, lambda k, v: F.concat(k, F.lit('="'), v, F.lit('"')), " || ")


def message_and_args(message: Column, with_map: Column, more_text: Column, more_map: Column, extra: Column) -> Column:
    """The message, followed by its arguments in brackets.

    `with_map` replaces `more`, which is a text or a map; `extra` are further string keys of the
    line.  Keys are sorted.  An empty `with_map` still gives empty brackets.
    """
    from_more = (F.when(F.size(more_map) > 0, sorted_pairs(more_map, lambda k, v: F.concat(k, F.lit("="), v), " || "))
                 .when(more_text != "", more_text))
    first = F.when(with_map.isNotNull(), quoted_pairs(with_map)).otherwise(from_more)
    second = F.when(F.size(extra) > 0, quoted_pairs(extra))
    return F.when(first.isNull() & second.isNull(), message).otherwise(
        F.concat(message, F.lit(" ["), F.concat_ws(" || ", first, second), F.lit("]")))


def level_letter(level: Column) -> Column:
    """First letter of a level, in upper case."""
    return F.upper(F.substring(level, 1, 1))


def format_line(clock: Column, level: Column, text: Column) -> Column:
    """``[HH:MM:SS.mmm] (L) text``."""
    return F.concat(F.lit("["), clock, F.lit("] ("), level_letter(level), F.lit(") "), text)


def is_brief(level: Column, message: Column, worker: Column) -> Column:
    """Whether a line belongs to the brief errors."""
    def holds_any(texts) -> Column:
        out = F.lit(False)
        for text in texts:
            out = out | F.contains(message, F.lit(text))
        return out

    return (~holds_any(IGNORED_SUBSTRINGS) & worker.isin("", "0")
            & (~level_letter(level).isin("D", "I") | holds_any(KNOWN_FAILURES)))


def unescape(text: Column) -> Column:
    """Written escapes of newline, tab, backslash and quote as the characters."""
    for written, real in (("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\"), ('\\"', '"')):
        text = F.replace(text, F.lit(written), F.lit(real))
    return text


def normalize_level(level: Column) -> Column:
    """error, warn, info or debug."""
    lower = F.lower(level)
    return (F.when(lower.isin("error", "critical", "fatal"), "error").when(lower == "warning", "warn")
            .when(lower == "warn", "warn").when(lower == "info", "info").otherwise("debug"))


def level_rank(level: Column) -> Column:
    """Order of normalized levels, debug first."""
    normal = normalize_level(level)
    return F.when(normal == "error", 3).when(normal == "warn", 2).when(normal == "info", 1).otherwise(0)
