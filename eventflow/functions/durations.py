"""Duration texts such as ``250ms`` or ``2h45m`` as numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: units of duration texts, in microseconds
UNIT_MICROS = {"ns": 0.001, "us": 1.0, "µs": 1.0, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9}

_NUMBER = r"(?:\d+(?:\.\d*)?|\.\d+)"
_UNIT = r"(?:ns|us|µs|ms|s|m|h)"
VALID = rf"^[+-]?(?:0|(?:{_NUMBER}{_UNIT})+)$"


def duration_us(text: Column) -> Column:
    """Microseconds of a duration text; null when it does not parse or is too long for a number."""
    units = F.create_map(*[F.lit(x) for pair in UNIT_MICROS.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(rf"{_NUMBER}{_UNIT}"), F.lit(0))

    def micros(part: Column) -> Column:
        number = F.regexp_extract(part, rf"^({_NUMBER})", 1).cast("double")
        return number * F.try_element_at(units, F.regexp_extract(part, rf"({_UNIT})$", 1))

    total = F.aggregate(F.transform(parts, micros), F.lit(0.0), lambda acc, x: acc + x)
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.when(text.rlike(VALID), (F.round(total) * sign).try_cast("bigint"))


def duration_text_us(text: str) -> int:
    """The same for a driver-side setting; raises on a text that does not parse."""
    import re

    if not re.match(VALID, text):
        raise ValueError(f"invalid duration: {text!r}")
    total = sum(float(n) * UNIT_MICROS[u] for n, u in re.findall(rf"({_NUMBER})({_UNIT})", text))
    return round(-total if text.startswith("-") else total)
