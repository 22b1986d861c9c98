"""Map building and typed access to header and field maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventflow.schema import STRING_MAP


def empty_map() -> Column:
    """An empty map<string,string>."""
    return F.create_map().cast(STRING_MAP)


def last_wins_map(keys: Column, values: Column) -> Column:
    """Map from an array of keys and an array of values; of equal keys the last counts.

    ``map_from_arrays`` refuses equal keys, so only where there are some they are made distinct,
    reading from the back.
    """
    back_keys, back_values = F.reverse(keys), F.reverse(values)
    distinct = F.array_distinct(back_keys)
    last = F.transform(distinct, lambda k: F.get(back_values, (F.array_position(back_keys, k) - 1).cast("int")))
    return (F.when(keys.isNull(), empty_map())
            .when(F.size(distinct) == F.size(keys), F.map_from_arrays(keys, values))
            .otherwise(F.map_from_arrays(distinct, last)))


def typed_value(mapping: Column | str, key: str, kind: str = "string") -> Column:
    """One entry of a string map as ``string``, ``bytes`` or ``int``.

    An absent key is an empty string, empty bytes, or a null integer.
    """
    mapping = F.col(mapping) if isinstance(mapping, str) else mapping
    raw = F.try_element_at(mapping, F.lit(key))
    if kind == "string":
        return F.coalesce(raw, F.lit(""))
    if kind == "bytes":
        return F.coalesce(raw, F.lit("")).cast("binary")
    if kind == "int":
        return raw.try_cast("bigint")
    raise ValueError(f"unknown value kind: {kind}")


def any_case(mapping: Column | str, key: str) -> Column:
    """The entry whose key equals `key` in any case, of several the last; an empty string if there is none."""
    mapping = F.col(mapping) if isinstance(mapping, str) else mapping
    return entry_any_case(F.map_entries(mapping), key)


def entry_any_case(entries: Column, key: str) -> Column:
    """The same from an array of entries, for several lookups in a part of a map."""
    fitting = F.filter(entries, lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(fitting, F.lit(-1))["value"], F.lit(""))


def entries_any_case(mapping: Column | str, *prefixes: str) -> Column:
    """The entries whose key begins with one of the prefixes in any case, in order: the one scan before several lookups."""
    mapping = F.col(mapping) if isinstance(mapping, str) else mapping
    pattern = "^(?:" + "|".join(p.lower() for p in prefixes) + ")"
    return F.coalesce(F.filter(F.map_entries(mapping), lambda e: F.lower(e["key"]).rlike(pattern)), F.array().cast("array<struct<key:string,value:string>>"))


def header(key: str, kind: str = "string") -> Column:
    """Typed access to the envelope's ``headers``."""
    return typed_value("headers", key, kind)


def field(key: str, kind: str = "string") -> Column:
    """Typed access to the envelope's ``fields``."""
    return typed_value("fields", key, kind)


def sorted_pairs(mapping: Column, pair, delimiter: str) -> Column:
    """Join a map's entries, sorted by key, with ``pair(key, value)`` for each."""
    entries = F.sort_array(F.map_entries(mapping))
    return F.array_join(F.transform(entries, lambda e: pair(e["key"], e["value"])), delimiter)
