"""Label selectors as boolean columns, and ordered lists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

_KEY = r"(?:[A-Za-z0-9](?:[-A-Za-z0-9.]*[A-Za-z0-9])?/)?[A-Za-z0-9](?:[-A-Za-z0-9_.]{0,61}[A-Za-z0-9])?"
_VALUE = r"(?:[A-Za-z0-9](?:[-A-Za-z0-9_.]{0,61}[A-Za-z0-9])?)?"


def _value_of(labels: Column, key: str) -> Column:
    return F.try_element_at(labels, F.lit(key))


def _equals(labels, key, value):
    return F.coalesce(_value_of(labels, key) == value, F.lit(False))


def _within(labels, key, values):
    return F.coalesce(_value_of(labels, key).isin(values), F.lit(False))


def selector(text: str) -> Callable[[Column], Column]:
    """Turn a label selector into a function of a label map.

    Requirements are split by commas and must all hold: ``k=v``, ``k==v``, ``k!=v``, ``k in (a,b)``,
    ``k notin (a,b)``, ``k``, ``!k``.  An absent key satisfies ``!=`` and ``notin``.  The empty
    selector matches everything.  Raises on a text that is none of these.
    """
    requirements = []
    for part in re.split(r",(?![^(]*\))", text) if text.strip() else []:
        part = part.strip()
        if m := re.fullmatch(rf"({_KEY})\s*(=|==|!=)\s*({_VALUE})", part):
            requirements.append((m[2].replace("==", "="), m[1], m[3]))
        elif m := re.fullmatch(rf"({_KEY})\s+(in|notin)\s*\(([^()]*)\)", part):
            values = [v.strip() for v in m[3].split(",")]
            if not all(re.fullmatch(_VALUE, v) for v in values):
                raise ValueError(f"bad label selector: {text!r}")
            requirements.append((m[2], m[1], values))
        elif m := re.fullmatch(rf"(!?)\s*({_KEY})", part):
            requirements.append((m[1] or "exists", m[2], None))
        else:
            raise ValueError(f"bad label selector: {text!r}")

    def matches(labels: Column) -> Column:
        out = F.lit(True)
        for how, key, value in requirements:
            if how in ("=", "!="):
                hit = _equals(labels, key, value)
            elif how in ("in", "notin"):
                hit = _within(labels, key, value)
            else:
                hit = _value_of(labels, key).isNotNull()
            out = out & (~hit if how in ("!=", "notin", "!") else hit)
        return out

    return matches


def dedupe_list(items: Column) -> Column:
    """A list without its later repeats, in order."""
    return F.array_distinct(items)


def list_minus(items: Column, gone: Column) -> Column:
    """The items that are not in `gone`, in order, repeats kept."""
    return F.filter(items, lambda x: ~F.array_contains(gone, x))
