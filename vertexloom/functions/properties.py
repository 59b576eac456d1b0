"""Expressions over a property list ``array<struct<key,type,value>>``.

All are native higher-order functions: no UDF, no explode and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vertexloom.functions.types import parse_value
from vertexloom.schema import PROPERTIES_TYPE

RESULT_PREFIX = "_$$"  # fixed value: marks properties that hold a computed result


def result_key(operator: str) -> str:
    """Reserved property key of an operator's result."""
    return RESULT_PREFIX + operator


def empty_properties() -> Column:
    return F.array().cast(PROPERTIES_TYPE)


def or_empty(properties: Column) -> Column:
    """The list itself, or an empty list in place of NULL."""
    return F.coalesce(properties, empty_properties())


def make_property(key: str, tag: str, value: Column) -> Column:
    """One property struct; the value is stored as text."""
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(tag).alias("type"),
        value.cast("string").alias("value"),
    )


def property_list(*entries: Column) -> Column:
    """A list of property structs; entries whose value is NULL are left out."""
    if not entries:
        return empty_properties()
    return F.filter(F.array(*entries), lambda p: p["value"].isNotNull()).cast(
        PROPERTIES_TYPE
    )


def without_keys(properties: Column, keys: Iterable[str]) -> Column:
    """The list without every entry under one of ``keys``; order is kept."""
    keys = list(dict.fromkeys(keys))
    if not keys:
        return or_empty(properties)
    return F.filter(
        or_empty(properties),
        lambda p: ~F.coalesce(p["key"].isin(keys), F.lit(False)),
    )


def append(properties: Column, entry: Column) -> Column:
    """The list with one more entry at its end."""
    return F.array_append(or_empty(properties), entry)


def has_property(properties: Column, key: str, value: str) -> Column:
    """Whether some entry has this key and this value text."""
    return F.coalesce(
        F.exists(properties, lambda p: (p["key"] == key) & (p["value"] == value)),
        F.lit(False),
    )


def has_key(properties: Column, key: str) -> Column:
    """Whether some entry has this key."""
    return F.coalesce(F.exists(properties, lambda p: p["key"] == key), F.lit(False))


def typed_property(properties: Column, key: str, tag: str) -> Column:
    """Typed value of the first entry under ``key``; NULL if absent or malformed."""
    first = F.get(F.filter(properties, lambda p: p["key"] == key), F.lit(0))
    return parse_value(first["value"], tag)


def as_text_lists(properties: Column) -> Column:
    """Properties as ``[key, type, value]`` lists, the shape used in JSON output."""
    return F.transform(
        or_empty(properties), lambda p: F.array(p["key"], p["type"], p["value"])
    )


def as_map(properties: Column) -> Column:
    """The list as ``map<key, struct<type, value>>``.

    Of several entries under one key the first counts, as in :func:`typed_property`;
    an entry without a key has no place in a map and is left out.
    """
    properties = or_empty(properties)
    keys = F.transform(properties, lambda p: p["key"])
    first = F.filter(
        properties,
        lambda p, i: p["key"].isNotNull() & (F.array_position(keys, p["key"]) == i + 1),
    )
    return F.map_from_entries(
        F.transform(
            first,
            lambda p: F.struct(p["key"].alias("key"), F.struct(p["type"].alias("type"), p["value"].alias("value")).alias("value")),
        )
    )


def from_map(entries: Column) -> Column:
    """The property list of a map made by :func:`as_map`; an empty one for NULL."""
    found = F.transform(
        F.map_entries(entries),
        lambda e: F.struct(e["key"].alias("key"), e["value"]["type"].alias("type"), e["value"]["value"].alias("value")),
    )
    return or_empty(found.cast(PROPERTIES_TYPE))
