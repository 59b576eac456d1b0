"""Property values as variants: one column whose rows have types of their own.

A column has one static type, so values of mixed tags were texts, or one typed column
per tag.  A variant carries the type with the value and needs neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.types import STRING_TAG, TAG_TYPES, parse_value


def tagged_variant(value: Column, type_tag: Column) -> Column:
    """The value in the type its tag names; NULL where the text does not parse as it.

    An unknown tag, or none, means a string, as everywhere.
    """
    typed = [tag for tag in TAG_TYPES if tag != STRING_TAG]
    found = F.when(type_tag == typed[0], parse_value(value, typed[0]).cast("variant"))
    for tag in typed[1:]:
        found = found.when(type_tag == tag, parse_value(value, tag).cast("variant"))
    return found.otherwise(value.cast("variant"))


def json_variant(text: Column) -> Column:
    """The value a text stands for as JSON: number, boolean, string, list or object.

    NULL where the text is no JSON.
    """
    return F.try_parse_json(text)


def variant_kind(variant: Column) -> Column:
    """Name of the type a variant carries, such as BIGINT or DATE; NULL for NULL."""
    return F.schema_of_variant(variant)


def variant_as(variant: Column, type_name: str, path: str = "$") -> Column:
    """The variant, or a part of it, in a static type; NULL where it does not fit."""
    return F.try_variant_get(variant, path, type_name)


def variant_properties(elements: DataFrame) -> DataFrame:
    """Long form ``(id, key, variant)``: one row per property, typed by its tag."""
    flat = elements.select("id", F.explode("properties").alias("p"))
    return flat.select("id", "p.key", tagged_variant(F.col("p.value"), F.col("p.type")).alias("variant"))
