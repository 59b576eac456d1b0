"""Row filters and projections of element tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import properties as P


def of_datasource(elements: DataFrame, datasource: str) -> DataFrame:
    return elements.where(F.col("datasource") == datasource)


def exclude_labels(elements: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    """Elements whose label is not listed; an element without a label is kept.

    Written as ``IS NULL OR NOT IN`` and not with ``coalesce`` so that it is
    pushed into the parquet scan.
    """
    if not labels:
        return elements
    label = F.col("label")
    return elements.where(label.isNull() | ~label.isin(list(labels)))


def with_property(elements: DataFrame, key: str, value: str) -> DataFrame:
    """Elements that hold a property with this key and value."""
    return elements.where(P.has_property(F.col("properties"), key, value))


def flatten_properties(elements: DataFrame) -> DataFrame:
    """Long form: one row ``(id, key, type, value)`` per property."""
    return elements.select("id", F.explode("properties").alias("p")).select(
        "id", "p.key", "p.type", "p.value"
    )


def lift_properties(elements: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed columns, one per ``{property key: type tag}``, next to ``id``."""
    return elements.select(
        "id",
        *(
            P.typed_property(F.col("properties"), key, tag).alias(key)
            for key, tag in columns.items()
        ),
    )


class TooManyKeysError(ValueError):
    """The elements hold more property keys than a table should have columns."""


def wide_table(elements: DataFrame, max_columns: int = 500) -> DataFrame:
    """Typed columns for all property keys, whatever they are, next to ``id``.

    One job finds the keys and the commonest type of each; the table itself is a
    projection, without the shuffle that a pivot of the long form would take.
    More than ``max_columns`` keys raise :class:`TooManyKeysError`, also keys that
    differ in upper and lower case only, or are called ``id``, have no column of their
    own and raise ``ValueError``.
    """
    from vertexloom.operators.reports import dominant_types

    found = dominant_types(elements).where("key IS NOT NULL").orderBy("key").limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise TooManyKeysError(f"more than {max_columns} property keys")
    names = [row["key"].lower() for row in found]
    if len(set(names)) < len(names) or "id" in names:
        raise ValueError("property keys that cannot be columns side by side")
    return lift_properties(elements, {row["key"]: row["type"] for row in found})


def map_form(elements: DataFrame) -> DataFrame:
    """Elements with their properties as a map from key to type and value."""
    return elements.withColumn("properties", P.as_map(F.col("properties")))


def list_form(elements: DataFrame) -> DataFrame:
    """Elements with the property lists of maps made by :func:`map_form`."""
    return elements.withColumn("properties", P.from_map(F.col("properties")))


def header(elements: DataFrame) -> DataFrame:
    """Elements without their properties."""
    return elements.select("datasource", "id", "label")
