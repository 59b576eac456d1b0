"""Attach results to elements as properties, and remove properties."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import properties as P
from vertexloom.functions.types import tag_of_type


def drop_keys(elements: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Remove all properties under ``keys``: a narrow projection, no shuffle.

    An element left without properties keeps an empty list.
    """
    keys = list(keys)
    if not keys:
        return elements
    return elements.withColumn("properties", P.without_keys(F.col("properties"), keys))


def set_property(
    elements: DataFrame,
    values: DataFrame,
    key: str,
    value_column: str,
    tag: str | None = None,
) -> DataFrame:
    """Give each element with a row in ``values`` the property ``key``.

    ``values`` has at most one row per ``id``.  Earlier values of the key are
    removed everywhere, so elements without a row end up without the property
    and running twice equals running once.  Other properties keep their order
    and the new one comes last.  Both sides of the single join have unique
    ids, so no key can be hot.
    """
    tag = tag or tag_of_type(values.schema[value_column].dataType)
    found = values.select("id", F.col(value_column).alias("__value"))
    kept = P.without_keys(F.col("properties"), [key])
    new = P.make_property(key, tag, F.col("__value"))
    return (
        elements.join(found, "id", "left")
        .withColumn(
            "properties",
            F.when(F.col("__value").isNull(), kept).otherwise(P.append(kept, new)),
        )
        .select(*elements.columns)
    )


def replace_properties(elements: DataFrame, lists: DataFrame) -> DataFrame:
    """Swap in the lists of ``lists(id, properties)``; others become empty."""
    found = lists.select("id", F.col("properties").alias("__list"))
    return (
        elements.join(found, "id", "left")
        .withColumn("properties", P.or_empty(F.col("__list")))
        .select(*elements.columns)
    )


def append_properties(elements: DataFrame, additions: DataFrame) -> DataFrame:
    """Append the long-form properties ``additions(id, key, type, value)``.

    The additions of one element are gathered in a list, which the data model
    already bounds to one stored row.
    """
    entry = F.struct("key", "type", "value")
    lists = additions.groupBy("id").agg(
        F.sort_array(F.collect_list(entry)).alias("__added")
    )
    return (
        elements.join(lists, "id", "left")
        .withColumn(
            "properties",
            F.when(
                F.col("__added").isNull(), P.or_empty(F.col("properties"))
            ).otherwise(F.concat(P.or_empty(F.col("properties")), F.col("__added"))),
        )
        .select(*elements.columns)
    )
