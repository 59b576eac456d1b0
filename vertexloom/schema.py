"""Schemas of the property-graph tables.

Properties stay an array of structs rather than a map: nothing makes the keys
of one element unique, and ``map_from_entries`` raises on duplicates.  Fields
are nullable because stored data may lack a label or a property list; the
operators treat a missing list as an empty one.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Field names and their order in the stored tables.
PROPERTY_SCHEMA = StructType(
    [
        StructField("key", StringType()),
        StructField("type", StringType()),
        StructField("value", StringType()),
    ]
)
PROPERTIES_TYPE = ArrayType(PROPERTY_SCHEMA)

VERTEX_SCHEMA = StructType(
    [
        StructField("timestamp", StringType()),
        StructField("datasource", StringType()),
        StructField("id", StringType()),
        StructField("label", StringType()),
        StructField("properties", PROPERTIES_TYPE),
    ]
)
EDGE_SCHEMA = StructType(
    VERTEX_SCHEMA.fields
    + [StructField("src", StringType()), StructField("dst", StringType())]
)

KINDS = {"v": VERTEX_SCHEMA, "e": EDGE_SCHEMA}


def element_schema(kind: str) -> StructType:
    """Schema of an element kind: ``v`` for vertices, ``e`` for edges (any case)."""
    schema = KINDS.get(kind.lower()) if isinstance(kind, str) else None
    if schema is None:
        raise ValueError(f"unknown element kind {kind!r}: expected 'v' or 'e'")
    return schema
