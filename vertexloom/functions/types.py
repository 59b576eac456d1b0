"""Type tags of property values and the Spark types they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The tag stored with a property -> the Spark type of its value.
TAG_TYPES = {
    "java.lang.String": "string",
    "java.lang.Long": "bigint",
    "java.lang.Double": "double",
    "java.lang.Float": "float",
    "java.lang.Integer": "int",
    "java.lang.Short": "smallint",
    "java.lang.Boolean": "boolean",
    "java.lang.Byte": "tinyint",
    "java.sql.Timestamp": "timestamp",
    "java.sql.Date": "date",
}
STRING_TAG = "java.lang.String"
LONG_TAG = "java.lang.Long"
DOUBLE_TAG = "java.lang.Double"

_TYPE_TAGS = {ddl: tag for tag, ddl in TAG_TYPES.items()}
_TYPE_TAGS["timestamp_ntz"] = "java.sql.Timestamp"


def type_of_tag(tag: str) -> str:
    """Spark type (DDL) of a tag; an unknown tag is read as a string."""
    return TAG_TYPES.get(tag, "string")


def tag_of_type(data_type: DataType) -> str:
    """Tag under which values of a Spark type are stored.

    There is none for decimals, nested types and binaries: they are strings.
    """
    return _TYPE_TAGS.get(data_type.simpleString(), STRING_TAG)


def parse_value(value: Column, tag: str) -> Column:
    """Typed value of a property text; NULL where the text does not parse."""
    return value.try_cast(type_of_tag(tag))


def parse_tagged(value: Column, type_tag: Column, tag: str) -> Column:
    """Typed value where the row carries ``tag``, NULL elsewhere.

    A column has one static type, so a mixed property column is read as one
    such column per tag of interest.
    """
    return F.when(type_tag == tag, parse_value(value, tag))


def parse_timestamp(text: Column) -> Column:
    """Element timestamp (stored as text) as a timestamp, NULL if malformed."""
    return F.try_to_timestamp(text)
