"""Elements as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.properties import as_text_lists


def json_column(elements: DataFrame) -> Column:
    """One JSON object per row; properties become ``[key, type, value]`` lists."""
    fields = [
        as_text_lists(F.col(name)).alias(name) if name == "properties" else F.col(name)
        for name in elements.columns
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_json_rows(elements: DataFrame) -> DataFrame:
    return elements.select("id", json_column(elements).alias("json"))


def write_json(elements: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per line, by all tasks in parallel."""
    elements.select(json_column(elements).alias("value")).write.mode(mode).text(path)
