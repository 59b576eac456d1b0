"""Catalog tables and views over elements."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

OPEN_FILES = 8


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    path: str | None = None,
    partitions: Sequence[str] = (),
    comment: str | None = None,
) -> None:
    """Create an empty parquet table; with ``path`` an external one.

    A column's comment is taken from ``comment`` in its field's metadata.
    """
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        + (f" COMMENT {_quoted(f.metadata['comment'])}" if "comment" in f.metadata else "")
        for f in schema.fields
    )
    statement = f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
    if partitions:
        keys = ", ".join(f"`{p}`" for p in partitions)
        statement += f" PARTITIONED BY ({keys})"
    if path is not None:
        statement += f" LOCATION {_quoted(path)}"
    if comment is not None:
        statement += f" COMMENT {_quoted(comment)}"
    spark.sql(statement)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def save_as_table(
    elements: DataFrame,
    name: str,
    path: str | None = None,
    partitions: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Create a parquet table from a query.

    A task writes up to ``OPEN_FILES`` partitions side by side, which spares it sorting
    its rows by partition in memory; beyond that Spark sorts them.
    """
    writer = elements.write.mode(mode).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if partitions:
        writer = writer.partitionBy(*partitions)
    with _setting(elements.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
        writer.saveAsTable(name)


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def publish_view(elements: DataFrame, name: str, everywhere: bool = False) -> None:
    """Session view, or one all sessions see under ``global_temp``."""
    if everywhere:
        elements.createOrReplaceGlobalTempView(name)
    else:
        elements.createOrReplaceTempView(name)


def drop_view(spark: SparkSession, name: str, everywhere: bool = False) -> bool:
    if everywhere:
        return spark.catalog.dropGlobalTempView(name)
    return spark.catalog.dropTempView(name)


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql("SHOW TABLES" + (f" IN {database}" if database else ""))


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {name}")
