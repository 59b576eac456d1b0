"""Intermediate tables that cut the lineage of iterative jobs.

States are written as parquet below ``spark.checkpoint.dir``, the folder shared
by all executors, so losing an executor never loses a finished round.  Unlike a
checkpointed RDD a table is columnar, is read with column pruning, has exact
size statistics and can be dropped as soon as the next round replaces it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``, else from the context's checkpoint
    directory.  Only a local session, whose executors share this machine, falls
    back to a new temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    local = re.match(r"local(\[|$)", spark.sparkContext.master)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not local:
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder shared by all executors"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vertexloom-"))
    return context.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lives on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that begin meanwhile delete their shuffle files when they end.

    Else these stay until the driver happens to collect its garbage, and the rounds of a
    loop add up on disk.  A cached table that lost a block reads its own shuffles, which
    stay, and a stage that misses files is run again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables of one computation, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/vertexloom-{uuid.uuid4().hex}"
        self._paths: list[str] = []
        self._tables: dict[str, str] = {}  # catalog tables by path

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return the DataFrame that reads it back."""
        path = f"{self.root}/{len(self._paths):04d}-{name}"
        self._paths.append(path)
        with shuffles_dropped(self.spark):
            df.write.parquet(path, compression=codec)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, int]:
        """Write ``df`` as a catalog table bucketed by ``key``; with the number of rows.
        Joins and aggregations by the key start from it without a shuffle.  Rows are not
        sorted: a sort by bucket and key costs more than what a loop sorts once."""
        table, seen = self.save_dealt(df.repartition(buckets, key), name, key, buckets, n=F.count(F.lit(1)))
        return table, seen["n"]

    def save_dealt(self, df: DataFrame, name: str, key: str, buckets: int, **aggregates: Column) -> tuple[DataFrame, dict]:
        """Like :meth:`save_bucketed` for rows that lie in partitions by the key already, with
        aggregates that the write observes."""
        path = f"{self.root}/{len(self._paths):04d}-{name}"
        self._paths.append(path)
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self._tables[path] = table
        seen = Observation()
        if aggregates:
            df = df.observe(seen, *(column.alias(key) for key, column in aggregates.items()))
        with shuffles_dropped(self.spark):
            df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
        found = self.spark.table(table)
        found._scratch_path = path
        return found, seen.get if aggregates else {}

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Like :meth:`save`, with the number of rows, which the write itself observes."""
        table, seen = self.save_observed(df, name, n=F.count(F.lit(1)))
        return table, seen["n"]

    def save_observed(
        self, df: DataFrame, name: str, codec: str = "snappy", **aggregates: Column
    ) -> tuple[DataFrame, dict]:
        """Like :meth:`save`, with aggregates over the rows, which the write itself observes."""
        seen = Observation()
        table = self.save(df.observe(seen, *(column.alias(key) for key, column in aggregates.items())), name, codec)
        return table, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables made by :meth:`save`; nothing may read them any more."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path is not None:
                self._forget(path)
                delete_path(self.spark, path)

    def clear(self) -> None:
        """Delete all tables, the ones behind returned results included."""
        for path in list(self._tables):
            self._forget(path)
        delete_path(self.spark, self.root)

    def _forget(self, path: str) -> None:
        table = self._tables.pop(path, None)
        if table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
