"""Joins that survive hot keys.

The loops join long tables (edges) with tables that have one row per key
(vertex states).  A hub may own a third of all edges, and hash partitioning
would send all of them to one task.  Keys above ``hot_rows`` rows are therefore
split into slices: the long side takes its slice from a hash of a second
column, the keyed side is copied once per slice.  Results are the same rows.

Every key above ``hot_rows`` is split, in as many slices as it takes.  The list of
hot keys is counted first: up to ``LISTED_KEYS`` it is collected and broadcast;
a longer one stays a distributed table and is joined by a shuffle, which adaptive
execution splits where a key is large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 10_000_000
MIN_ROWS_PER_PARTITION = 10_000
HOT_ROWS = ROWS_PER_PARTITION  # a key beyond this would fill a partition alone
LISTED_KEYS = 100_000  # hot keys that may be broadcast, 16 bytes each
KEY_GROUPS = 1 << 16  # hash groups that are counted before keys are
SUSPECTS = 10_000  # groups that a filter may list
HASHED_KEYS = 2_000_000  # keys from which a table is not left to a broadcast or a sort
KEYS_PER_TASK = 1_000_000  # keys of a table that one task may hold in memory for a join
SLICE = "__slice"


def hottest(counts: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """Hot keys of ``counts(key, n)`` as ``(hot_key, slices)``; None if there are none."""
    rows = counts.where(F.col("n") > hot_rows).select(
        F.col(key).alias("hot_key"),
        F.ceil(F.col("n") / hot_rows).cast("int").alias("slices"),
    )
    found = rows.limit(LISTED_KEYS + 1).collect()  # only to learn whether all fit
    if not found:
        return None
    if len(found) > LISTED_KEYS:
        return rows
    listed = counts.sparkSession.createDataFrame(found, rows.schema)
    listed._listed = True
    return listed


def _offered(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if getattr(hot, "_listed", False) else hot


def find_hot(rows: DataFrame, key: str, n_rows: int, hot_rows: int) -> DataFrame | None:
    """Hot values of ``key``; needs no job when the whole table is small enough."""
    return find_hot_of(rows, [key], n_rows, hot_rows)[key]


def find_hot_of(rows: DataFrame, keys: list[str], n_rows: int, hot_rows: int) -> dict[str, DataFrame | None]:
    """Hot values of several keys of one type, all counted in one pass.

    Rows are counted by hash groups of their keys first, which moves a few numbers per
    task.  A hot key makes its group hot, so keys are counted in hot groups only, and
    mostly there are none.
    """
    if n_rows <= hot_rows:
        return dict.fromkeys(keys)
    groups = [_key_group(k, i) for i, k in enumerate(keys)]
    counted = rows.select(F.explode(F.array(*groups)).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    found = [row["part"] for row in counted.where(F.col("n") > hot_rows).collect()]
    if not found:
        return dict.fromkeys(keys)
    sides = [F.struct(F.lit(k).alias("side"), group.alias("part"), F.col(k).alias("key")) for k, group in zip(keys, groups)]
    ends = rows.select(F.explode(F.array(*sides)).alias("k")).select("k.*")
    if len(found) <= SUSPECTS:
        ends = ends.where(F.col("part").isin(found))
    counts = ends.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > hot_rows).persist()
    try:
        return {k: hottest(counts.where(F.col("side") == k), "key", hot_rows) for k in keys}
    finally:
        counts.unpersist()


def _key_group(key: str, side: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).cast("int") + side * KEY_GROUPS


def slice_rows(
    rows: DataFrame, key: str, hot: DataFrame | None, spread_by: str
) -> DataFrame:
    """Long side: add the slice of each row, 0 for keys that are not hot."""
    if hot is None:
        return rows
    chosen = F.pmod(F.xxhash64(F.col(spread_by)), F.col("slices")).cast("int")
    return (
        rows.join(_offered(hot), F.col(key) == F.col("hot_key"), "left")
        .withColumn(SLICE, F.coalesce(chosen, F.lit(0)))
        .drop("hot_key", "slices")
    )


def slice_table(table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Keyed side: one copy of each row per slice of its key."""
    if hot is None:
        return table
    last = F.coalesce(F.col("slices"), F.lit(1)) - 1
    return (
        table.join(_offered(hot), F.col(key) == F.col("hot_key"), "left")
        .withColumn(SLICE, F.explode(F.sequence(F.lit(0), last)))
        .drop("hot_key", "slices")
    )


def lookup_join(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    hot: DataFrame | None,
    spread_by: str,
    how: str = "inner",
    n_keys: int | None = None,
) -> DataFrame:
    """Join ``rows.key`` with the unique ``table.table_key``, slicing hot keys.

    ``table_key`` must not be a column of ``rows`` and is not in the result.  Of a table
    of up to ``n_keys`` rows each task holds its share in memory, where the table is long
    and a share is not, and neither side is sorted.
    """
    table = table.withColumnRenamed(table_key, "__key")
    condition = F.col(key) == F.col("__key")
    if hot is not None:
        rows = slice_rows(rows, key, hot, spread_by)
        table = slice_table(table, "__key", hot).withColumnRenamed(SLICE, "__copy")
        condition &= F.col(SLICE) == F.col("__copy")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_keys is not None and HASHED_KEYS <= n_keys <= KEYS_PER_TASK * partitions:
        table = table.hint("shuffle_hash")
    return rows.join(table, condition, how).drop("__key", SLICE, "__copy")


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles planned meanwhile have ``n`` partitions.

    A round aggregates its states by the key that they join the long table on
    next.  With as many partitions as that table has, one shuffle serves both.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions_for(spark: SparkSession, n_rows: int, most: int | None = None) -> int:
    """Partitions of a long table: the session's setting, less if a round of a small
    table would be all scheduling, and more if partitions would grow beyond ``most`` rows."""
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(
        min(setting, math.ceil(n_rows / MIN_ROWS_PER_PARTITION)),
        math.ceil(n_rows / (most or ROWS_PER_PARTITION)),
        2,  # a single partition would not count as hash-partitioned
    )


@dataclass(frozen=True)
class RoundTable:
    """A long table that every round of a loop joins with new states.

    It is sliced, hash-partitioned and sorted by its key once and persisted in
    that form; states are brought to the same partitioning, so a round moves and
    sorts the states only.  Use it within :func:`shuffle_partitions`.
    """

    rows: DataFrame
    keys: list[str]
    hot: DataFrame | None
    partitions: int

    @classmethod
    def of(
        cls, sliced: DataFrame, key: str, hot: DataFrame | None, partitions: int, dealt: bool = False
    ) -> RoundTable:
        """From rows that went through :func:`slice_rows` with the same ``hot``.

        ``dealt`` rows lie in as many partitions by the table's keys already.
        """
        keys = [key] if hot is None else [key, SLICE]
        rows = sliced if dealt else sliced.repartition(partitions, *keys)
        return cls(rows.sortWithinPartitions(*keys).persist(), keys, hot, partitions)

    def join(self, states: DataFrame, how: str = "inner") -> DataFrame:
        """Join with states that have one row per key, under the key's name.

        Rounds with few states go through :func:`frontier.meet_few` instead.
        """
        states = slice_table(states, self.keys[0], self.hot).hint("merge")
        return self.rows.join(states, self.keys, how)

    def release(self) -> None:
        self.rows.unpersist()
