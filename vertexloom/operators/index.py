"""Compact form of a graph for the iterative algorithms.

Ids are strings of any length; the loops shuffle them many times.  One pass
replaces them by 64-bit numbers, drops edges with an endpoint that is not a
vertex, and merges parallel edges into rows with a multiplicity.  The edges are
written bucketed by source, so that loops over them start without a
shuffle, however many analytics share them.  Of a long graph, whose loops lay the edges
out in blocks, they are written as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.dense import DENSE_FROM
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import find_hot_of, lookup_join, partitions_for

UNMERGED_FROM = DENSE_FROM  # edges from which few parallel ones are left as they are
PAIR_GROUPS = 64


@dataclass(frozen=True)
class IndexedGraph:
    vertices: DataFrame  # (v, id)
    edges: DataFrame  # (s, d, m), pairs with their multiplicity, of which few have several rows
    n_vertices: int
    n_edges: int
    partitions: int  # buckets of the edges, by source, or partitions that loops deal them to
    bucketed: bool = True


def index_graph(
    vertices: DataFrame, edges: DataFrame, scratch: Scratch, hot_rows: int
) -> IndexedGraph:
    # Reading the numbers back from a table pins them: a stage that is run again
    # could number the rows differently.
    spark = vertices.sparkSession
    numbered = (
        vertices.select("id")
        .distinct()
        .select(F.monotonically_increasing_id().alias("v"), "id")
    )
    with uncombined(spark):
        numbered, n_vertices = scratch.save_counted(numbered, "vertices")

    pairs, n_pairs, hot = _pairs(edges, scratch, hot_rows)
    tails = numbered.select(F.col("v").alias("s"), F.col("id").alias("tail"))
    heads = numbered.select(F.col("v").alias("d"), F.col("id").alias("head"))
    mapped = lookup_join(pairs, "src", tails, "tail", hot["src"], "dst", n_keys=n_vertices)
    long = n_pairs >= DENSE_FROM
    if long:  # else the shuffles by both ends would lie on disk at once
        tailed = scratch.save(mapped.drop("src"), "tailed", "zstd")
        scratch.drop(pairs)
        mapped = pairs = tailed
    mapped = lookup_join(mapped, "dst", heads, "head", hot["dst"], "s" if long else "src", n_keys=n_vertices)
    mapped = mapped.select("s", "d", "m")
    partitions = partitions_for(spark, n_pairs)
    if long:
        indexed, n_edges = scratch.save_counted(mapped, "edges")
    else:
        indexed, n_edges = scratch.save_bucketed(mapped, "edges", "s", partitions)
    scratch.drop(pairs)
    return IndexedGraph(numbered, indexed, n_vertices, n_edges, partitions, not long)


def _pairs(edges: DataFrame, scratch: Scratch, hot_rows: int) -> tuple[DataFrame, int, dict[str, DataFrame | None]]:
    """Saved ends ``(src, dst, m)`` of the edges, the number of rows and hot ends.

    Parallel edges are merged, except where there are many edges and few are parallel: to
    merge by ids then moves and hashes every row to save few.  Whether few are is told by
    the pairs of one hash group and the lack of hot ends; the algorithms do without.
    """
    ends, seen = scratch.save_observed(edges.select("src", "dst"), "ends", "zstd", n=F.count(F.lit(1)))
    n = seen["n"]
    if n >= UNMERGED_FROM:
        group = ends.where(F.pmod(F.xxhash64("src", "dst"), F.lit(PAIR_GROUPS)) == 0)
        seen = group.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("n"), F.count("m").alias("pairs")).first()
        hot = find_hot_of(ends, ["src", "dst"], n, hot_rows)
        if (seen["n"] or 0) < 1.5 * seen["pairs"] and hot == {"src": None, "dst": None}:
            pairs = ends.withColumn("m", F.lit(1).cast("long"))
            pairs._scratch_path = ends._scratch_path
            return pairs, n, hot
    merged = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    pairs, n_pairs = scratch.save_counted(merged, "pairs")
    scratch.drop(ends)
    return pairs, n_pairs, find_hot_of(pairs, ["src", "dst"], n_pairs, hot_rows)


@contextmanager
def uncombined(spark: SparkSession) -> Iterator[None]:
    """Shuffles planned meanwhile keep all their partitions, of which the numbers of the
    vertices, and so the blocks of ``operators/dense.py``, are made."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
