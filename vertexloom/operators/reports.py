"""Counting reports over element tables.

Every report is a partial aggregation followed by one shuffle of group keys,
so a label or key that holds most of the rows does not load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.filters import flatten_properties


def label_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


def count_where(elements: DataFrame, condition: Column | str) -> DataFrame:
    return elements.where(condition).agg(F.count(F.lit(1)).alias("cnt"))


def graph_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(V, E)``; both tables are counted in one aggregation."""
    tagged = vertices.select(F.lit(True).alias("is_vertex")).unionByName(
        edges.select(F.lit(False).alias("is_vertex"))
    )
    return tagged.agg(
        F.count_if("is_vertex").alias("V"),
        F.count_if(~F.col("is_vertex")).alias("E"),
    )


def property_catalogue(elements: DataFrame) -> DataFrame:
    """Number of properties per ``(key, type)``."""
    return (
        flatten_properties(elements)
        .groupBy("key", "type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def dominant_types(elements: DataFrame) -> DataFrame:
    """Most frequent type of each key; equal counts go to the smaller name."""
    rank = F.struct((-F.col("cnt")).alias("order"), F.col("type"))
    return (
        property_catalogue(elements)
        .groupBy("key")
        .agg(F.min(rank).getField("type").alias("type"))
    )


def summary(vertices: DataFrame, edges: DataFrame, edge_label: str) -> DataFrame:
    """Label counts, the count of one edge label and all out-degrees in long form.

    Edges are counted by label and by source in one pass over them.
    """
    # The label asked for has a row with the count 0 even if no edge carries it.
    asked = edges.sparkSession.range(1).select(
        F.lit(edge_label).alias("label"), F.lit(None).cast("string").alias("src"), F.lit(0).alias("n")
    )
    counted = edges.select("label", "src", F.lit(1).alias("n")).unionByName(asked)
    counted = counted.groupingSets([["label"], ["src"]], "label", "src").agg(
        F.grouping("src").cast("boolean").alias("by_label"), F.sum("n").alias("cnt")
    )

    def entry(name: str, key: Column, wanted: Column) -> Column:
        row = F.struct(F.lit(name).alias("section"), key.alias("key"), F.col("cnt").alias("value"))
        return F.when(wanted, row)

    label, found = F.col("label"), F.col("cnt") > 0
    of_edges = counted.select(
        F.explode(
            F.array_compact(
                F.array(
                    entry("edge_label", label, F.col("by_label") & found),
                    entry("edge_count", label, F.col("by_label") & label.eqNullSafe(edge_label)),
                    entry("out_degree", F.col("src"), ~F.col("by_label") & found),
                )
            )
        ).alias("e")
    ).select("e.*")
    of_vertices = label_counts(vertices).select(
        F.lit("vertex_label").alias("section"), label.alias("key"), F.col("cnt").alias("value")
    )
    return of_vertices.unionByName(of_edges)
