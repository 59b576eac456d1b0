"""Vertex degrees.

Every edge row counts, parallel edges and self-loops included, and so do edges
whose endpoint is not a vertex.  ``count`` is combined map-side, so a hub costs
one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_degrees(edges: DataFrame) -> DataFrame:
    return _degrees(edges, "dst")


def out_degrees(edges: DataFrame) -> DataFrame:
    return _degrees(edges, "src")


def fill_zero(vertices: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row per vertex, with 0 for those that ``degrees`` lacks."""
    return (
        vertices.select("id")
        .join(degrees, "id", "left")
        .na.fill(0, ["degree"])
        .select("id", "degree")
    )


def _degrees(edges: DataFrame, endpoint: str) -> DataFrame:
    return edges.groupBy(F.col(endpoint).alias("id")).agg(
        F.count(F.lit(1)).alias("degree")
    )
