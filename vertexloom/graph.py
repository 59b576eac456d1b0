"""The property graph: two DataFrames and the operators on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from vertexloom.functions.properties import result_key
from vertexloom.operators import degrees, reports
from vertexloom.operators.components import connected_components
from vertexloom.operators.filters import exclude_labels
from vertexloom.operators.index import IndexedGraph, index_graph
from vertexloom.operators.pagerank import pagerank
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import HOT_ROWS, find_hot_of, lookup_join
from vertexloom.operators.strong_components import strongly_connected_components
from vertexloom.operators.writeback import set_property


class EmptyGraphError(ValueError):
    """An analytic operator was asked for on a graph without vertices."""


@dataclass(frozen=True)
class PropertyGraph:
    """Vertices and edges as DataFrames.

    Degrees and reports are lazy.  PageRank and the component operators run
    their rounds when called and return a DataFrame over the saved result; the
    tables behind it live until :meth:`release`.  ``hot_rows`` is the number of
    rows per key above which joins split a key over several tasks.
    """

    vertices: DataFrame
    edges: DataFrame
    hot_rows: int = HOT_ROWS

    # -- restricting ------------------------------------------------------

    def exclude(
        self,
        vertex_labels: Sequence[str] | None = None,
        edge_labels: Sequence[str] | None = None,
    ) -> PropertyGraph:
        """Leave out labels.  Edges of excluded vertices stay, see ``drop_dangling``."""
        return replace(
            self,
            vertices=exclude_labels(self.vertices, vertex_labels),
            edges=exclude_labels(self.edges, edge_labels),
        )

    def drop_dangling(self) -> PropertyGraph:
        """Keep only edges whose two endpoints are vertices.

        The edges are saved once, which counts them; hot ends of either side are found
        in one pass over the saved table.  ``release`` of the new graph deletes it.
        """
        scratch = Scratch(self.vertices.sparkSession)
        edges, n_edges = scratch.save_counted(self.edges, "all-edges")
        ids = self.vertices.select("id").distinct().withColumnRenamed("id", "end")
        hot = find_hot_of(edges, ["src", "dst"], n_edges, self.hot_rows)
        kept = edges
        for endpoint, spread_by in (("src", "dst"), ("dst", "src")):
            kept = lookup_join(kept, endpoint, ids, "end", hot[endpoint], spread_by, "left_semi")
        graph = replace(self, edges=kept.select(*self.edges.columns))
        graph.__dict__["_scratch"] = scratch
        return graph

    # -- reports ----------------------------------------------------------

    def count(self) -> DataFrame:
        return reports.graph_count(self.vertices, self.edges)

    def summary(self, edge_label: str = "knows") -> DataFrame:
        return reports.summary(self.vertices, self.edges, edge_label)

    # -- analytics --------------------------------------------------------

    def in_degree(self, fill_zero: bool = False) -> DataFrame:
        """``(id, degree)``; vertices without in-edges only with ``fill_zero``."""
        found = degrees.in_degrees(self.edges)
        return degrees.fill_zero(self.vertices, found) if fill_zero else found

    def out_degree(self, fill_zero: bool = False) -> DataFrame:
        """``(id, degree)``; vertices without out-edges only with ``fill_zero``."""
        found = degrees.out_degrees(self.edges)
        return degrees.fill_zero(self.vertices, found) if fill_zero else found

    def pagerank(
        self,
        reset: float = 0.15,
        max_iter: int | None = None,
        tol: float | None = None,
        push: bool = False,
    ) -> DataFrame:
        """``(id, rank)`` after ``max_iter`` rounds (default 10) or up to ``tol``.

        With ``push`` only vertices that move by more than ``tol`` send.
        """
        return pagerank(
            self._indexed(), self._scratch, self.hot_rows, reset, max_iter, tol, push
        )

    def connected_components(self) -> DataFrame:
        """``(id, component)``; a component is named by its smallest vertex id."""
        return connected_components(self._indexed(), self._scratch, self.hot_rows)

    def strongly_connected_components(self) -> DataFrame:
        """``(id, component)``; a component is named by its smallest vertex id."""
        return strongly_connected_components(
            self._indexed(), self._scratch, self.hot_rows
        )

    def run(self, operator: str, **params) -> tuple[DataFrame, str]:
        """Result table of an operator by name, and the name of its value column."""
        if operator not in OPERATORS:
            raise ValueError(
                f"unknown operator {operator!r}: expected one of {sorted(OPERATORS)}"
            )
        method, column = OPERATORS[operator]
        return getattr(self, method)(**params), column

    def with_result(self, operator: str, **params) -> DataFrame:
        """Vertices with the operator's result as their reserved property."""
        values, column = self.run(operator, **params)
        return set_property(self.vertices, values, result_key(operator), column)

    def release(self) -> None:
        """Delete the tables behind the results computed on this graph."""
        if "_scratch" in self.__dict__:
            self._scratch.clear()
            self.__dict__.pop("_index", None)
            self.__dict__.pop("_scratch", None)

    @cached_property
    def _scratch(self) -> Scratch:
        return Scratch(self.vertices.sparkSession)

    @cached_property
    def _index(self) -> IndexedGraph:
        return index_graph(self.vertices, self.edges, self._scratch, self.hot_rows)

    def _indexed(self) -> IndexedGraph:
        if self._index.n_vertices == 0:
            raise EmptyGraphError("the graph has no vertices")
        return self._index


# Operator names as used in reserved property keys.
OPERATORS = {
    "indegree": ("in_degree", "degree"),
    "outdegree": ("out_degree", "degree"),
    "pagerank": ("pagerank", "rank"),
    "component": ("connected_components", "component"),
    "scomponent": ("strongly_connected_components", "component"),
}
