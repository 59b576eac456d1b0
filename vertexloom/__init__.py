"""Property-graph analytics expressed as Spark DataFrame jobs."""

from vertexloom.graph import EmptyGraphError, PropertyGraph
from vertexloom.schema import EDGE_SCHEMA, VERTEX_SCHEMA, element_schema

__all__ = [
    "EDGE_SCHEMA",
    "EmptyGraphError",
    "PropertyGraph",
    "VERTEX_SCHEMA",
    "element_schema",
]
