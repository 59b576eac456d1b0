"""The six-vertex sample graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from vertexloom.graph import PropertyGraph
from vertexloom.schema import PROPERTIES_TYPE

DATASOURCE = "modern"

# The sample tables have no timestamp, and edges name their endpoints before
# their properties.
_HEAD = [StructField(name, StringType()) for name in ("datasource", "id", "label")]
_ENDS = [StructField(name, StringType()) for name in ("src", "dst")]
_PROPERTIES = StructField("properties", PROPERTIES_TYPE)
SAMPLE_VERTEX_SCHEMA = StructType(_HEAD + [_PROPERTIES])
SAMPLE_EDGE_SCHEMA = StructType(_HEAD + _ENDS + [_PROPERTIES])

_TEXT, _INTEGER, _FLOAT = "java.lang.String", "java.lang.Integer", "java.lang.Float"

# The sample data.
_VERTICES = [
    (1, "person", [("name", _TEXT, "marko"), ("age", _INTEGER, "29"), ("country", _TEXT, "USA")]),
    (2, "person", [("name", _TEXT, "vadas"), ("age", _INTEGER, "27"), ("country", _TEXT, "USA")]),
    (3, "software", [("name", _TEXT, "lop"), ("lang", _TEXT, "java")]),
    (4, "person", [("name", _TEXT, "josh"), ("age", _INTEGER, "32"), ("country", _TEXT, "France")]),
    (5, "software", [("name", _TEXT, "ripple"), ("lang", _TEXT, "C++")]),
    (6, "person", [("name", _TEXT, "peter"), ("age", _INTEGER, "29"), ("country", _TEXT, "Germany")]),
]
_EDGES = [
    (7, "knows", 1, 2, [("weight", _FLOAT, "0.5")]),
    (8, "knows", 1, 4, [("weight", _FLOAT, "1.0")]),
    (9, "created", 1, 3, [("weight", _FLOAT, "0.6")]),
    (10, "created", 4, 5, [("weight", _FLOAT, "0.7")]),
    (11, "created", 4, 3, [("weight", _FLOAT, "0.2")]),
    (12, "created", 6, 3, [("weight", _FLOAT, "0.3")]),
]


def sample_graph(spark: SparkSession, **options) -> PropertyGraph:
    def name(number: int) -> str:
        return f"{DATASOURCE}_{number}"

    vertices = [
        (DATASOURCE, name(number), label, properties)
        for number, label, properties in _VERTICES
    ]
    edges = [
        (DATASOURCE, name(number), label, name(src), name(dst), properties)
        for number, label, src, dst, properties in _EDGES
    ]
    return PropertyGraph(
        spark.createDataFrame(vertices, SAMPLE_VERTEX_SCHEMA),
        spark.createDataFrame(edges, SAMPLE_EDGE_SCHEMA),
        **options,
    )
