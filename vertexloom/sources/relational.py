"""Property graphs over relational tables.

``vertices_of`` and ``edges_of`` turn any table into elements; ``commerce``,
``trade`` and ``refers`` are graphs over the order and event tables of a data folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.properties import make_property, property_list
from vertexloom.functions.types import tag_of_type
from vertexloom.graph import PropertyGraph
from vertexloom.operators.skew import partitions_for

PAIRS_PER_TASK = 500_000  # rows that one task combines to pairs in memory

# Columns of the tables the two graphs are built from.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint,"
    " l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string,"
    " p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


def element_id(label: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(label + "_"), key.cast("string"))


def _properties(rows: DataFrame, columns: dict[str, str]) -> Column:
    """Property list from ``{property key: column}``, tagged by column type."""
    return property_list(
        *(
            make_property(key, tag_of_type(rows.schema[name].dataType), F.col(name))
            for key, name in columns.items()
        )
    )


def vertices_of(
    rows: DataFrame,
    datasource: str,
    label: str,
    key: str,
    columns: dict[str, str],
    timestamp: Column | None = None,
) -> DataFrame:
    """One vertex ``<label>_<key>`` per row."""
    return rows.select(
        _text_or_null(timestamp),
        F.lit(datasource).alias("datasource"),
        element_id(label, key).alias("id"),
        F.lit(label).alias("label"),
        _properties(rows, columns).alias("properties"),
    )


def edges_of(
    rows: DataFrame,
    datasource: str,
    label: Column | str,
    id: Column,
    src: Column,
    dst: Column,
    columns: dict[str, str],
    timestamp: Column | None = None,
) -> DataFrame:
    """One edge per row; ``label`` is a fixed name or a column."""
    return rows.select(
        _text_or_null(timestamp),
        F.lit(datasource).alias("datasource"),
        id.alias("id"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"),
        _properties(rows, columns).alias("properties"),
        src.alias("src"),
        dst.alias("dst"),
    )


def _text_or_null(timestamp: Column | None) -> Column:
    if timestamp is None:
        timestamp = F.lit(None)
    return timestamp.cast("string").alias("timestamp")


def _seconds(column: str) -> Column:
    """Timestamp as text without fractions, whatever the session time zone."""
    return F.substring(F.col(column).cast("string"), 1, 19)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder; the stated schema spares a job that infers it."""
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}.parquet")


def commerce(spark: SparkSession, folder: str, **options) -> PropertyGraph:
    """Customers, orders, parts, suppliers, nations and regions.

    ``contains`` and ``supplies`` have one edge per distinct pair.  Few pairs repeat, so
    rows are dealt to tasks by pair as they are, in as many partitions as it takes: a
    combining task would hold nearly every row of its input.  The rows are counted for
    that, from the footers of the files.
    """
    name = "commerce"
    customer = load(spark, folder, "customer")
    orders = load(spark, folder, "orders")
    part = load(spark, folder, "part")
    supplier = load(spark, folder, "supplier")
    nation = load(spark, folder, "nation")
    region = load(spark, folder, "region")
    lineitem = load(spark, folder, "lineitem")
    order_date = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_orderdate",
        F.to_date("o_orderdate").alias("day"),
    )
    vertices = [
        vertices_of(
            customer, name, "customer", "c_custkey",
            {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"},
        ),
        vertices_of(
            order_date, name, "order", "o_orderkey",
            {"status": "o_orderstatus", "priority": "o_orderpriority", "day": "day"},
            _seconds("o_orderdate"),
        ),
        vertices_of(
            part, name, "part", "p_partkey",
            {"name": "p_name", "brand": "p_brand", "size": "p_size"},
        ),
        vertices_of(
            supplier, name, "supplier", "s_suppkey",
            {"name": "s_name", "balance": "s_acctbal"},
        ),
        vertices_of(nation, name, "nation", "n_nationkey", {"name": "n_name"}),
        vertices_of(region, name, "region", "r_regionkey", {"name": "r_name"}),
    ]
    partitions = partitions_for(spark, lineitem.count(), PAIRS_PER_TASK)

    def pairs(*keys: str) -> GroupedData:
        return lineitem.repartition(partitions, *keys).groupBy(*keys)

    contains = pairs("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("weight")
    )
    supplies = pairs("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("shipments")
    )

    def joined(label: str, *keys: str) -> Column:
        return F.concat_ws("_", F.lit(label), *keys)

    edges = [
        edges_of(
            order_date, name, "placed", element_id("placed", "o_orderkey"),
            element_id("customer", "o_custkey"), element_id("order", "o_orderkey"),
            {"day": "day"},
        ),
        edges_of(
            contains, name, "contains", joined("contains", "l_orderkey", "l_partkey"),
            element_id("order", "l_orderkey"), element_id("part", "l_partkey"),
            {"weight": "weight"},
        ),
        edges_of(
            supplies, name, "supplies", joined("supplies", "l_suppkey", "l_partkey"),
            element_id("supplier", "l_suppkey"), element_id("part", "l_partkey"),
            {"shipments": "shipments"},
        ),
        edges_of(
            customer, name, "lives_in", element_id("lives_in", "c_custkey"),
            element_id("customer", "c_custkey"), element_id("nation", "c_nationkey"),
            {},
        ),
        edges_of(
            supplier, name, "based_in", element_id("based_in", "s_suppkey"),
            element_id("supplier", "s_suppkey"), element_id("nation", "s_nationkey"),
            {},
        ),
        edges_of(
            nation, name, "in_region", element_id("in_region", "n_nationkey"),
            element_id("nation", "n_nationkey"), element_id("region", "n_regionkey"),
            {},
        ),
    ]
    return PropertyGraph(
        reduce(DataFrame.unionByName, vertices),
        reduce(DataFrame.unionByName, edges),
        **options,
    )


def trade(spark: SparkSession, folder: str, **options) -> PropertyGraph:
    """The order graph turned into cycles: customer, order, part, supplier, nation
    and again the customers of that nation.

    ``supplies`` and ``lives_in`` run the other way round here, under the same
    labels and ids; every other edge between these vertices is kept as it is.
    """
    graph = commerce(spark, folder).exclude(["region"], ["in_region"])
    turned = F.col("label").isin("supplies", "lives_in")
    name = F.lit("trade")
    edges = graph.edges.select(
        "timestamp", name.alias("datasource"), "id", "label", "properties",
        F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    )
    return PropertyGraph(graph.vertices.withColumn("datasource", name), edges, **options)


def refers(
    spark: SparkSession, folder: str, **options
) -> PropertyGraph:
    """Users, linked to the user that each of their events refers to."""
    name = "refers"
    events = load(spark, folder, "events")
    users = vertices_of(
        events.select("user_id").distinct(), name, "user", "user_id",
        {"number": "user_id"},
    )
    referred = F.get_json_object("props", "$.k")
    links = edges_of(
        events, name, F.col("event_type"),
        element_id("event", "event_id"), element_id("user", "user_id"),
        element_id("user", referred), {"value": "value"},
        _seconds("ts"),
    )
    return PropertyGraph(users, links, **options)
