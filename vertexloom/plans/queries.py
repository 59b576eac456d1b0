"""Registered queries: each takes a session and a data folder.

Every query builds its graph from whole tables of the folder.  Outputs are flat
and doubles are rounded, so that they can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import properties as P
from vertexloom.functions import variants
from vertexloom.functions.types import DOUBLE_TAG, parse_tagged, parse_timestamp
from vertexloom.graph import PropertyGraph
from vertexloom.operators import filters, reports, writeback
from vertexloom.operators.scratch import scratch_root
from vertexloom.plans.jobs import run_drop_keys, run_job
from vertexloom.schema import VERTEX_SCHEMA
from vertexloom.sources import catalog
from vertexloom.sources.export import to_json_rows
from vertexloom.sources.relational import commerce, load, refers, trade
from vertexloom.sources.store import GraphStore

Query = Callable[[SparkSession, str], DataFrame]

EXCLUDED_VERTICES = ["supplier", "region"]
EXCLUDED_EDGES = ["supplies", "lives_in"]
NOT_PLACED = ["lives_in", "based_in", "in_region", "contains", "supplies"]


# -- helpers --------------------------------------------------------------


def _rounded(values: DataFrame, column: str) -> DataFrame:
    return values.withColumn(column, F.round(column, 6))


def _comparable(value: Column, type_tag: Column) -> Column:
    """Property text, with doubles in a form that all engines print alike."""
    amount = parse_tagged(value, type_tag, DOUBLE_TAG).cast("decimal(18,2)")
    return F.coalesce(amount.cast("string"), value).alias("value")


def _flat(elements: DataFrame) -> DataFrame:
    return filters.flatten_properties(elements).select(
        "id", "key", "type", _comparable(F.col("value"), F.col("type"))
    )


def _result_values(vertices: DataFrame, operator: str) -> DataFrame:
    """Reserved property of each vertex that has one."""
    key = P.result_key(operator)
    return filters.flatten_properties(vertices).where(F.col("key") == key)


def _placed(spark: SparkSession, folder: str) -> PropertyGraph:
    return commerce(spark, folder).exclude(edge_labels=NOT_PLACED)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, graph: PropertyGraph, name: str) -> GraphStore:
    """A new store that holds the graph."""
    store = GraphStore(spark, _new_folder(spark, "store"))
    store.merge(graph.vertices, name, "v")
    store.merge(graph.edges, name, "e")
    return store


# -- counts and scans -----------------------------------------------------


def graph_count(spark, folder):
    return commerce(spark, folder).count()


def vertex_label_count(spark, folder):
    return reports.label_counts(commerce(spark, folder).vertices)


def edge_label_count(spark, folder):
    return reports.label_counts(commerce(spark, folder).edges)


def edge_label_filtered_count(spark, folder):
    return reports.count_where(commerce(spark, folder).edges, "label = 'contains'")


def graph_summary(spark, folder):
    return commerce(spark, folder).summary("contains")


def read_vertices_excluding(spark, folder):
    graph = commerce(spark, folder).exclude(vertex_labels=EXCLUDED_VERTICES)
    return filters.of_datasource(graph.vertices, "commerce").select("id", "label")


def read_edges_excluding(spark, folder):
    graph = commerce(spark, folder).exclude(edge_labels=EXCLUDED_EDGES)
    return filters.of_datasource(graph.edges, "commerce").select(
        "id", "label", "src", "dst"
    )


def vertex_headers(spark, folder):
    return filters.header(commerce(spark, folder).vertices)


def edge_timestamps(spark, folder):
    edges = refers(spark, folder).edges
    return edges.select(
        "id", F.year(parse_timestamp(F.col("timestamp"))).alias("year"), "timestamp"
    )


def drop_dangling_edges(spark, folder):
    graph = commerce(spark, folder).exclude(vertex_labels=EXCLUDED_VERTICES)
    return graph.drop_dangling().edges.select("id", "src", "dst")


# -- degrees --------------------------------------------------------------


def in_degree(spark, folder):
    return commerce(spark, folder).in_degree()


def out_degree(spark, folder):
    return commerce(spark, folder).out_degree()


def in_degree_zero_filled(spark, folder):
    return commerce(spark, folder).in_degree(fill_zero=True)


def out_degree_zero_filled(spark, folder):
    return commerce(spark, folder).out_degree(fill_zero=True)


def in_degree_excluding_labels(spark, folder):
    return commerce(spark, folder).exclude(EXCLUDED_VERTICES, EXCLUDED_EDGES).in_degree()


def in_degree_refers(spark, folder):
    return refers(spark, folder).in_degree()


def degree_view_join(spark, folder):
    """Vertices left-joined with degrees in SQL over session views."""
    graph = commerce(spark, folder)
    suffix = uuid.uuid4().hex
    catalog.publish_view(graph.vertices, f"vertices_{suffix}")
    catalog.publish_view(graph.out_degree(), f"degrees_{suffix}")
    joined = spark.sql(
        f"""SELECT v.id, CASE WHEN d.degree IS NULL THEN 0 ELSE d.degree END AS degree
            FROM vertices_{suffix} v LEFT OUTER JOIN degrees_{suffix} d ON v.id = d.id"""
    )
    catalog.drop_view(spark, f"vertices_{suffix}")
    catalog.drop_view(spark, f"degrees_{suffix}")
    return joined


# -- analytics ------------------------------------------------------------


def pagerank(spark, folder):
    return _rounded(commerce(spark, folder).pagerank(), "rank")


def pagerank_alt_params(spark, folder):
    ranks = commerce(spark, folder).pagerank(reset=0.01, max_iter=20)
    return _rounded(ranks, "rank")


def pagerank_tol(spark, folder):
    return _rounded(commerce(spark, folder).pagerank(tol=0.01), "rank")


def pagerank_refers(spark, folder):
    return _rounded(refers(spark, folder).pagerank(), "rank")


def pagerank_trade(spark, folder):
    return _rounded(trade(spark, folder).pagerank(), "rank")


def pagerank_tol_trade(spark, folder):
    """Ranks of a graph with cycles, settled far below the digits shown."""
    ranks = trade(spark, folder).pagerank(reset=0.8, tol=1e-12, max_iter=100)
    return _rounded(ranks, "rank")


def connected_components(spark, folder):
    return _placed(spark, folder).connected_components()


def connected_components_commerce(spark, folder):
    return commerce(spark, folder).connected_components()


def connected_components_refers(spark, folder):
    return refers(spark, folder).connected_components()


def strongly_connected_components(spark, folder):
    return refers(spark, folder).strongly_connected_components()


def strongly_connected_components_commerce(spark, folder):
    return commerce(spark, folder).strongly_connected_components()


def strongly_connected_components_trade(spark, folder):
    return trade(spark, folder).strongly_connected_components()


def component_listing(spark, folder):
    return refers(spark, folder).connected_components().orderBy("component", "id")


def component_sizes(spark, folder):
    found = _placed(spark, folder).connected_components()
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.desc("size"), "component")


# -- properties -----------------------------------------------------------


def flatten_properties(spark, folder):
    return _flat(commerce(spark, folder).vertices)


def flatten_edge_properties(spark, folder):
    return _flat(commerce(spark, folder).edges)


def drop_keys_vertices(spark, folder):
    vertices = commerce(spark, folder).vertices
    return _flat(writeback.drop_keys(vertices, ["name", "balance"]))


def drop_keys_edges(spark, folder):
    return _flat(writeback.drop_keys(commerce(spark, folder).edges, ["weight"]))


def set_in_degree_property(spark, folder):
    return _flat(commerce(spark, folder).with_result("indegree"))


def set_out_degree_property(spark, folder):
    return _flat(commerce(spark, folder).with_result("outdegree"))


def set_pagerank_property(spark, folder):
    found = _result_values(commerce(spark, folder).with_result("pagerank"), "pagerank")
    return found.select(
        "id", "key", "type", F.round(F.col("value").cast("double"), 6).alias("rank")
    )


def set_component_property(spark, folder):
    vertices = refers(spark, folder).with_result("component")
    return _result_values(vertices, "component")


def set_scomponent_property(spark, folder):
    vertices = refers(spark, folder).with_result("scomponent")
    return _result_values(vertices, "scomponent")


def rerun_replaces_property(spark, folder):
    """In-degrees set twice, the second time on fewer edges."""
    graph = commerce(spark, folder)
    once = PropertyGraph(graph.with_result("indegree"), graph.edges)
    return _result_values(
        once.exclude(edge_labels=EXCLUDED_EDGES).with_result("indegree"), "indegree"
    )


def append_property(spark, folder):
    """A property made from a column, tagged by its type, appended to the list."""
    vertices = commerce(spark, folder).vertices
    length = P.make_property("n_chars", "java.lang.Integer", F.length("id"))
    return _flat(
        vertices.withColumn("properties", P.append(F.col("properties"), length))
    )


def append_long_properties(spark, folder):
    """Both degrees in long form, gathered and appended in one pass."""
    graph = commerce(spark, folder)

    def long_form(degrees, key):
        return degrees.select(
            "id",
            F.lit(key).alias("key"),
            F.lit("java.lang.Long").alias("type"),
            F.col("degree").cast("string").alias("value"),
        )

    added = long_form(graph.in_degree(), "in").unionByName(
        long_form(graph.out_degree(), "out")
    )
    return _flat(writeback.append_properties(graph.vertices, added))


def replace_property_lists(spark, folder):
    """Vertices with out-edges get a new list; all others lose theirs."""
    graph = commerce(spark, folder)
    count = P.make_property("n_out", "java.lang.Long", F.col("degree"))
    lists = graph.out_degree().select("id", P.property_list(count).alias("properties"))
    return _flat(writeback.replace_properties(graph.vertices, lists))


def typed_variants(spark, folder):
    """Values of all properties in one column, each in the type of its tag."""
    graph = commerce(spark, folder)
    elements = graph.vertices.unionByName(graph.edges.drop("src", "dst"))
    value = F.col("variant")
    kind = variants.variant_kind(value)
    number = F.when(kind.isin("BIGINT", "DOUBLE"), F.round(variants.variant_as(value, "double"), 2))
    return variants.variant_properties(elements).select(
        "id",
        "key",
        kind.alias("kind"),
        number.alias("number"),
        F.when(kind == "DATE", variants.variant_as(value, "date")).alias("day"),
        F.when(kind == "STRING", variants.variant_as(value, "string")).alias("text"),
    )


def json_variants(spark, folder):
    """Event properties read as JSON; user ids, whatever they are, as numbers."""
    events = load(spark, folder, "events")
    read = events.select("event_id", variants.json_variant(F.col("props")).alias("v"), "props")
    return read.select(
        "event_id",
        variants.variant_as(F.col("v"), "bigint", "$.k").alias("k"),
        F.col("v").isNotNull().alias("is_json"),
    )


def property_map_round_trip(spark, folder):
    """Vertices in map form and back in list form."""
    vertices = filters.map_form(commerce(spark, folder).vertices)
    return _flat(filters.list_form(vertices))


def property_map_lookup(spark, folder):
    """One key read from the map form."""
    vertices = filters.map_form(commerce(spark, folder).vertices)
    return vertices.select("id", F.col("properties")["name"]["value"].alias("name"))


def wide_typed_table(spark, folder):
    """A typed column for every property key that occurs, found by a query."""
    wide = filters.wide_table(commerce(spark, folder).vertices)
    return wide.withColumn("balance", F.round("balance", 2))


def pagerank_push_trade(spark, folder):
    """As ``pagerank_tol_trade``, by pushing residuals of a frontier."""
    ranks = trade(spark, folder).pagerank(reset=0.8, tol=1e-12, push=True)
    return _rounded(ranks, "rank")


def property_key_catalogue(spark, folder):
    found = reports.property_catalogue(commerce(spark, folder).vertices)
    return found.orderBy(F.desc("cnt"), "key", "type")


def dominant_property_type(spark, folder):
    """Most frequent type of each property key over vertices and edges."""
    elements = commerce(spark, folder).vertices.unionByName(
        commerce(spark, folder).edges.drop("src", "dst")
    )
    return reports.dominant_types(elements)


def top_property_type(spark, folder):
    """The most frequent property type over all vertices."""
    types = filters.flatten_properties(commerce(spark, folder).vertices)
    counts = types.groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "type").limit(1)


def find_by_property(spark, folder):
    vertices = commerce(spark, folder).vertices
    return filters.with_property(vertices, "segment", "HOUSEHOLD").select("id")


def lift_typed_property(spark, folder):
    """Typed columns; ``name`` is no number and lifts to NULL."""
    lifted = filters.lift_properties(
        commerce(spark, folder).vertices,
        {
            "size": "java.lang.Integer",
            "balance": "java.lang.Double",
            "day": "java.sql.Date",
            "brand": "java.lang.String",
            "name": "java.lang.Integer",
        },
    )
    return lifted.select(
        "id",
        "size",
        F.round("balance", 2).alias("balance"),
        F.col("day").cast("string").alias("day"),
        "brand",
        "name",
    )


def typed_values(spark, folder):
    """Every property value parsed by its own tag."""
    flat = filters.flatten_properties(commerce(spark, folder).vertices)

    def parsed(tag):
        return parse_tagged(F.col("value"), F.col("type"), tag)

    return flat.select(
        "id",
        "key",
        parsed("java.lang.String").alias("as_string"),
        parsed("java.lang.Integer").alias("as_int"),
        F.round(parsed("java.lang.Double"), 2).alias("as_double"),
        parsed("java.sql.Date").cast("string").alias("as_date"),
    )


# -- stored graphs --------------------------------------------------------


def upsert_merge(spark, folder):
    """All customers replaced and all users added in one merge."""
    store = GraphStore(spark, _new_folder(spark, "store"))
    graph = commerce(spark, folder)
    store.merge(graph.vertices, "commerce", "v")
    customers = graph.vertices.where("label = 'customer'")
    users = refers(spark, folder).vertices.withColumn("datasource", F.lit("commerce"))
    changed = writeback.drop_keys(customers, ["segment", "balance"]).unionByName(users)
    store.merge(changed, "commerce", "v")
    return store.read("commerce", "v").select(
        "id", "label", F.size("properties").alias("n_properties")
    )


def store_read_excluding(spark, folder):
    graph = commerce(spark, folder)
    store = GraphStore(spark, _new_folder(spark, "store"))
    store.merge(graph.edges, "commerce", "e")
    return store.read("commerce", "e", EXCLUDED_EDGES).select("id", "label", "src", "dst")


def job_in_degree(spark, folder):
    store = _stored(spark, commerce(spark, folder), "commerce")
    return _flat(run_job(store, "indegree", "commerce"))


def job_pagerank(spark, folder):
    """All stored properties afterwards; ranks with six decimals."""
    store = _stored(spark, commerce(spark, folder), "commerce")
    flat = filters.flatten_properties(run_job(store, "pagerank", "commerce"))
    rank = F.col("value").cast("double").cast("decimal(18,6)").cast("string")
    shown = _comparable(F.col("value"), F.col("type"))
    is_rank = F.col("key") == P.result_key("pagerank")
    return flat.select("id", "key", "type", F.when(is_rank, rank).otherwise(shown).alias("value"))


def job_scomponent(spark, folder):
    store = _stored(spark, trade(spark, folder), "trade")
    return _flat(run_job(store, "scomponent", "trade"))


def job_component_excluding(spark, folder):
    """Components of the stored graph without suppliers and region links."""
    store = _stored(spark, commerce(spark, folder), "commerce")
    excluded = ["nation", "region", "part", "supplier"]
    vertices = run_job(store, "component", "commerce", excluded, NOT_PLACED)
    return _flat(vertices)


def job_drop_keys(spark, folder):
    store = _stored(spark, commerce(spark, folder), "commerce")
    run_job(store, "outdegree", "commerce")
    return _flat(run_drop_keys(store, "commerce", "v", ["_$$outdegree", "name"]))


def table_round_trip(spark, folder):
    """A partitioned external table filled by SQL and read through the catalog."""
    name = f"vertexloom_vertices_{uuid.uuid4().hex}"
    path = _new_folder(spark, "table")
    catalog.create_table(
        spark, name, VERTEX_SCHEMA, path, ["label"], "vertices by label"
    )
    view = f"rows_{name}"
    catalog.publish_view(commerce(spark, folder).vertices, view)
    spark.sql(
        f"INSERT INTO {name} SELECT timestamp, datasource, id, properties, label FROM {view}"
    )
    catalog.drop_view(spark, view)
    return reports.label_counts(spark.table(name))


def table_from_query(spark, folder):
    """A table made from a query, partitioned by label."""
    name = f"vertexloom_edges_{uuid.uuid4().hex}"
    catalog.save_as_table(
        commerce(spark, folder).edges, name, _new_folder(spark, "table"), ["label"]
    )
    return spark.table(name).where("label <> 'contains'").select("id", "src", "dst")


def global_view(spark, folder):
    """Vertices read through a view that all sessions share."""
    name = f"vertexloom_{uuid.uuid4().hex}"
    catalog.publish_view(commerce(spark, folder).vertices, name, everywhere=True)
    found = spark.sql(f"SELECT id, label FROM global_temp.{name}")
    catalog.drop_view(spark, name, everywhere=True)
    return found


def export_json(spark, folder):
    return to_json_rows(commerce(spark, folder).vertices)


def export_json_edges(spark, folder):
    return to_json_rows(commerce(spark, folder).edges)


ALL: dict[str, Query] = {
    query.__name__: query
    for query in (
        graph_count,
        vertex_label_count,
        edge_label_count,
        edge_label_filtered_count,
        graph_summary,
        read_vertices_excluding,
        read_edges_excluding,
        vertex_headers,
        edge_timestamps,
        drop_dangling_edges,
        in_degree,
        out_degree,
        in_degree_zero_filled,
        out_degree_zero_filled,
        in_degree_excluding_labels,
        in_degree_refers,
        degree_view_join,
        pagerank,
        pagerank_alt_params,
        pagerank_tol,
        pagerank_refers,
        pagerank_trade,
        pagerank_tol_trade,
        pagerank_push_trade,
        connected_components,
        connected_components_commerce,
        connected_components_refers,
        strongly_connected_components,
        strongly_connected_components_commerce,
        strongly_connected_components_trade,
        component_listing,
        component_sizes,
        flatten_properties,
        flatten_edge_properties,
        drop_keys_vertices,
        drop_keys_edges,
        set_in_degree_property,
        set_out_degree_property,
        set_pagerank_property,
        set_component_property,
        set_scomponent_property,
        rerun_replaces_property,
        append_property,
        append_long_properties,
        replace_property_lists,
        property_key_catalogue,
        typed_variants,
        json_variants,
        property_map_round_trip,
        property_map_lookup,
        wide_typed_table,
        dominant_property_type,
        top_property_type,
        find_by_property,
        lift_typed_property,
        typed_values,
        upsert_merge,
        store_read_excluding,
        job_in_degree,
        job_pagerank,
        job_scomponent,
        job_component_excluding,
        job_drop_keys,
        table_round_trip,
        table_from_query,
        global_view,
        export_json,
        export_json_edges,
    )
}
