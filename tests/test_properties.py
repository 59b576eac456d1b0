import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.graphs import as_dict, make_graph
from vertexloom import VERTEX_SCHEMA, PropertyGraph
from vertexloom.functions import properties as P
from vertexloom.functions import variants
from vertexloom.functions.types import parse_tagged, parse_timestamp, tag_of_type, type_of_tag
from vertexloom.operators import filters, reports, writeback
from vertexloom.sources.sample import sample_graph

TEXT = "java.lang.String"


def vertices(spark, lists):
    rows = [(None, "test", i, "node", props) for i, props in lists.items()]
    return spark.createDataFrame(rows, VERTEX_SCHEMA)


def lists_of(df):
    """Property lists by id, as tuples."""
    return {
        r.id: None if r.properties is None else [tuple(p) for p in r.properties]
        for r in df.collect()
    }


MIXED = {
    "empty": [],
    "null": None,
    "twice": [("k", TEXT, "a"), ("x", TEXT, "1"), ("k", TEXT, "b")],
    "other": [("y", "java.lang.Integer", "7")],
}


def test_drop_keys(spark):
    found = lists_of(writeback.drop_keys(vertices(spark, MIXED), ["k", "y", "k"]))
    assert found == {
        "empty": [],
        "null": [],
        "twice": [("x", TEXT, "1")],
        "other": [],
    }


def test_drop_no_keys_changes_nothing(spark):
    rows = vertices(spark, MIXED)
    assert writeback.drop_keys(rows, []) is rows


def test_drop_keys_of_sample(spark):
    rows = sample_graph(spark).vertices
    found = lists_of(writeback.drop_keys(rows, ["name", "age", "country"]))
    assert found["modern_3"] == [("lang", TEXT, "java")]
    assert found["modern_1"] == []
    assert writeback.drop_keys(rows, ["name"]).columns == rows.columns


def test_drop_keys_needs_no_shuffle(spark):
    plan = writeback.drop_keys(vertices(spark, MIXED), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Generate" not in text


def test_set_property_replaces_and_is_idempotent(spark):
    rows = vertices(spark, MIXED)
    values = spark.createDataFrame([("twice", 5), ("null", 6)], "id string, n bigint")
    once = writeback.set_property(rows, values, "k", "n")
    expected = {
        "empty": [],
        "null": [("k", "java.lang.Long", "6")],
        "twice": [("x", TEXT, "1"), ("k", "java.lang.Long", "5")],
        "other": MIXED["other"],
    }
    assert lists_of(once) == expected
    assert once.columns == rows.columns
    assert lists_of(writeback.set_property(once, values, "k", "n")) == expected


def test_stale_result_is_removed(spark):
    graph = make_graph(spark, ["a", "b"], [("a", "b")])
    stale = writeback.set_property(
        graph.vertices,
        spark.createDataFrame([("a", 9)], "id string, degree bigint"),
        "_$$indegree",
        "degree",
    )
    found = lists_of(type(graph)(stale, graph.edges).with_result("indegree"))
    assert found == {"a": [], "b": [("_$$indegree", "java.lang.Long", "1")]}


def test_result_tags(spark):
    graph = sample_graph(spark)
    tags = {
        "indegree": "java.lang.Long",
        "outdegree": "java.lang.Long",
        "pagerank": "java.lang.Double",
        "component": TEXT,
        "scomponent": TEXT,
    }
    for operator, tag in tags.items():
        found = filters.flatten_properties(graph.with_result(operator))
        rows = found.where(F.col("key") == "_$$" + operator).collect()
        assert rows and {r.type for r in rows} == {tag}
    with pytest.raises(ValueError):
        graph.with_result("betweenness")


def test_append_and_replace_properties(spark):
    rows = vertices(spark, MIXED)
    added = spark.createDataFrame(
        [("null", "b", TEXT, "2"), ("null", "a", TEXT, "1"), ("other", "z", TEXT, "3")],
        "id string, key string, type string, value string",
    )
    found = lists_of(writeback.append_properties(rows, added))
    assert found["null"] == [("a", TEXT, "1"), ("b", TEXT, "2")]
    assert found["other"] == MIXED["other"] + [("z", TEXT, "3")]
    assert found["twice"] == MIXED["twice"] and found["empty"] == []

    swapped = writeback.replace_properties(rows, vertices(spark, {"twice": MIXED["other"]}))
    assert lists_of(swapped) == {**dict.fromkeys(MIXED, []), "twice": MIXED["other"]}


def test_flatten_find_and_lift(spark):
    rows = vertices(
        spark,
        {
            **MIXED,
            "bad": [("y", "java.lang.Integer", "x")],
            "odd": [("u", "java.util.UUID", "12-34")],
        },
    )
    assert filters.flatten_properties(rows).count() == 6
    assert [r.id for r in filters.with_property(rows, "k", "b").collect()] == ["twice"]
    lifted = filters.lift_properties(
        rows, {"y": "java.lang.Integer", "k": TEXT, "u": "java.util.UUID"}
    )
    found = {r.id: (r.y, r.k, r.u) for r in lifted.collect()}
    assert found["bad"] == (None, None, None)
    assert found["other"] == (7, None, None)
    assert found["twice"] == (None, "a", None)
    assert found["odd"] == (None, None, "12-34")
    has_k = rows.where(P.has_key(F.col("properties"), "k")).collect()
    assert [r.id for r in has_k] == ["twice"]


@pytest.mark.parametrize(
    ("tag", "text", "value"),
    [
        ("java.lang.String", "x", "x"),
        ("java.lang.Long", "5000000000", 5000000000),
        ("java.lang.Integer", "5000000000", None),
        ("java.lang.Short", "70000", None),
        ("java.lang.Byte", "12", 12),
        ("java.lang.Boolean", "true", True),
        ("java.lang.Double", "0.25", 0.25),
        ("java.lang.Float", "0.5", 0.5),
        ("java.lang.Integer", "29", 29),
        ("java.lang.Integer", "old", None),
    ],
)
def test_values_are_parsed_by_their_tag(spark, tag, text, value):
    df = spark.createDataFrame([(tag, text), ("other", text)], "t string, v string")
    found = df.select(parse_tagged(F.col("v"), F.col("t"), tag).alias("x"))
    assert [r.x for r in found.collect()] == [value, None]
    assert tag_of_type(found.schema["x"].dataType) == tag


def test_dates_timestamps_and_unknown_tags(spark):
    assert type_of_tag("java.util.UUID") == "string"
    df = spark.createDataFrame([("2019-01-21 21:21:21",), ("soon",)], "v string")
    stamps = df.select(parse_timestamp(F.col("v")).cast("string").alias("x")).collect()
    assert [r.x for r in stamps] == ["2019-01-21 21:21:21", None]
    for tag in ("java.sql.Timestamp", "java.sql.Date"):
        parsed = df.select(parse_tagged(F.col("v"), F.lit(tag), tag).alias("x"))
        assert [r.x is None for r in parsed.collect()] == [False, True]


def test_catalogue_and_dominant_types(spark):
    people = sample_graph(spark).vertices
    found = {tuple(r) for r in reports.property_catalogue(people).collect()}
    assert found == {
        ("name", TEXT, 6),
        ("age", "java.lang.Integer", 4),
        ("country", TEXT, 4),
        ("lang", TEXT, 2),
    }
    mixed = vertices(
        spark,
        {
            "a": [("k", "java.lang.Long", "1"), ("tie", "b", "1")],
            "b": [("k", "java.lang.Long", "2"), ("tie", "a", "1")],
            "c": [("k", TEXT, "x")],
        },
    )
    assert as_dict(reports.dominant_types(mixed)) == {"k": "java.lang.Long", "tie": "a"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from("abc"), st.text(max_size=3)), max_size=5),
        min_size=1,
        max_size=8,
    ),
    st.sets(st.sampled_from("abc")),
)
def test_dropped_keys_never_come_back(spark, lists, keys):
    data = {
        str(n): [(k, TEXT, v.replace("\x00", "")) for k, v in props]
        for n, props in enumerate(lists)
    }
    found = lists_of(writeback.drop_keys(vertices(spark, data), keys))
    assert found == {
        i: [p for p in props if p[0] not in keys] for i, props in data.items()
    }


TAGGED = [
    ("s", "java.lang.String", "12"), ("i", "java.lang.Integer", "12"), ("l", "java.lang.Long", "9000000000"),
    ("d", "java.lang.Double", "1.5"), ("f", "java.lang.Float", "0.5"), ("b", "java.lang.Boolean", "true"),
    ("y", "java.lang.Byte", "7"), ("h", "java.lang.Short", "300"), ("day", "java.sql.Date", "2020-02-29"),
    ("t", "java.sql.Timestamp", "2020-02-29 01:02:03"), ("bad", "java.lang.Long", "x"), ("none", "java.lang.Long", None),
    ("odd", "some.Tag", "z"), ("tagless", None, "w"),
]


def test_variants_carry_the_type_of_the_tag(spark):
    rows = spark.createDataFrame(
        [("v", TAGGED), ("w", None), ("x", [])],
        "id string, properties array<struct<key: string, type: string, value: string>>",
    )
    found = variants.variant_properties(rows)
    kinds = {r.key: r.kind for r in found.select("key", variants.variant_kind(F.col("variant")).alias("kind")).collect()}
    assert kinds == {
        "s": "STRING", "i": "BIGINT", "l": "BIGINT", "d": "DOUBLE", "f": "FLOAT", "b": "BOOLEAN", "y": "BIGINT",
        "h": "BIGINT", "day": "DATE", "t": "TIMESTAMP", "bad": None, "none": None, "odd": "STRING", "tagless": "STRING",
    }
    numbers = found.select("key", variants.variant_as(F.col("variant"), "double").alias("n")).where("n IS NOT NULL")
    assert {r.key: r.n for r in numbers.collect() if r.key != "t"} == {
        "s": 12.0, "i": 12.0, "l": 9e9, "d": 1.5, "f": 0.5, "b": 1.0, "y": 7.0, "h": 300.0,
    }


def test_json_variants(spark):
    texts = ["1", "1.5", "true", '"a"', "null", '{"k": [1, "x"]}', "no json", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    value = variants.json_variant(F.col("t"))
    found = rows.select("i", variants.variant_kind(value).alias("kind"), variants.variant_as(value, "string", "$.k[1]").alias("x"))
    assert [(r.kind, r.x) for r in found.orderBy("i").collect()] == [
        ("BIGINT", None), ("DECIMAL(2,1)", None), ("BOOLEAN", None), ("STRING", None), ("VOID", None),
        ("OBJECT<k: ARRAY<VARIANT>>", "x"), (None, None), (None, None), (None, None),
    ]


def test_map_form_and_back(spark):
    first = [("a", "t", "1"), ("b", "t", None), ("a", "u", "2"), (None, "t", "3"), ("c", None, "4")]
    rows = spark.createDataFrame(
        [(1, first), (2, []), (3, None)],
        "id int, properties array<struct<key: string, type: string, value: string>>",
    )
    maps = filters.map_form(rows)
    assert maps.schema["properties"].dataType.simpleString() == "map<string,struct<type:string,value:string>>"
    found = {r.id: {k: tuple(v) for k, v in r.properties.items()} for r in maps.collect()}
    assert found == {1: {"a": ("t", "1"), "b": ("t", None), "c": (None, "4")}, 2: {}, 3: {}}
    back = {r.id: [tuple(p) for p in r.properties] for r in filters.list_form(maps).collect()}
    assert back == {1: [("a", "t", "1"), ("b", "t", None), ("c", None, "4")], 2: [], 3: []}
    assert filters.list_form(maps).schema == filters.list_form(filters.map_form(filters.list_form(maps))).schema


def test_wide_table(spark):
    rows = spark.createDataFrame(
        [
            ("v", [("age", "java.lang.Integer", "3"), ("lang", "java.lang.String", "java")]),
            ("w", [("age", "java.lang.Integer", "x"), ("age", "java.lang.Integer", "4")]),
            ("x", None),
        ],
        "id string, properties array<struct<key: string, type: string, value: string>>",
    )
    wide = filters.wide_table(rows)
    assert wide.dtypes == [("id", "string"), ("age", "int"), ("lang", "string")]
    assert sorted(map(tuple, wide.collect())) == [("v", 3, "java"), ("w", None, None), ("x", None, None)]
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(filters.TooManyKeysError):
        filters.wide_table(rows, max_columns=1)
    for clash in ("ID", "AGE"):
        with pytest.raises(ValueError):
            filters.wide_table(rows.unionByName(rows.select(F.lit("y").alias("id"), F.array(P.make_property(clash, "t", F.lit("1"))).alias("properties"))))
    assert filters.wide_table(rows.where("false")).columns == ["id"]


def test_summary_reads_the_edges_once(spark, tmp_path):
    graph = sample_graph(spark)
    graph.edges.write.parquet(str(tmp_path / "edges"))
    stored = PropertyGraph(graph.vertices, spark.read.parquet(str(tmp_path / "edges")))
    summary = stored.summary()
    assert sorted(summary.collect()) == sorted(graph.summary().collect())
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert ("edge_count", "no such label", 0) in [tuple(r) for r in stored.summary("no such label").collect()]
