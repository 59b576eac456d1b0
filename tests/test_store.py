import json

import pytest
from pyspark.sql import functions as F

from tests.graphs import as_dict, make_graph
from vertexloom import EDGE_SCHEMA, VERTEX_SCHEMA, EmptyGraphError, element_schema
from vertexloom.operators import filters
from vertexloom.plans.jobs import run_drop_keys, run_job
from vertexloom.sources import catalog
from vertexloom.sources.export import to_json_rows, write_json
from vertexloom.sources.sample import sample_graph
from vertexloom.sources.store import GraphStore, MergeError, MissingDatasetError


@pytest.fixture
def store(spark, tmp_path):
    """Store with the sample graph and a second, unrelated one."""
    store = GraphStore(spark, str(tmp_path / "store"))
    sample = sample_graph(spark)
    store.merge(sample.vertices, "modern", "v")
    store.merge(sample.edges, "modern", "e")
    other = make_graph(spark, ["a", "b"], [("a", "b")])
    store.merge(other.vertices, "test", "v")
    store.merge(other.edges, "test", "E")
    return store


def values(vertices, operator):
    flat = filters.flatten_properties(vertices).where(F.col("key") == "_$$" + operator)
    return as_dict(flat.select("id", "value"))


def test_element_kinds():
    assert element_schema("v") is VERTEX_SCHEMA
    assert element_schema("E") is EDGE_SCHEMA
    for kind in ("p", "x", "", None):
        with pytest.raises(ValueError):
            element_schema(kind)


def test_read_back(store):
    vertices = store.read("modern", "v")
    assert vertices.columns == VERTEX_SCHEMA.names
    assert vertices.count() == 6
    assert store.read("modern", "e").columns == EDGE_SCHEMA.names
    assert store.read("modern", "e", ["created"]).count() == 2
    assert store.read("test", "v").count() == 2
    graph = store.graph("modern", ["software"], ["knows"])
    assert tuple(graph.count().first()) == (4, 4)
    with pytest.raises(MissingDatasetError):
        store.read("nowhere", "v")
    with pytest.raises(ValueError):
        store.read("modern", "p")


def test_exclusion_and_columns_reach_the_scan(store):
    plan = store.read("modern", "e", ["created"]).select("src", "dst")
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text.split("PushedFilters")[1].split("]")[0]
    assert "IsNull(label)" in pushed and "created" in pushed
    assert "properties" not in text.split("ReadSchema")[1]


def test_merge_replaces_and_adds(spark, store):
    rows = [
        (None, "modern", "modern_1", "person", []),
        ("2020-01-01 00:00:00", "modern", "modern_99", "robot", [("k", "t", "v")]),
    ]
    store.merge(spark.createDataFrame(rows, VERTEX_SCHEMA), "modern", "v")
    found = {r.id: r for r in store.read("modern", "v").collect()}
    assert len(found) == 7
    assert found["modern_1"].properties == []
    assert found["modern_99"].label == "robot"
    assert len(found["modern_2"].properties) == 3
    assert store.read("test", "v").count() == 2


def test_merge_of_own_rows(store):
    """A graph may be merged into the table it was read from."""
    store.merge(store.read("modern", "v").where("label = 'person'"), "modern", "v")
    assert store.read("modern", "v").count() == 6


def test_invalid_merges_leave_the_store_alone(spark, store):
    one = (None, "modern", "modern_1", "person", [])
    for rows in (
        [one, one],
        [(None, "test", "x", "person", [])],
        [(None, "modern", None, "person", [])],
    ):
        with pytest.raises(MergeError):
            store.merge(spark.createDataFrame(rows, VERTEX_SCHEMA), "modern", "v")
    assert store.read("modern", "v").where("size(properties) = 0").isEmpty()


def files_by_bucket(root, datasource="test", kind="v"):
    folder = root / "store" / kind / datasource
    return {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in folder.glob("bucket=*")}


def test_nothing_to_merge(spark, store, tmp_path):
    before = files_by_bucket(tmp_path, "modern")
    assert store.merge(spark.createDataFrame([], VERTEX_SCHEMA), "modern", "v") == 0
    assert files_by_bucket(tmp_path, "modern") == before
    assert store.merge(spark.createDataFrame([], VERTEX_SCHEMA), "empty", "v") == 0
    with pytest.raises(MissingDatasetError):
        store.read("empty", "v")


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), buckets=8)
    ids = [f"n{i}" for i in range(50)]
    assert store.merge(make_graph(spark, ids, []).vertices, "test", "v") == 50
    expected = dict.fromkeys(ids, "node")
    for turn in range(4):
        before = files_by_bucket(tmp_path)
        changed = {f"n{turn}": f"a{turn}", "n9": f"b{turn}", f"new{turn}": "c"}
        rows = [("2020-01-01 00:00:00", "test", i, label, []) for i, label in changed.items()]
        new = spark.createDataFrame(rows, VERTEX_SCHEMA)
        buckets = new.select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()
        touched = {f"bucket={r.b}" for r in buckets}
        # Every second merge lacks a column, which keeps its stored value.
        store.merge(new.drop("timestamp") if turn % 2 else new, "test", "v")
        after = files_by_bucket(tmp_path)
        assert len(after) == 8 and {b for b in after if after[b] != before.get(b)} == touched
        expected.update(changed)
    found = store.read("test", "v")
    assert found.columns == VERTEX_SCHEMA.names
    rows = {r.id: r for r in found.collect()}
    assert {i: r.label for i, r in rows.items()} == expected and found.count() == len(expected)
    assert rows["n9"].timestamp is not None and rows["new3"].timestamp is None
    assert store.read("test", "v", ["b3", "c"]).count() == len(expected) - 5


def test_a_failed_writer_changes_nothing_and_blocks_nobody(spark, store, tmp_path):
    """A job that dies while it writes; the next writer goes on as if it had not been."""
    before = files_by_bucket(tmp_path, "modern")
    dies = F.when(F.col("id") == "modern_3", F.raise_error(F.lit("executor lost"))).otherwise(F.col("label"))
    with pytest.raises(Exception, match="executor lost"):
        store.replace(store.read("modern", "v").withColumn("label", dies), "modern", "v")
    assert files_by_bucket(tmp_path, "modern") == before
    (tmp_path / "store" / "v" / "modern" / ".spark-staging-left-behind").mkdir()
    for _ in range(3):
        assert store.merge(sample_graph(spark).vertices.where("id = 'modern_1'"), "modern", "v") == 1
    assert store.read("modern", "v").count() == 6


def test_a_guarded_write_is_one_query(spark, store):
    """Counts and checks are observed by the writes: staging and merging, or replacing."""

    def queries(run):
        count = spark._jsparkSession.sharedState().statusStore().executionsCount
        before = count()
        run()
        return count() - before

    rows = store.read("modern", "v")
    assert queries(lambda: store.replace(rows, "modern", "v")) == 1
    assert queries(lambda: store.merge(sample_graph(spark).vertices, "modern", "v")) == 2
    assert queries(lambda: store.replace(store.read("modern", "v").where("false"), "modern", "v")) == 1
    assert store.read("modern", "v").count() == 6


def test_options_reach_the_reader(spark, store):
    old = GraphStore(spark, store.root, {"modifiedBefore": "2001-01-01T00:00:00"})
    assert old.read("modern", "v").count() == 0
    new = GraphStore(spark, store.root, {"modifiedAfter": "2001-01-01T00:00:00"})
    assert new.read("modern", "v").count() == 6
    with pytest.raises(ValueError):
        GraphStore(spark, store.root, buckets=0)


def test_absent_columns_keep_their_stored_values(spark, store):
    stamped = sample_graph(spark).vertices.withColumn("timestamp", F.lit("2020-01-01 00:00:00"))
    store.merge(stamped, "modern", "v")
    store.merge(sample_graph(spark).vertices.where("id = 'modern_1'").drop("timestamp"), "modern", "v")
    assert store.read("modern", "v").where("timestamp IS NULL").count() == 0
    store.merge(stamped.where("id = 'modern_1'").select("id", "datasource", F.lit("x").alias("label")), "modern", "v")
    row = store.read("modern", "v").where("id = 'modern_1'").first()
    assert (row.label, row.timestamp) == ("x", "2020-01-01 00:00:00") and row.properties
    with pytest.raises(MergeError):
        store.merge(stamped.drop("datasource"), "modern", "v")


def test_jobs_write_reserved_properties(store):
    assert values(run_job(store, "indegree", "modern"), "indegree") == {
        "modern_2": "1", "modern_3": "3", "modern_4": "1", "modern_5": "1",
    }
    run_job(store, "indegree", "modern", None, ["created"])
    assert values(store.read("modern", "v"), "indegree") == {
        "modern_2": "1",
        "modern_4": "1",
    }
    ranks = values(run_job(store, "pagerank", "modern", max_iter=3), "pagerank")
    assert len(ranks) == 6 and float(ranks["modern_3"]) > 1.5
    assert set(values(run_job(store, "component", "modern"), "component").values()) == {
        "modern_1"
    }
    strong = values(run_job(store, "scomponent", "modern"), "scomponent")
    assert strong == {i: i for i in ranks}
    assert values(run_job(store, "outdegree", "modern"), "outdegree")["modern_1"] == "3"


def test_job_keeps_rows_of_excluded_vertices(store):
    vertices = run_job(store, "component", "modern", ["software"])
    assert vertices.count() == 6
    assert set(values(vertices, "component")) == {
        "modern_1", "modern_2", "modern_4", "modern_6",
    }


def test_job_parameters(store):
    with pytest.raises(ValueError):
        run_job(store, "betweenness", "modern")
    with pytest.raises(ValueError):
        run_job(store, "indegree", None)
    with pytest.raises(EmptyGraphError):
        run_job(store, "indegree", "modern", ["person", "software"])


def test_drop_keys_job(store):
    found = run_drop_keys(store, "modern", "v", ["name", "age", "country"])
    assert filters.flatten_properties(found).count() == 2
    edges = run_drop_keys(store, "modern", "e", ["weight"])
    assert edges.where("size(properties) = 0").count() == 6
    before = store.read("modern", "v").inputFiles()
    run_drop_keys(store, "modern", "v", [])
    assert sorted(store.read("modern", "v").inputFiles()) == sorted(before)
    for missing in (
        {"datasource": None, "kind": "v", "keys": []},
        {"datasource": "modern", "kind": None, "keys": []},
        {"datasource": "modern", "kind": "v", "keys": None},
        {"datasource": "modern", "kind": "p", "keys": []},
    ):
        with pytest.raises(ValueError):
            run_drop_keys(store, **missing)


def test_json(spark, tmp_path):
    vertices = sample_graph(spark).vertices
    rows = {r.id: json.loads(r.json) for r in to_json_rows(vertices).collect()}
    assert rows["modern_3"] == {
        "datasource": "modern",
        "id": "modern_3",
        "label": "software",
        "properties": [
            ["name", "java.lang.String", "lop"],
            ["lang", "java.lang.String", "java"],
        ],
    }
    path = str(tmp_path / "json")
    write_json(vertices, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(x["id"] for x in lines) == sorted(rows)


def test_null_fields_and_lists_in_json(spark):
    rows = spark.createDataFrame([(None, "d", "1", None, None)], VERTEX_SCHEMA)
    assert json.loads(to_json_rows(rows).first().json) == {
        "timestamp": None, "datasource": "d", "id": "1", "label": None, "properties": [],
    }


def test_views(spark):
    vertices = sample_graph(spark).vertices
    catalog.publish_view(vertices, "people")
    assert spark.sql("SELECT * FROM people WHERE label = 'person'").count() == 4
    assert catalog.drop_view(spark, "people")
    catalog.publish_view(vertices, "people", everywhere=True)
    assert spark.newSession().sql("SELECT * FROM global_temp.people").count() == 6
    assert catalog.drop_view(spark, "people", everywhere=True)


def test_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lab")
    vertices = sample_graph(spark).vertices
    catalog.save_as_table(vertices, "lab.vertices", partitions=["label"])
    catalog.save_as_table(vertices, "lab.outside", str(tmp_path / "outside"))
    catalog.create_table(
        spark, "lab.edges", EDGE_SCHEMA, str(tmp_path / "edges"), ["label"], "it's edges"
    )
    names = {r.tableName for r in catalog.tables(spark, "lab").collect()}
    assert names == {"vertices", "outside", "edges"}
    described = {r.col_name: r.data_type for r in catalog.describe(spark, "lab.edges").collect()}
    assert described["src"] == "string"
    assert described["properties"].startswith("array<struct<key:string")
    assert spark.table("lab.vertices").where("label = 'person'").count() == 4
    assert spark.table("lab.outside").count() == 6
    assert spark.table("lab.edges").count() == 0
    spark.sql("DROP DATABASE lab CASCADE")


def test_a_bucket_is_dealt_over_several_tasks(spark, tmp_path):
    """As many as a shuffle has, so that no task has to hold a bucket of any size."""
    vertices = spark.range(400).select(
        F.lit(None).cast("string").alias("timestamp"), F.lit("big").alias("datasource"), F.concat(F.lit("v"), "id").alias("id"),
        F.lit("node").alias("label"), F.array().cast("array<struct<key:string,type:string,value:string>>").alias("properties"),
    )
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        store = GraphStore(spark, str(tmp_path / "shares"), buckets=2)
        for write in (store.merge, store.replace):
            write(vertices, "big", "v")
            read = store.read("big", "v").select("id", F.input_file_name().alias("file")).collect()
            assert len(read) == len({r.id for r in read}) == 400
            assert len({r.file for r in read}) > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_partitioned_table_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    """A task keeps a file open per partition; the setting is put back afterwards."""
    from pyspark.sql.readwriter import DataFrameWriter

    name, seen, save = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *a: (seen.append(spark.conf.get(name)), save(self, *a)))
    before = spark.conf.get(name)
    catalog.save_as_table(sample_graph(spark).edges, "unsorted_edges", str(tmp_path / "t"), ["label"])
    assert seen == [str(catalog.OPEN_FILES)] and spark.conf.get(name) == before
    assert spark.table("unsorted_edges").count() == sample_graph(spark).edges.count()
    spark.sql("DROP TABLE unsorted_edges")
