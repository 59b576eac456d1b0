import math

import pytest
from pyspark.sql import functions as F

from tests.graphs import make_graph
from vertexloom.operators import skew
from vertexloom.operators.pagerank import _round, _weighted_edges
from vertexloom.operators.skew import SLICE, find_hot, lookup_join, slice_rows


def rows_and_table(spark):
    """1000 rows of which key 0 has a third; keys 8 and 9 are not in the table."""
    rows = spark.range(1000).select(
        F.col("id").alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 10).alias("k"),
    )
    return rows, spark.range(8).select(F.col("id").alias("key"), (F.col("id") * 2).alias("y"))


def joined(rows, table, how):
    return lookup_join(rows, "k", table, "key", find_hot(rows, "k", 1000, 50), "x", how)


def test_sliced_joins_equal_plain_joins(spark):
    rows, table = rows_and_table(spark)
    for how in ("inner", "left", "left_semi"):
        plain = rows.join(table, F.col("k") == F.col("key"), how).drop("key")
        found = joined(rows, table, how)
        assert found.columns == plain.columns
        assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_keys_and_slices(spark):
    rows, _ = rows_and_table(spark)
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    hot = {r.hot_key: r.slices for r in find_hot(rows, "k", 1000, 50).collect()}
    assert hot == {k: -(-n // 50) for k, n in counts.items() if n > 50}


def test_small_tables_are_not_searched(spark):
    rows, _ = rows_and_table(spark)
    assert find_hot(rows, "k", 1000, 1000) is None
    assert find_hot(rows, "k", 1000, 900) is None


@pytest.mark.parametrize("listed", [1, 100])
def test_every_hot_key_is_split_however_many_there_are(spark, monkeypatch, listed):
    """A list too long to broadcast changes the plan only."""
    monkeypatch.setattr(skew, "LISTED_KEYS", listed)
    rows, table = rows_and_table(spark)
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    hot = find_hot(rows, "k", 1000, 50)
    assert {r.hot_key: r.slices for r in hot.collect()} == {
        k: -(-n // 50) for k, n in counts.items() if n > 50
    }
    assert len([n for n in counts.values() if n > 50]) > 1
    sliced = slice_rows(rows, "k", hot, "x").groupBy("k").agg(F.countDistinct(SLICE).alias("n"))
    assert all(r["n"] > 1 for r in sliced.collect() if counts[r["k"]] > 50)
    for how in ("inner", "left", "left_semi"):
        plain = rows.join(table, F.col("k") == F.col("key"), how).drop("key")
        found = joined(rows, table, how)
        assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hub_is_spread_over_slices(spark):
    rows, _ = rows_and_table(spark)
    hot = find_hot(rows, "k", 1000, 50)
    sliced = slice_rows(rows, "k", hot, "x").where("k = 0")
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3


@pytest.mark.parametrize("hot_rows", [3, 1000])
@pytest.mark.parametrize("rows_per_partition", [1, 2, 5, 10_000])
def test_rounds_do_not_move_the_edges(spark, monkeypatch, hot_rows, rows_per_partition):
    """The persisted edges of PageRank are joined without exchange or sort."""
    monkeypatch.setattr(skew, "MIN_ROWS_PER_PARTITION", rows_per_partition)
    graph = make_graph(
        spark, list("abcd"), [("a", x) for x in "abcd"] * 2, hot_rows=hot_rows
    )
    index = graph._indexed()
    with skew.shuffle_partitions(spark, index.partitions):
        edges = _weighted_edges(index, graph._scratch, hot_rows, index.partitions)
        assert (edges.hot is not None) == (hot_rows == 3)
        assert edges.partitions == max(2, min(4, math.ceil(4 / rows_per_partition)))
        edges.rows.count()
        states = spark.createDataFrame([(0, 1.0)], "s bigint, rank double")
        joined = edges.join(states, "left")
        joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    edges.release()
    left = plan.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in left
    assert "Exchange" not in left and "Sort [" not in left
    graph.release()


@pytest.fixture
def without_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("rows_per_partition", [3, 10_000_000])
def test_one_shuffle_of_states_a_round_and_none_of_edges(spark, monkeypatch, without_broadcast, rows_per_partition):
    """Also where the edges have more or fewer partitions than the session's setting."""
    monkeypatch.setattr(skew, "ROWS_PER_PARTITION", rows_per_partition)
    ids = [f"n{i}" for i in range(12)]
    graph = make_graph(spark, ids, [(ids[i], ids[(i * k + 1) % 12]) for i in range(12) for k in (1, 5, 7)])
    index = graph._indexed()
    assert index.partitions != 4
    with skew.shuffle_partitions(spark, index.partitions):
        edges = _weighted_edges(index, graph._scratch, 1_000_000, index.partitions)
        edges.rows.count()
        built = edges.rows._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in built and "Exchange" not in built
        state = _round(edges, _round(edges, _round(edges, None, 0.15), 0.15), 0.15)
        state.collect()
        plan = state._jdf.queryExecution().executedPlan().executedPlan().toString()
    rounds = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(rounds) == 3 and all(f", {index.partitions})" in line or f", {index.partitions}," in line for line in rounds)
    edges.release()
    graph.release()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_released_graphs_leave_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    graph = make_graph(spark, list("abc"), [("a", "b"), ("b", "c")])
    graph.pagerank().collect()
    assert {t.name for t in spark.catalog.listTables()} > before
    graph.release()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_hot_ends_are_found_in_one_pass(spark):
    rows = spark.createDataFrame([("a", x) for x in "bcde"] + [("c", "e"), ("d", "e")], "src string, dst string")
    hot = skew.find_hot_of(rows, ["src", "dst"], 6, 2)
    assert [tuple(r) for r in hot["src"].collect()] == [("a", 2)]
    assert [tuple(r) for r in hot["dst"].collect()] == [("e", 2)]
    assert skew.find_hot_of(rows, ["src", "dst"], 6, 6) == {"src": None, "dst": None}


def test_only_hot_groups_are_searched_for_keys(spark, monkeypatch):
    """Counting all keys would move every one of them; groups are a few numbers per task."""
    rows, _ = rows_and_table(spark)
    searched, hottest = [], skew.hottest
    monkeypatch.setattr(skew, "hottest", lambda *a: searched.append(a) or hottest(*a))
    assert find_hot(rows, "x", 1000, 50) is None and not searched
    assert sorted(r.hot_key for r in find_hot(rows, "k", 1000, 200).collect()) == [0] and len(searched) == 1


def test_long_tables_are_held_in_memory_by_share(spark, monkeypatch, without_broadcast):
    monkeypatch.setattr(skew, "HASHED_KEYS", 1)
    rows, table = rows_and_table(spark)
    for how in ("inner", "left", "left_semi"):
        plain = rows.join(table, F.col("k") == F.col("key"), how).drop("key")
        for hot_rows in (50, 1000):
            found = lookup_join(rows, "k", table, "key", find_hot(rows, "k", 1000, hot_rows), "x", how, 8)
            assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)
            assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(skew, "KEYS_PER_TASK", 1)
    few = lookup_join(rows, "k", table, "key", None, "x", n_keys=8)
    assert "ShuffledHashJoin" not in few._jdf.queryExecution().executedPlan().toString()
