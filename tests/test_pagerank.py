import random

import pytest

import vertexloom.operators.pagerank as pagerank_module
from vertexloom.operators import frontier
from vertexloom.operators.pagerank import NotStableError, pagerank

from tests.graphs import as_dict, make_graph, page_ranks
from vertexloom.sources.sample import sample_graph


def close(found, expected):
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, abs=1e-9)


def hub_graph():
    """A hub with a third of the edges, parallel edges, loops and dangling edges."""
    rng = random.Random(11)
    ids = [f"v{n:02d}" for n in range(30)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)]
    pairs += [("v00", i) for i in ids] + [("v01", "v02")] * 4
    pairs += [("v03", "v03"), ("v04", "missing"), ("missing", "v05")]
    return [*ids, "alone"], pairs


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_against_brute_force(spark, hot_rows):
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs, hot_rows=hot_rows)
    close(as_dict(graph.pagerank()), page_ranks(ids, pairs))
    close(
        as_dict(graph.pagerank(reset=0.01, max_iter=7)),
        page_ranks(ids, pairs, reset=0.01, rounds=7),
    )
    close(as_dict(graph.pagerank(tol=0.01)), page_ranks(ids, pairs, tol=0.01))


def test_sample_graph(spark):
    found = as_dict(sample_graph(spark).pagerank())
    expected = {
        "modern_1": 0.682529,
        "modern_2": 0.875912,
        "modern_3": 1.828325,
        "modern_4": 0.875912,
        "modern_5": 1.054792,
        "modern_6": 0.682529,
    }
    assert {k: round(v, 6) for k, v in found.items()} == expected


def test_sum_is_number_of_vertices(spark):
    ids, pairs = hub_graph()
    ranks = as_dict(make_graph(spark, ids, pairs).pagerank())
    assert sum(ranks.values()) == pytest.approx(len(ids))


def test_graph_without_edges(spark):
    assert as_dict(make_graph(spark, ["a", "b"], []).pagerank()) == {"a": 1.0, "b": 1.0}
    assert as_dict(make_graph(spark, ["a", "b"], []).pagerank(tol=0.1)) == {
        "a": 1.0,
        "b": 1.0,
    }


@pytest.mark.parametrize(
    "params",
    [
        {"max_iter": 0},
        {"tol": 0.0},
        {"reset": 0.0},
        {"reset": 1.5},
    ],
)
def test_parameters_are_checked(spark, params):
    with pytest.raises(ValueError):
        sample_graph(spark).pagerank(**params)


def test_tolerance_within_a_bound_of_rounds(spark):
    with pytest.raises(NotStableError):
        sample_graph(spark).pagerank(max_iter=2, tol=0.001)
    bounded = sample_graph(spark).pagerank(max_iter=50, tol=0.001).collect()
    assert sorted(bounded) == sorted(sample_graph(spark).pagerank(tol=0.001).collect())


@pytest.mark.parametrize("few, hot_rows", [(1_000_000, 1_000_000), (12, 3), (0, 3)])
def test_push_solves_the_equation(spark, few, hot_rows):
    """With rounds of few senders, of many, and of both."""
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs, hot_rows=hot_rows)
    found = pagerank(graph._indexed(), graph._scratch, hot_rows, 0.9, None, 1e-11, True, few)
    close(as_dict(found), page_ranks(ids, pairs, reset=0.9, rounds=40))
    graph.release()


def test_push_stops_at_the_tolerance(spark):
    ids, pairs = hub_graph()
    found = as_dict(make_graph(spark, ids, pairs).pagerank(reset=0.5, tol=0.01, push=True))
    exact = page_ranks(ids, pairs, reset=0.5, rounds=50)
    assert all(found[i] == pytest.approx(exact[i], abs=0.05) for i in ids)
    with pytest.raises(NotStableError):
        make_graph(spark, ids, pairs).pagerank(tol=1e-9, max_iter=2, push=True)
    with pytest.raises(ValueError):
        make_graph(spark, ids, pairs).pagerank(push=True)
    assert as_dict(make_graph(spark, ["a", "b"], []).pagerank(tol=0.1, push=True)) == {"a": 1.0, "b": 1.0}


def test_late_rounds_read_the_edges_of_the_frontier(spark, monkeypatch):
    """A thousand vertices settle at once, a pair that links to each other does not."""
    spark.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", "20")
    ids = [f"s{i:04d}" for i in range(400)] + [f"t{i:04d}" for i in range(400)]
    pairs = list(zip(ids[:400], ids[400:])) + [("a", "b"), ("b", "a")]
    read, meet = [], frontier.meet_few

    def counted(rows, key, few, n_few, how="inner"):
        found = meet(rows, key, few, n_few, how)
        if key == "s":
            found.collect()
            read.append((n_few, scanned(found)))
        return found

    monkeypatch.setattr(pagerank_module, "meet_few", counted)
    try:
        graph = make_graph(spark, [*ids, "a", "b"], pairs)
        ranks = as_dict(graph.pagerank(reset=0.4, tol=0.01, push=True))
        graph.release()
    finally:
        spark.conf.unset("spark.sql.inMemoryColumnarStorage.batchSize")
    assert ranks["a"] == pytest.approx(ranks["b"]) and ranks["a"] > ranks["t0000"] > ranks["s0000"]
    assert read[0][0] == 402 and read[0][1] >= 402  # the round that fills the cache counts it twice
    assert len(read) > 5 and all(n == 2 and rows <= 80 for n, rows in read[2:])


def scanned(df):
    """Rows that the cached table of a finished query gave out."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "InMemoryTableScan":
            total += node.metrics().apply("numOutputRows").value()
        elif name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.mark.parametrize("params", [{}, {"max_iter": 1}, {"max_iter": 2}, {"reset": 0.5, "tol": 1e-6}, {"tol": 0.9}, {"tol": 0.05}])
def test_rounds_over_inner_edges_give_the_same_ranks(spark, monkeypatch, params):
    """Leaves beside a hub, cycles, chains and a vertex that nothing leads to."""
    ids, pairs = hub_graph()
    leaves = [f"leaf{n}" for n in range(40)]
    pairs = [*pairs, *((ids[n % 30], leaf) for n, leaf in enumerate(leaves * 5)), ("alone", "leaf1"), ("leaf2", "missing")]
    whole = []
    keep = pagerank_module._without_leaves

    def kept(edges, *rest):
        whole.append((edges.rows.count(), (inner := keep(edges, *rest)).rows.count()))
        return inner

    monkeypatch.setattr(pagerank_module, "LEAVES_FROM", 1)
    monkeypatch.setattr(pagerank_module, "_without_leaves", kept)
    graph = make_graph(spark, [*ids, *leaves], pairs)
    expected = {("rounds" if k == "max_iter" else k): v for k, v in params.items()}
    close(as_dict(graph.pagerank(**params)), page_ranks([*ids, *leaves], pairs, **expected))
    assert whole[0][1] < whole[0][0] / 2
    graph.release()


def test_moves_by_rounding_do_not_count(spark):
    """The last digits of these ranks go round the cycle for ever."""
    ids = [f"n{i}" for i in range(5)]
    pairs = [(ids[i], ids[(i + 1) % 5]) for i in range(5)] + [("n0", "n3"), ("n2", "n0"), ("n3", "n2")]
    found = as_dict(make_graph(spark, ids, pairs).pagerank(reset=0.8, tol=1e-17, max_iter=30))
    close(found, page_ranks(ids, pairs, reset=0.8, rounds=30))
