import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.graphs import as_dict, make_graph, strong_components, weak_components
import vertexloom.operators.strong_components as strong_module
from vertexloom import EmptyGraphError
from vertexloom.operators.strong_components import strongly_connected_components
from vertexloom.sources.sample import sample_graph

# None of the rows per key is hot / every key with more than 2 rows is.
HOT = [1_000_000, 2]


def check(spark, ids, pairs, hot_rows=1_000_000):
    graph = make_graph(spark, ids, pairs, hot_rows=hot_rows)
    assert as_dict(graph.connected_components()) == weak_components(ids, pairs)
    assert as_dict(graph.strongly_connected_components()) == strong_components(
        ids, pairs
    )
    graph.release()


def hand_made():
    """The edge cases in one graph, each with its own id prefix."""
    parts = [
        (["iso"], []),
        (["loop"], [("loop", "loop")]),
        (["da"], [("da", "nowhere"), ("nowhere", "da")]),
        (["pa", "pb"], [("pa", "pb"), ("pa", "pb"), ("pa", "pa")]),
        (list("abcd"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]),
        (
            ["ta", "tb", "tc", "td"],
            [("ta", "tb"), ("tb", "ta"), ("tc", "td"), ("td", "tc"), ("tb", "tc")],
        ),
    ]
    hub = [f"leaf{n:02d}" for n in range(40)]
    parts.append((["zhub", *hub], [("zhub", x) for x in hub] + [(hub[3], "zhub")]))
    ring = [f"ring{n:02d}" for n in range(30)]
    parts.append((ring, [(ring[n], ring[(n + 1) % 30]) for n in range(30)]))
    ids = [i for part, _ in parts for i in part]
    return ids, [p for _, pairs in parts for p in pairs]


@pytest.mark.parametrize("hot_rows", HOT)
def test_hand_made_cases(spark, hot_rows):
    check(spark, *hand_made(), hot_rows)


def test_random_graphs(spark):
    rng = random.Random(7)
    ids, pairs = [], []
    for g, (n, m) in enumerate([(20, 12), (20, 25), (30, 60), (40, 50), (60, 70)]):
        names = [f"g{g}_{rng.random():.6f}" for _ in range(n)]
        ids += names
        pairs += [(rng.choice(names), rng.choice(names)) for _ in range(m)]
    check(spark, ids, pairs)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14),
        min_size=8,
        max_size=12,
    )
)
def test_generated_graphs(spark, graphs):
    ids = [f"g{g:02d}_{n}" for g in range(len(graphs)) for n in range(7)]
    pairs = [
        (f"g{g:02d}_{s}", f"g{g:02d}_{d}")  # number 7 is no vertex
        for g, edges in enumerate(graphs)
        for s, d in edges
    ]
    check(spark, ids, pairs)


@pytest.mark.parametrize("order", ["up", "down", "shuffled"])
def test_long_chain(spark, order):
    ids = [f"n{n:04d}" for n in range(200)]
    path = list(ids)
    if order == "down":
        path.reverse()
    elif order == "shuffled":
        random.Random(3).shuffle(path)
    pairs = list(zip(path, path[1:]))
    graph = make_graph(spark, ids, pairs)
    assert set(as_dict(graph.connected_components()).values()) == {"n0000"}
    if order == "shuffled":
        strong = as_dict(graph.strongly_connected_components())
        assert strong == {i: i for i in ids}


def test_sample_graph(spark):
    graph = sample_graph(spark)
    assert set(as_dict(graph.connected_components()).values()) == {"modern_1"}
    strong = as_dict(graph.strongly_connected_components())
    assert strong == {f"modern_{n}": f"modern_{n}" for n in range(1, 7)}


def test_repeated_vertex_rows_count_once(spark):
    graph = make_graph(spark, ["a", "b", "a", "c"], [("a", "b")])
    assert as_dict(graph.connected_components()) == {"a": "a", "b": "a", "c": "c"}


def test_no_edges(spark):
    check(spark, ["a", "b"], [])


def test_no_vertices(spark):
    graph = make_graph(spark, [], [("a", "b")])
    for operator in ("connected_components", "strongly_connected_components", "pagerank"):
        with pytest.raises(EmptyGraphError):
            getattr(graph, operator)()


@pytest.mark.parametrize("few, hot_rows", [(1_000_000, 4), (5, 1_000_000), (0, 4)])
def test_strong_components_by_frontier(spark, few, hot_rows):
    """Rounds of few changed labels, of many, and of both; a ring takes many rounds."""
    rng = random.Random(17)
    ring = [f"r{i:03d}" for i in range(30)]
    pairs = list(zip(ring, ring[1:] + ring[:1]))
    ids = [f"v{i:02d}" for i in range(40)]
    pairs += [(rng.choice(ids), rng.choice(ids)) for _ in range(70)] + [(ids[0], ring[0])]
    graph = make_graph(spark, ids + ring, pairs, hot_rows=hot_rows)
    found = strongly_connected_components(graph._indexed(), graph._scratch, hot_rows, few)
    assert as_dict(found) == strong_components(ids + ring, pairs)
    graph.release()


def test_late_rounds_of_strong_components_read_few_links(spark, monkeypatch):
    read, meet = [], strong_module.meet_few

    def counted(rows, key, few, n_few, how="inner"):
        read.append(n_few)
        return meet(rows, key, few, n_few, how)

    monkeypatch.setattr(strong_module, "meet_few", counted)
    ring = [f"r{i:03d}" for i in range(50)]
    pairs = list(zip(ring, ring[1:] + ring[:1]))
    graph = make_graph(spark, ring, pairs)
    assert set(as_dict(graph.strongly_connected_components()).values()) == {"r000"}
    assert read and max(read) <= 25 and read[-1] < read[0]
    graph.release()
