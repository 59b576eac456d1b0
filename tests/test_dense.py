"""Rounds over arrays, which long graphs use, on small graphs."""

import random
import time

import pytest

import vertexloom.operators.dense as dense_module
import vertexloom.operators.index as index_module
import vertexloom.operators.pagerank as pagerank_module
import vertexloom.operators.strong_components as strong_module
from vertexloom.operators.pagerank import NotStableError
from vertexloom.operators.scratch import Scratch

from tests.graphs import as_dict, make_graph, page_ranks, strong_components, weak_components
from tests.test_pagerank import close, hub_graph


@pytest.fixture
def laid_out(monkeypatch):
    """Every graph counts as long; names of the tables that edges are laid out in."""
    names, lay_out = [], dense_module.DenseGraph.lay_out

    def noted(self, edges, source, target, name):
        names.append(name)
        return lay_out(self, edges, source, target, name)

    monkeypatch.setattr(dense_module, "DENSE_FROM", 1)
    monkeypatch.setattr(index_module, "DENSE_FROM", 1)
    monkeypatch.setattr(index_module, "UNMERGED_FROM", 1)
    monkeypatch.setattr(dense_module.DenseGraph, "lay_out", noted)
    return names


@pytest.mark.parametrize("params", [{"max_iter": 3}, {"reset": 0.5, "tol": 0.01}])
def test_ranks_against_brute_force(spark, laid_out, params):
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs)
    expected = {("rounds" if k == "max_iter" else k): v for k, v in params.items()}
    close(as_dict(graph.pagerank(**params)), page_ranks(ids, pairs, **expected))
    assert laid_out == ["rank-blocks"]
    graph.release()


def test_ranks_of_parallel_edges_that_were_not_merged(spark, laid_out, monkeypatch):
    """Also where joins do the rounds."""
    rng = random.Random(5)
    ids = [f"v{n:03d}" for n in range(300)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(900)]
    pairs += pairs[:40]
    graph = make_graph(spark, ids, pairs)
    assert graph._indexed().n_edges == 940
    expected = page_ranks(ids, pairs, reset=0.4, rounds=3)
    close(as_dict(graph.pagerank(reset=0.4, max_iter=3)), expected)
    monkeypatch.setattr(dense_module, "DENSE_FROM", 1_000_000)
    close(as_dict(graph.pagerank(reset=0.4, max_iter=3)), expected)
    assert as_dict(graph.connected_components()) == weak_components(ids, pairs)
    assert as_dict(graph.strongly_connected_components()) == strong_components(ids, pairs)
    assert laid_out == ["rank-blocks"]
    graph.release()


@pytest.mark.parametrize("tail", [1_000, 1])
def test_push_solves_the_equation(spark, laid_out, monkeypatch, tail):
    """Over arrays to the end, or by joins after a round with few senders."""
    monkeypatch.setattr(pagerank_module, "TAIL_ROUNDS", tail)
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs)
    found = as_dict(graph.pagerank(reset=0.99, tol=1e-9, push=True))
    expected = page_ranks(ids, pairs, reset=0.99, rounds=40)
    assert all(found[i] == pytest.approx(expected[i], abs=1e-8) for i in ids)
    assert laid_out == ["rank-blocks"]
    graph.release()


def test_rounds_are_bounded(spark, laid_out):
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs)
    for push in (False, True):
        with pytest.raises(NotStableError):
            graph.pagerank(tol=1e-9, max_iter=2, push=push)
    graph.release()


def test_a_block_of_too_many_edges_is_left_to_joins(spark, laid_out, monkeypatch):
    monkeypatch.setattr(dense_module, "MOST_IN_BLOCK", 3)
    ids, pairs = hub_graph()
    graph = make_graph(spark, ids, pairs)
    close(as_dict(graph.pagerank(max_iter=2)), page_ranks(ids, pairs, rounds=2))
    assert not laid_out
    graph.release()


@pytest.mark.parametrize("rounds", [40, 2])
def test_strong_components(spark, laid_out, monkeypatch, rounds):
    """With several turns; labels settle over arrays, or by joins after two rounds."""
    monkeypatch.setattr(strong_module, "DENSE_ROUNDS", rounds)
    rng = random.Random(7)
    ids, pairs = ["iso", "loop", "c1", "c2"], [("loop", "loop"), ("c1", "c2"), ("c2", "c1"), ("c2", "nowhere")]
    for n, m in ((30, 60), (12, 15)):
        names = [f"g{m}_{i:02d}" for i in range(n)]
        ids += names
        pairs += [(rng.choice(names), rng.choice(names)) for _ in range(m)] * 2
    graph = make_graph(spark, ids, pairs)
    assert as_dict(graph.strongly_connected_components()) == strong_components(ids, pairs)
    assert laid_out[:2] == ["scc-heads", "scc-tails"]
    graph.release()


def test_strong_components_without_cycles(spark, laid_out):
    ids = ["a", "b", "c"]
    graph = make_graph(spark, ids, [("a", "b"), ("b", "c"), ("c", "c")])
    assert as_dict(graph.strongly_connected_components()) == {i: i for i in ids}
    graph.release()


def test_saved_tables_leave_no_shuffle_files(spark):
    """Else the rounds of a loop add up on disk."""

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        names = [blocks.apply(i).name() for i in range(blocks.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before, scratch = files(), Scratch(spark)
    rows = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()
    saved = scratch.save(rows, "counts")
    dealt, seen = scratch.save_dealt(rows.repartition(3, "k"), "dealt", "k", 3)
    assert saved.count() == dealt.count() == 10
    end = time.time() + 20
    while time.time() < end and any(f.endswith(".data") for f in files() - before):
        kept = {f.split("_")[1] for f in files() - before}
        if len(kept) <= 2:  # those of the two counts above
            break
        time.sleep(0.2)
    assert len({f.split("_")[1] for f in files() - before}) <= 2
    scratch.clear()
