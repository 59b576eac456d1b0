"""PageRank by synchronous rounds.

All ranks start at 1 and a round computes
``reset + (1 - reset) * sum(rank(u) / out_degree(u))`` over the in-edges.
Afterwards ranks are scaled so that they sum to the number of vertices.

Vertices without out-edges send nothing.  Where most edges lead to such leaves, rounds
go over the other edges only, and over all for the ranks that are returned.

By push, a vertex keeps what it received and has not passed on yet as its
residual, which is the amount by which a synchronous round would move its rank.
Only vertices whose residual exceeds the tolerance send, so a round costs what
its frontier costs.

Rounds of a long graph go over arrays (``operators/dense.py``), with the same ranks up to
the rounding of sums.  Graphs of which one block of vertices has far more edges than others
are left to joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators import dense as arrays
from vertexloom.operators.dense import DenseGraph, Layout, array_of, messages, out_of, received, rows_of
from vertexloom.operators.frontier import KeyedState, meet_few
from vertexloom.operators.index import IndexedGraph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import (
    LISTED_KEYS,
    SLICE,
    RoundTable,
    find_hot,
    hottest,
    lookup_join,
    shuffle_partitions,
    slice_rows,
    slice_table,
)

ROUNDS_PER_SAVE = 5
LEAVES_FROM = 1_000_000  # edges of a graph whose leaves are set apart
ROUNDING = 2.0**-52
TAIL_ROUNDS = 20  # rounds over arrays with few senders, after which these are joined
ARRAYS = "k int, exists binary, rank binary, residual binary, moved double, senders long"


class NotStableError(RuntimeError):
    """The ranks did not settle within the rounds allowed."""


def pagerank(
    graph: IndexedGraph,
    scratch: Scratch,
    hot_rows: int,
    reset: float = 0.15,
    max_iter: int | None = None,
    tol: float | None = None,
    push: bool = False,
    few: int = LISTED_KEYS,
) -> DataFrame:
    """Ranks as ``(id, rank)``; stop after ``max_iter`` rounds (10 if neither is
    given) or once no rank moves by more than ``tol``.

    With both, ``max_iter`` is a bound: :class:`NotStableError` is raised if ranks
    still move by more than ``tol`` then.  Moves within the rounding of a sum do not
    count, so that a ``tol`` below it is reached as well.

    ``push`` needs ``tol`` and sends residuals above it only, until none is left; the
    ranks then solve the equation up to residuals of at most ``tol`` per vertex.  A
    round of up to ``few`` senders reads the edges of these alone.
    """
    if not 0 < reset <= 1:
        raise ValueError("reset must be in (0, 1]")
    if max_iter is not None and max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    if tol is not None and tol <= 0:
        raise ValueError("tol must be positive")
    if push and tol is None:
        raise ValueError("push needs tol")
    if tol is None and max_iter is None:
        max_iter = 10

    dense = _dense(graph, scratch)
    if dense is not None:
        return _scaled(graph, _on_arrays(dense, graph, hot_rows, reset, max_iter, tol, push, few), reset)
    spark = graph.edges.sparkSession
    partitions = graph.partitions
    with shuffle_partitions(spark, partitions):
        edges = _weighted_edges(graph, scratch, hot_rows, partitions)
        inner = edges
        try:
            if push:
                state = _by_push(edges, scratch, reset, tol, max_iter, few)
            else:
                first = _round(edges, None, reset, F.count(F.lit(1)).alias("n"))
                first, seen = scratch.save_observed(first, "rank-1", n=F.count(F.lit(1)))
                if graph.n_edges >= LEAVES_FROM:
                    inner = _without_leaves(edges, first, graph, hot_rows)
                first = first.select("v", "rank")
                if tol is None:
                    state = _fixed_rounds(edges, inner, first, scratch, reset, max_iter)
                else:
                    all_in_state = seen["n"] == graph.n_vertices
                    state = _until_stable(edges, inner, first, scratch, reset, tol, all_in_state, max_iter)
        finally:
            edges.release()
            if inner is not edges:
                inner.release()

    return _scaled(graph, state, reset)


def _scaled(graph: IndexedGraph, state: DataFrame, reset: float) -> DataFrame:
    # Vertices without in-edges are not in the state: their rank is ``reset``.
    total, n_state = state.agg(F.sum("rank"), F.count(F.lit(1))).first()
    total = (total or 0.0) + reset * (graph.n_vertices - n_state)
    scale = F.lit(graph.n_vertices / total)
    return graph.vertices.join(state, "v", "left").select(
        "id", (F.coalesce("rank", F.lit(reset)) * scale).alias("rank")
    )


def _weighted_edges(
    graph: IndexedGraph, scratch: Scratch, hot_rows: int, partitions: int
) -> RoundTable:
    """Edges ``(s, d, w)`` by source, ``w`` the share of its rank an edge carries."""
    sources = graph.edges.groupBy("s").agg(F.sum("m").alias("out"))
    hot = find_hot(graph.edges, "s", graph.n_edges, hot_rows)
    keys = ["s"] if hot is None else ["s", SLICE]
    # Dealt before the join, whose output then lies where the rounds need it.  Without
    # hot keys the buckets of the table are the partitions.
    dealt = graph.edges
    if hot is not None:
        dealt = slice_rows(dealt, "s", hot, "d")
    if hot is not None or not graph.bucketed:
        dealt = dealt.repartition(partitions, *keys)
    weighted = dealt.join(
        slice_table(sources, "s", hot), keys
    ).select(*keys, "d", (F.col("m") / F.col("out")).alias("w"))
    return RoundTable.of(weighted, "s", hot, partitions, dealt=True)


def _without_leaves(edges: RoundTable, first: DataFrame, graph: IndexedGraph, hot_rows: int) -> RoundTable:
    """Edges to vertices that have out-edges, where these are the smaller part.

    ``first`` has the in-degree ``n`` of every vertex with in-edges.  The ranks of these
    vertices follow from these edges alone.  A graph with a source of more than
    ``hot_rows`` edges stays whole.
    """
    if edges.hot is not None:
        return edges
    sources = graph.edges.select(F.col("s").alias("v")).distinct()
    n_inner = first.join(sources, "v", "left_semi").agg(F.sum("n")).first()[0] or 0
    if 2 * n_inner > graph.n_edges:
        return edges
    hot = hottest(first.select("v", "n"), "v", hot_rows)
    inner = lookup_join(edges.rows, "d", sources, "v", hot, "s", "left_semi", n_keys=graph.n_vertices)
    return RoundTable.of(inner.select("s", "d", "w"), "s", None, edges.partitions)


def _round(edges: RoundTable, state: DataFrame | None, reset: float, *more: Column) -> DataFrame:
    """Next state ``(v, rank)``, for the vertices with in-edges only.

    The first round needs no join since all ranks are 1.  Later a source that is
    missing from the state has no in-edges, hence the constant rank ``reset``.
    """
    if state is None:
        sent = edges.rows.select("d", "w")
    else:
        senders = state.select(F.col("v").alias("s"), "rank")
        sent = edges.join(senders, "left").select(
            "d", (F.col("w") * F.coalesce("rank", F.lit(reset))).alias("w")
        )
    return sent.groupBy(F.col("d").alias("v")).agg(_rank("w", reset).alias("rank"), *more)


def _rank(received: str, reset: float) -> Column:
    return F.lit(reset) + F.lit(1 - reset) * F.sum(received)


def _fixed_rounds(
    edges: RoundTable, inner: RoundTable, first: DataFrame, scratch: Scratch, reset: float, rounds: int
) -> DataFrame:
    """State after all rounds, of which ``first`` is the first; the last goes over all edges."""
    state = saved = first
    for i in range(2, rounds + 1):
        state = _round(inner if i < rounds else edges, state, reset)
        if i % ROUNDS_PER_SAVE == 0 or i == rounds:
            state = scratch.save(state, f"rank-{i}")
            scratch.drop(saved)
            saved = state
    return state


def _until_stable(
    edges: RoundTable,
    inner: RoundTable,
    first: DataFrame,
    scratch: Scratch,
    reset: float,
    tol: float,
    all_in_state: bool,
    max_iter: int | None,
) -> DataFrame:
    """State of the first round in which no rank moved by more than ``tol``.

    A sum of doubles depends on the order of its parts, of which there is one per
    partition, so a rank may move by its rounding for ever, which does not count.
    """
    rounding = ROUNDING * edges.partitions

    def moved_by(rank: str, before: Column) -> Column:
        by = F.abs(F.col(rank) - before)
        return F.when(by <= rounding * F.col(rank), 0.0).otherwise(by)

    # Also vertices without in-edges move in the first round.
    state, before = first, None
    moved = state.agg(F.max(moved_by("rank", F.lit(1.0)))).first()[0] or 0.0
    moved = max(moved, 0.0 if all_in_state else 1 - reset)
    i = 1
    while moved > tol:
        if max_iter is not None and i >= max_iter:
            raise NotStableError(f"ranks still move by {moved} after {i} rounds")
        i += 1
        following = (
            _round(inner, state, reset)
            .join(state.withColumnRenamed("rank", "before"), "v")
            .select("v", "rank", moved_by("rank", F.col("before")).alias("moved"))
        )
        following, seen = scratch.save_observed(following, f"rank-{i}", moved=F.max("moved"))
        moved = seen["moved"] or 0.0
        if inner is not edges and moved <= tol:
            # What leaves move by follows from the two states before.
            whole = _two_rounds(edges, state, before, reset)
            whole = whole.select("v", "rank", moved_by("rank", F.col("before")).alias("moved"))
            whole, seen = scratch.save_observed(whole, f"whole-{i}", moved=F.max("moved"))
            moved = seen["moved"] or 0.0
            if moved <= tol:
                return whole.select("v", "rank")
            scratch.drop(whole)
        scratch.drop(before)
        state, before = following.select("v", "rank"), state
        state._scratch_path = following._scratch_path
    return state


def _two_rounds(edges: RoundTable, state: DataFrame, before: DataFrame | None, reset: float) -> DataFrame:
    """Ranks ``(v, rank, before)`` that follow from a state and from the one before,
    which is 1 for all vertices if there is none."""
    states = state.select(F.col("v").alias("s"), "rank")
    if before is None:
        earlier = F.lit(1.0)
    else:
        states = states.join(before.select(F.col("v").alias("s"), F.col("rank").alias("before")), "s", "left")
        earlier = F.coalesce("before", F.lit(reset))
    sent = edges.join(states, "left").select(
        "d", (F.col("w") * F.coalesce("rank", F.lit(reset))).alias("now"), (F.col("w") * earlier).alias("earlier")
    )
    return sent.groupBy(F.col("d").alias("v")).agg(_rank("now", reset).alias("rank"), _rank("earlier", reset).alias("before"))


def _by_push(
    edges: RoundTable,
    scratch: Scratch,
    reset: float,
    tol: float,
    max_iter: int | None,
    few: int,
    first: DataFrame | None = None,
    i: int = 1,
) -> DataFrame:
    """State ``(v, rank)`` of the vertices with in-edges, once no residual exceeds ``tol``.

    All start at the rank ``reset``, which is final for vertices without in-edges, or go on
    from what ``first`` has after ``i`` rounds.
    """
    if first is None:
        got = F.lit((1 - reset) * reset) * F.sum("w")
        first = edges.rows.groupBy(F.col("d").alias("v")).agg(got.alias("residual"))
        first = first.select("v", F.lit(reset).alias("rank"), "residual")
    state = KeyedState(first, "v", scratch, "ranks", few)
    above = F.col("residual") > tol
    touched = state.base
    n_senders = touched.where(above).count()
    try:
        while n_senders:
            if max_iter is not None and i >= max_iter:
                raise NotStableError(f"{n_senders} ranks still move after {i} rounds")
            i += 1
            # Untouched vertices have passed on what exceeded the tolerance before.
            senders = touched.where(above).select("v", "residual")
            moved = _pushed(edges, senders, n_senders, reset, few)
            if not state.few_of(n_senders):
                n_senders = state.replace(_moved(state.all().join(moved, "v", "left")), senders=F.count_if(above))["senders"]
                touched = state.base
                continue
            moved, n_moved = scratch.save_counted(moved, "moved")
            touched, seen = scratch.save_observed(
                _moved(state.at(moved, n_moved)), "touched", n=F.count(F.lit(1)), senders=F.count_if(above)
            )
            n_senders = seen["senders"]
            state.put(touched, seen["n"])
            scratch.drop(moved)
        rest = (F.col("rank") + F.col("residual")).alias("rank")
        return scratch.save(state.all().select("v", rest), "pushed-ranks")
    finally:
        state.release()


def _moved(state: DataFrame) -> DataFrame:
    """State after what a push changes, which stands beside it."""
    return state.select(
        "v",
        (F.col("rank") + F.coalesce("gained", F.lit(0.0))).alias("rank"),
        (F.col("residual") + F.coalesce("more", F.lit(0.0))).alias("residual"),
    )


def _pushed(
    edges: RoundTable, senders: DataFrame, n_senders: int, reset: float, few: int
) -> DataFrame:
    """What a push changes, ``(v, gained, more)``: rank gained, change of the residual."""
    states = senders.select(F.col("v").alias("s"), "residual")
    if n_senders <= few:
        sent = meet_few(edges.rows, "s", states, n_senders)
    else:
        sent = edges.join(states)
    got = sent.groupBy(F.col("d").alias("v")).agg(
        (F.lit(1 - reset) * F.sum(F.col("w") * F.col("residual"))).alias("more")
    )
    own = senders.select("v", F.col("residual").alias("gained"), (-F.col("residual")).alias("more"))
    both = own.unionByName(got.select("v", F.lit(0.0).alias("gained"), "more"))
    return both.groupBy("v").agg(F.sum("gained").alias("gained"), F.sum("more").alias("more"))


# -- rounds over arrays -----------------------------------------------------


def _dense(graph: IndexedGraph, scratch: Scratch) -> DenseGraph | None:
    if graph.n_edges < arrays.DENSE_FROM:
        return None
    layout = Layout.of(graph.vertices, graph.n_edges)
    return DenseGraph(layout, scratch) if DenseGraph.fits(layout, graph.edges, "s") else None


def _on_arrays(
    dense: DenseGraph,
    graph: IndexedGraph,
    hot_rows: int,
    reset: float,
    max_iter: int | None,
    tol: float | None,
    push: bool,
    few: int,
) -> DataFrame:
    """Saved ranks ``(v, rank)`` of all vertices."""
    scratch = dense.scratch
    blocks = dense.lay_out(graph.edges, "s", "d", "rank-blocks")
    state, _ = dense.states(graph.vertices.select("v"), _first(reset, push), ARRAYS, "rank-0")
    send, receive = (_send_residuals(tol), _receive_residuals(reset, tol)) if push else (_send_ranks, _receive_ranks(reset, ROUNDING * graph.partitions))
    i = tail = 0
    try:
        while True:
            i += 1
            first = push and i == 1
            following, seen = dense.round(
                [(blocks, _send_residuals(0.0) if first else send)],
                state,
                _receive_residuals(reset, tol, 0.0) if first else receive,
                ARRAYS,
                f"rank-{i}",
                moved=F.max("moved"),
                senders=F.sum("senders"),
            )
            scratch.drop(state)
            state = following
            if tol is None:
                if i >= max_iter:
                    break
                continue
            if not (seen["senders"] if push else seen["moved"] > tol):
                break
            if max_iter is not None and i >= max_iter:
                still = f"{seen['senders']} ranks still move" if push else f"ranks still move by {seen['moved']}"
                raise NotStableError(f"{still} after {i} rounds")
            tail += push and seen["senders"] <= few
            if tail > TAIL_ROUNDS:
                return _rest_by_push(dense, state, graph, hot_rows, reset, tol, max_iter, few, i)
        return scratch.save(dense.rows(state, _ranks(dense.layout, push), "v long, rank double"), "ranks")
    finally:
        scratch.drop(state)
        dense.release()


def _rest_by_push(
    dense: DenseGraph,
    state: DataFrame,
    graph: IndexedGraph,
    hot_rows: int,
    reset: float,
    tol: float,
    max_iter: int | None,
    few: int,
    i: int,
) -> DataFrame:
    first = dense.rows(state, _residuals(dense.layout), "v long, rank double, residual double")
    with shuffle_partitions(graph.edges.sparkSession, graph.partitions):
        edges = _weighted_edges(graph, dense.scratch, hot_rows, graph.partitions)
        try:
            return _by_push(edges, dense.scratch, reset, tol, max_iter, few, first, i)
        finally:
            edges.release()


def _first(reset: float, push: bool) -> Callable:
    """Ranks of 1, or by push of 0 with a residual of ``reset``, which all send first."""

    def first(key: int, places: np.ndarray) -> list:
        exists = np.zeros(places.max() + 1, dtype=bool)
        exists[places] = True
        rank, residual = (0.0 * exists, reset * exists) if push else (1.0 * exists, np.zeros(0))
        return [key, exists.tobytes(), rank.tobytes(), residual.tobytes(), None, None]

    return first


def _send_ranks(key: int, blocks: pa.Table, state: pa.Table) -> pa.Table:
    return messages(key, blocks, _shares(blocks, array_of(state, "rank")), True, 0.0)


def _send_residuals(tol: float) -> Callable:
    def send(key: int, blocks: pa.Table, state: pa.Table) -> pa.Table:
        residual = array_of(state, "residual")
        return messages(key, blocks, _shares(blocks, np.where(residual > tol, residual, 0.0)), True, 0.0)

    return send


def _shares(blocks: pa.Table, sent: np.ndarray) -> np.ndarray:
    """What each place sends along one of its edges."""
    out = out_of(blocks, len(sent))
    return np.divide(sent, out, out=np.zeros(len(sent)), where=out > 0)


def _receive_ranks(reset: float, rounding: float) -> Callable:
    def receive(key: int, sent: pa.Table, state: pa.Table) -> pa.Table:
        before, exists = array_of(state, "rank"), array_of(state, "exists", "?")
        rank = exists * (reset + (1 - reset) * received(sent, len(before), True, 0.0))
        by = np.abs(rank - before)
        moved = float(by[by > rounding * rank].max(initial=0.0))
        return rows_of(ARRAYS, [[key], [exists.tobytes()], [rank.tobytes()], [b""], [moved], [0]])

    return receive


def _receive_residuals(reset: float, tol: float, above: float | None = None) -> Callable:
    """Next state where residuals above ``above``, or else ``tol``, were sent."""
    above = tol if above is None else above

    def receive(key: int, sent: pa.Table, state: pa.Table) -> pa.Table:
        rank, residual = array_of(state, "rank"), array_of(state, "residual")
        gone = np.where(residual > above, residual, 0.0)
        rank = rank + gone
        residual = residual - gone + (1 - reset) * received(sent, len(rank), True, 0.0)
        exists = state["exists"][0].as_py()
        return rows_of(ARRAYS, [[key], [exists], [rank.tobytes()], [residual.tobytes()], [0.0], [int((residual > tol).sum())]])

    return receive


def _ranks(layout: Layout, push: bool) -> Callable:
    def ranks(key: int, state: pa.Table) -> list:
        rank = array_of(state, "rank") + (array_of(state, "residual") if push else 0.0)
        at = np.flatnonzero(array_of(state, "exists", "?"))
        return [layout.vertices(key, at), rank[at]]

    return ranks


def _residuals(layout: Layout) -> Callable:
    def residuals(key: int, state: pa.Table) -> list:
        at = np.flatnonzero(array_of(state, "exists", "?"))
        return [layout.vertices(key, at), array_of(state, "rank")[at], array_of(state, "residual")[at]]

    return residuals
