"""Strongly connected components.

Each turn trims vertices that lie on no cycle, then gives every vertex the
smallest random priority among those that reach it and among those it reaches.
Where the two agree the vertex lies in the component of that pivot.  All other
components lie inside one pair of values, so edges between different pairs are
cut and the rest goes to the next turn.  Many pivots work at once and the parts
shrink like in a random quicksort (cf. Schudy, "Finding strongly connected
components in parallel using O(log^2 n) reachability queries", 2008).

Trims and labels of many edges go over arrays (``operators/dense.py``), with the same
priorities; labels that have not settled after ``DENSE_ROUNDS`` go on by joins and leaps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators import dense as arrays
from vertexloom.operators.components import name_components
from vertexloom.operators.dense import DenseGraph, Layout, array_of, messages, received, rows_of
from vertexloom.operators.frontier import KeyedState, meet_few
from vertexloom.operators.index import IndexedGraph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import (
    LISTED_KEYS,
    RoundTable,
    find_hot,
    lookup_join,
    partitions_for,
    shuffle_partitions,
    slice_rows,
)

ROUNDS_BEFORE_LEAPS = 6  # graphs of small width are done by then
TRIM_AGAIN_ABOVE = 0.1  # share of the edges a trim must remove to be repeated
DENSE_ROUNDS = 40  # rounds over arrays after which labels leap
NONE = np.iinfo(np.int64).max  # no label; as a priority it would be the last choice anyway
ARRAYS = "k int, p binary, alive binary, f binary, b binary, new_f binary, new_b binary, n_alive long, changed long"


def strongly_connected_components(
    graph: IndexedGraph, scratch: Scratch, hot_rows: int, few: int = LISTED_KEYS
) -> DataFrame:
    """``(id, component)``, where a component is named by its smallest id.

    A round in which at most ``few`` labels changed before reads their links alone.
    """
    edges, n_edges = graph.edges.where("s <> d").select("s", "d"), graph.n_edges
    if n_edges < arrays.DENSE_FROM:
        edges, n_edges = scratch.save_counted(edges, "scc-edges")
    found: list[DataFrame] = []
    turn = 0
    while True:
        dense = _dense(graph, edges, n_edges, scratch)
        if dense is not None:
            turn += 1
            labels, n_labels, n_open = _spread_on_arrays(dense, graph, edges, n_edges, turn, hot_rows, few)
            if not n_labels:
                break
        else:
            edges, n_edges = _trim(edges, n_edges, scratch, hot_rows)
            if not n_edges:
                break
            turn += 1
            labels = _spread(edges, n_edges, turn, scratch, hot_rows, few)
            n_open = None
        resolved = _resolved(labels, 2 * n_edges, hot_rows)
        found.append(scratch.save(resolved, f"resolved-{turn}"))
        if n_open == 0:  # no edge lies between open vertices
            scratch.drop(labels)
            break
        rest = _inner_edges(edges, n_edges, labels, hot_rows)
        rest = scratch.save(rest, f"scc-edges-{turn}")
        scratch.drop(edges, labels)
        edges, n_edges = rest, rest.count()
    scratch.drop(edges)

    if not found:
        return graph.vertices.select("id", F.col("id").alias("component"))
    named = reduce(DataFrame.unionByName, found)
    members = graph.vertices.join(named, "v", "left").select(
        "v", "id", F.coalesce("label", "v").alias("label")
    )
    members = scratch.save(members, "scc-members")
    scratch.drop(*found)
    return name_components(members, graph.n_vertices, hot_rows)


def _trim(
    edges: DataFrame, n_edges: int, scratch: Scratch, hot_rows: int
) -> tuple[DataFrame, int]:
    """Remove edges of vertices that lack in-edges or out-edges.

    One pass takes off the outer layer only, and is repeated while that pays.
    """
    while n_edges:
        heads = edges.select(F.col("d").alias("head")).distinct()
        tails = edges.select(F.col("s").alias("tail")).distinct()
        hot_s = find_hot(edges, "s", n_edges, hot_rows)
        hot_d = find_hot(edges, "d", n_edges, hot_rows)
        kept = lookup_join(edges, "s", heads, "head", hot_s, "d", "left_semi", n_edges)
        kept = lookup_join(kept, "d", tails, "tail", hot_d, "s", "left_semi", n_edges)
        kept = scratch.save(kept, "trimmed")
        scratch.drop(edges)
        before, edges, n_edges = n_edges, kept, kept.count()
        if before - n_edges <= TRIM_AGAIN_ABOVE * before:
            break
    return edges, n_edges


def _priority(vertex: str, turn: int) -> Column:
    """Random order of the vertices, another one each turn, without ties: the
    hash maps distinct numbers to distinct numbers."""
    return F.xxhash64(F.lit(turn), F.col(vertex))


def _spread(
    edges: DataFrame, n_edges: int, turn: int, scratch: Scratch, hot_rows: int, few: int, first: DataFrame | None = None
) -> DataFrame:
    """Labels ``(p, v, f, b)``: priority, vertex, and the smallest priority
    among the vertices that reach it (``f``) and that it reaches (``b``).

    Only vertices whose label improved send it on, and where these are few only
    their links and the labels of their neighbours are read.  If that takes many
    rounds, a label also takes over the label of its own pivot, which multiplies the
    reach each round, so a long path needs logarithmically many rounds.  ``first`` are
    labels to go on from, after rounds enough.
    """
    spark = edges.sparkSession
    partitions = partitions_for(spark, 2 * n_edges)
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(
                    _priority("s", turn).alias("sender"),
                    _priority("d", turn).alias("p"),
                    F.lit(True).alias("forward"),
                    F.col("s").alias("v"),
                ),
                F.struct(
                    _priority("d", turn).alias("sender"),
                    _priority("s", turn).alias("p"),
                    F.lit(False).alias("forward"),
                    F.col("d").alias("v"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    hot = find_hot(ends, "sender", 2 * n_edges, hot_rows)
    rounds = 0 if first is None else ROUNDS_BEFORE_LEAPS
    first = first if first is not None else (
        ends.select(F.col("sender").alias("p"), "v")
        .distinct()
        .select("p", "v", F.col("p").alias("f"), F.col("p").alias("b"), F.lit(True).alias("changed"))
    )
    with shuffle_partitions(spark, partitions):
        links = slice_rows(ends.drop("v"), "sender", hot, "p")
        links = RoundTable.of(links, "sender", hot, partitions)
        labels = KeyedState(first, "p", scratch, "labels", few)
        try:
            _settle(links, labels, scratch, hot_rows, rounds)
            return scratch.save(labels.all(), "settled")
        finally:
            links.release()
            labels.release()


def _settle(links: RoundTable, labels: KeyedState, scratch: Scratch, hot_rows: int, rounds: int) -> None:
    """Exchange labels until none improves, after ``rounds`` rounds."""
    changed, n_changed = labels.base, labels.n_rows
    while n_changed:
        rounds += 1
        leaps = rounds > ROUNDS_BEFORE_LEAPS
        if not labels.few_of(n_changed):
            following = _full_round(links, labels.all(), changed, leaps, labels.n_rows, hot_rows)
            n_changed = labels.replace(following, changed=F.count_if("changed"))["changed"]
            changed = labels.base.where("changed")
            continue
        offers = _offers(links, changed, n_changed, True)
        if leaps:
            for column in ("f", "b"):
                offers = offers.unionByName(_leaps_to(labels.all(), changed, column))
        offers = offers.groupBy("p").agg(F.min("got_f").alias("got_f"), F.min("got_b").alias("got_b"))
        offers, n_offers = scratch.save_counted(offers, "offers")
        better = _improved(labels.at(offers, n_offers)).where("changed")
        old, (changed, n_changed) = offers, scratch.save_counted(better, "better")
        if n_changed:
            labels.put(changed, n_changed)
        scratch.drop(old)


def _offers(links: RoundTable, changed: DataFrame, n_changed: int, few: bool) -> DataFrame:
    """Best values ``(p, got_f, got_b)`` that vertices get from changed neighbours."""
    senders = changed.select(F.col("p").alias("sender"), "f", "b")
    met = meet_few(links.rows, "sender", senders, n_changed) if few else links.join(senders)
    return met.groupBy("p").agg(
        F.min(F.when(F.col("forward"), F.col("f"))).alias("got_f"),
        F.min(F.when(~F.col("forward"), F.col("b"))).alias("got_b"),
    )


def _improved(labels: DataFrame, f: tuple[str, ...] = ("got_f",), b: tuple[str, ...] = ("got_b",)) -> DataFrame:
    """Labels with the best of what they have and what is offered beside it."""
    best_f, best_b = F.least("f", *f), F.least("b", *b)
    return labels.select(
        "p",
        "v",
        best_f.alias("f"),
        best_b.alias("b"),
        ((best_f < F.col("f")) | (best_b < F.col("b"))).alias("changed"),
    )


def _full_round(
    links: RoundTable, labels: DataFrame, changed: DataFrame, leaps: bool, n_labels: int, hot_rows: int
) -> DataFrame:
    """All labels after a round in which many changed before."""
    got = _offers(links, changed, n_labels, False)
    following, f, b = labels.drop("changed").join(got, "p", "left"), ["got_f"], ["got_b"]
    if leaps:
        for column, offered in (("f", f), ("b", b)):
            following = _leap(following, labels, column, n_labels, hot_rows)
            offered.append(f"leap_{column}")
    return _improved(following, tuple(f), tuple(b))


def _leap(
    following: DataFrame, labels: DataFrame, column: str, n_labels: int, hot_rows: int
) -> DataFrame:
    """Add what the pivot of each label had for a label, as ``leap_<column>``."""
    pivots = labels.select(
        F.col("p").alias("pivot"), F.col(column).alias(f"leap_{column}")
    )
    hot = find_hot(labels, column, n_labels, hot_rows)
    return lookup_join(following, column, pivots, "pivot", hot, "p", "left", n_labels)


def _leaps_to(labels: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """Offers to vertices whose pivot is among the few whose label changed."""
    pivots = changed.select(F.col("p").alias("pivot"), F.col(column).alias("leap"))
    met = labels.join(F.broadcast(pivots), (F.col(column) == F.col("pivot")) & (F.col("leap") < F.col(column)))
    none = F.lit(None).cast("long")
    got = {c: (F.col("leap") if c == column else none).alias(f"got_{c}") for c in ("f", "b")}
    return met.select("p", got["f"], got["b"])


def _resolved(labels: DataFrame, n_rows: int, hot_rows: int) -> DataFrame:
    """Vertices ``(v, label)`` whose component is known, named by its pivot."""
    done = labels.where("f = b").select("p", "v", "f")
    pivots = done.where("p = f").select(
        F.col("p").alias("pivot"), F.col("v").alias("label")
    )
    hot = find_hot(done, "f", n_rows, hot_rows)
    return lookup_join(done, "f", pivots, "pivot", hot, "p", n_keys=n_rows).select("v", "label")


def _inner_edges(
    edges: DataFrame, n_edges: int, labels: DataFrame, hot_rows: int
) -> DataFrame:
    """Edges between unresolved vertices that may share a component."""
    open_labels = labels.where("f <> b")
    of_s = open_labels.select(
        F.col("v").alias("old"), F.col("f").alias("fs"), F.col("b").alias("bs")
    )
    of_d = open_labels.select(
        F.col("v").alias("old"), F.col("f").alias("fd"), F.col("b").alias("bd")
    )
    hot_s = find_hot(edges, "s", n_edges, hot_rows)
    hot_d = find_hot(edges, "d", n_edges, hot_rows)
    rest = lookup_join(edges, "s", of_s, "old", hot_s, "d", n_keys=2 * n_edges)
    rest = lookup_join(rest, "d", of_d, "old", hot_d, "s", n_keys=2 * n_edges)
    return rest.where("fs = fd AND bs = bd").select("s", "d")


# -- rounds over arrays -----------------------------------------------------


def _dense(graph: IndexedGraph, edges: DataFrame, n_edges: int, scratch: Scratch) -> DenseGraph | None:
    if n_edges < arrays.DENSE_FROM:
        return None
    layout = Layout.of(graph.vertices, n_edges)
    return DenseGraph(layout, scratch) if DenseGraph.fits(layout, edges, "s", "d") else None


def _spread_on_arrays(
    dense: DenseGraph, graph: IndexedGraph, edges: DataFrame, n_edges: int, turn: int, hot_rows: int, few: int
) -> tuple[DataFrame, int, int | None]:
    """Saved labels as of :func:`_spread` for the vertices that trims leave, how many there
    are, and how many of them have no component yet, if that is known."""
    scratch = dense.scratch
    ones = edges.withColumn("m", F.lit(1))
    blocks = [dense.lay_out(ones, "s", "d", "scc-heads"), dense.lay_out(ones, "d", "s", "scc-tails")]
    state, seen = dense.states(
        graph.vertices.select("v"), _first_labels, ARRAYS, "scc-0", _priority("v", turn).alias("p"), alive=F.sum("n_alive")
    )

    def following(send, receive, name: str) -> dict:
        nonlocal state
        sends = [(table, send(kind)) for kind, table in enumerate(blocks)]
        before = state
        state, seen = dense.round(sends, before, receive, ARRAYS, name, alive=F.sum("n_alive"), changed=F.sum("changed"))
        scratch.drop(before)
        return seen

    try:
        while True:
            before, seen = seen["alive"], following(_send_alive, _receive_alive, "scc-trimmed")
            if before - seen["alive"] <= TRIM_AGAIN_ABOVE * before:
                break
        rounds, changed = 0, seen["alive"]
        while changed and rounds < DENSE_ROUNDS:
            rounds += 1
            changed = following(_send_labels, _receive_labels, f"scc-{rounds}")["changed"]
        kinds = "p long, v long, f long, b long, changed boolean"
        labels, seen = scratch.save_observed(
            dense.rows(state, _label_rows(dense.layout), kinds), "settled", n=F.count(F.lit(1)), open=F.count_if(F.col("f") != F.col("b"))
        )
    finally:
        scratch.drop(state)
        dense.release()
    if not changed:
        return labels, seen["n"], seen["open"]
    left = labels.select(F.col("v").alias("end"))
    for end, other in (("s", "d"), ("d", "s")):
        edges = lookup_join(edges, end, left, "end", find_hot(edges, end, n_edges, hot_rows), other, "left_semi", n_edges)
    settled = _spread(edges, n_edges, turn, scratch, hot_rows, few, labels)
    scratch.drop(labels)
    return settled, seen["n"], None


def _label_state(key: int, p: bytes, alive: np.ndarray, f: np.ndarray, b: np.ndarray, new_f: np.ndarray, new_b: np.ndarray) -> pa.Table:
    row = [key, p, *(x.tobytes() for x in (alive, f, b, new_f, new_b)), int(alive.sum()), int((new_f | new_b).sum())]
    return rows_of(ARRAYS, [[x] for x in row])


def _first_labels(key: int, places: np.ndarray, priorities: np.ndarray) -> list:
    p = np.full(places.max() + 1, NONE)
    p[places] = priorities
    alive = np.zeros(len(p), dtype=bool)
    alive[places] = True
    return [x[0].as_py() for x in _label_state(key, p.tobytes(), alive, p, p, alive, alive).columns]


def _send_alive(kind: int):
    def send(key: int, blocks: pa.Table, state: pa.Table) -> pa.Table:
        return messages(key, blocks, np.where(array_of(state, "alive", "?"), 0, NONE), False, NONE, kind)

    return send


def _receive_alive(key: int, sent: pa.Table, state: pa.Table) -> pa.Table:
    """Vertices that a vertex left leads to and that lead to one stay."""
    alive, p = array_of(state, "alive", "?"), array_of(state, "p", "i8")
    for kind in (0, 1):
        alive = alive & (received(sent, len(p), False, NONE, kind) != NONE)
    return _label_state(key, p.tobytes(), alive, p, p, alive, alive)


def _send_labels(kind: int):
    def send(key: int, blocks: pa.Table, state: pa.Table) -> pa.Table:
        new = array_of(state, "alive", "?") & array_of(state, ("new_f", "new_b")[kind], "?")
        return messages(key, blocks, np.where(new, array_of(state, ("f", "b")[kind], "i8"), NONE), False, NONE, kind)

    return send


def _receive_labels(key: int, sent: pa.Table, state: pa.Table) -> pa.Table:
    alive, found = array_of(state, "alive", "?"), []
    for kind, column in enumerate(("f", "b")):
        before = array_of(state, column, "i8")
        best = np.minimum(before, received(sent, len(alive), False, NONE, kind))
        found.append((np.where(alive, best, before), alive & (best < before)))
    (f, new_f), (b, new_b) = found
    return _label_state(key, state["p"][0].as_py(), alive, f, b, new_f, new_b)


def _label_rows(layout: Layout):
    def rows(key: int, state: pa.Table) -> list:
        at = np.flatnonzero(array_of(state, "alive", "?"))
        p, f, b = (array_of(state, name, "i8")[at] for name in ("p", "f", "b"))
        changed = array_of(state, "new_f", "?")[at] | array_of(state, "new_b", "?")[at]
        return [p, layout.vertices(key, at), f, b, changed]

    return rows
