"""Connected components, edge direction ignored.

Local contraction: each round every vertex moves to the vertex of smallest
random priority within two hops, and the graph is rebuilt on the vertices moved
to.  Edges shrink geometrically, a star of any size collapses in one round and a
long path in logarithmically many (cf. Lacki, Mirrokni & Wlodarczyk, "Connected
Components at Scale via Local Contractions", 2018).  Label propagation would
need as many rounds as the graph is wide, over all edges each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.index import IndexedGraph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import find_hot, hottest, lookup_join


def connected_components(
    graph: IndexedGraph, scratch: Scratch, hot_rows: int
) -> DataFrame:
    """``(id, component)``, where a component is named by its smallest id."""
    moves = _contract(graph, scratch, hot_rows)
    labels = _compose(moves, scratch, hot_rows)
    if labels is None:
        return graph.vertices.select("id", F.col("id").alias("component"))
    labels = labels.withColumnRenamed("to", "label")
    members = graph.vertices.join(labels, "v", "left").select(
        "v", "id", F.coalesce("label", "v").alias("label")
    )
    members = scratch.save(members, "members")
    scratch.drop(*moves)
    return name_components(members, graph.n_vertices, hot_rows)


def name_components(members: DataFrame, n_rows: int, hot_rows: int) -> DataFrame:
    """``(id, component)`` from ``(v, id, label)``: the smallest id of each label."""
    names = members.groupBy(F.col("label").alias("name_of")).agg(
        F.min("id").alias("component")
    )
    hot = find_hot(members, "label", n_rows, hot_rows)
    return lookup_join(members, "label", names, "name_of", hot, "v", n_keys=n_rows).select(
        "id", "component"
    )


def _priority(vertex: str, turn: int) -> Column:
    """Random order of the vertices, another one each round.

    The hash maps distinct numbers to distinct numbers, so there are no ties.
    """
    return F.xxhash64(F.lit(turn), F.col(vertex))


def _contract(graph: IndexedGraph, scratch: Scratch, hot_rows: int) -> list[DataFrame]:
    """Moves ``(v, to)`` of each round until no edge is left."""
    edges = graph.edges.where("s <> d").select(
        F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")
    )
    edges = scratch.save(edges.distinct(), "contract-0")
    n_edges = edges.count()
    moves: list[DataFrame] = []
    while n_edges:
        turn = len(moves) + 1
        both = edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                    F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
                )
            ).alias("e")
        ).select("e.v", "e.w")
        near = both.groupBy("v").agg(
            F.min_by("w", _priority("w", turn)).alias("w"),
            F.count(F.lit(1)).alias("n"),
        )
        own = _priority("v", turn) < _priority("w", turn)
        near = near.select("v", F.when(own, F.col("v")).otherwise(F.col("w")).alias("near"), "n")
        hot = saved = None
        if 2 * n_edges > hot_rows:
            near = saved = scratch.save(near, f"near-{turn}")
            hot = hottest(near, "v", hot_rows)
        offers = near.select(F.col("v").alias("neighbour"), F.col("near").alias("to"))
        move = (
            lookup_join(both, "w", offers, "neighbour", hot, "v", n_keys=graph.n_vertices)
            .groupBy("v")
            .agg(F.min_by("to", _priority("to", turn)).alias("to"))
        )
        move = scratch.save(move, f"move-{turn}")
        moves.append(move)

        of_a = move.select(F.col("v").alias("old"), F.col("to").alias("x"))
        of_b = move.select(F.col("v").alias("old"), F.col("to").alias("y"))
        rest = lookup_join(edges, "a", of_a, "old", hot, "b", n_keys=graph.n_vertices)
        rest = lookup_join(rest, "b", of_b, "old", hot, "a", n_keys=graph.n_vertices).where("x <> y")
        rest = rest.select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        )
        rest = scratch.save(rest.distinct(), f"contract-{turn}")
        scratch.drop(edges, saved)
        edges, n_edges = rest, rest.count()
    scratch.drop(edges)
    return moves


def _compose(
    moves: list[DataFrame], scratch: Scratch, hot_rows: int
) -> DataFrame | None:
    """Final position ``(v, to)`` of each vertex that ever moved.

    Composed from the last round, the smallest, to the first: the work is the
    sum of the shrinking rounds and not rounds times vertices.
    """
    if not moves:
        return None
    final = moves[-1]
    for move in reversed(moves[:-1]):
        hot = find_hot(move, "to", move.count(), hot_rows)
        onward = final.select(F.col("v").alias("at"), F.col("to").alias("end"))
        final = lookup_join(move, "to", onward, "at", hot, "v", "left").select(
            "v", F.coalesce("end", "to").alias("to")
        )
    return final
