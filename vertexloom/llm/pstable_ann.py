"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell of a grid in a few random directions drawn
from the normal, a 2-stable distribution.  A query visits, besides its own cell, the
cells reached by moving one step in some directions, those first that are most
likely to hold a near vector: the estimate is the sum of the squared distances
to the cell walls crossed.  All candidates of all tables are ranked by their exact
inner product.

Inner products become distances by one more coordinate that fills every vector up
to the largest norm.  How many cells to visit is fitted on a bounded sample, where
neighbours are farther away than among all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import sampled
from vertexloom.llm.vectors import group_count, matrix, usable
from vertexloom.operators.scratch import Scratch

TABLES = 4
DIRECTIONS = 6
CELL = 2.0  # width of a cell, in units of the largest norm
SAMPLE_ROWS = 4_000  # fitted on about so many rows
SAMPLE_QUERIES = 200
AIM = 0.97  # recall aimed at on the sample
BLOCK = 2_000  # rows of a bucket, and queries, in one product
QUERIES = 20_000  # queries in one task call, about
VISITS = 1_000_000  # buckets they visit there, about
HELD_ROWS = 1_000_000  # pairs found that a task call holds before it cuts them to the best of each query


@dataclass(frozen=True)
class Grid:
    """Directions and offsets of all tables for vectors of one length."""

    seed: int
    top_norm: float
    tables: int = TABLES
    directions: int = DIRECTIONS
    cell: float = CELL

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Positions ``(rows, tables, directions)`` in units of a cell."""
        rng = np.random.default_rng([self.seed, x.shape[1]])
        a = rng.normal(size=(self.tables, x.shape[1] + 1, self.directions))
        b = rng.random((self.tables, 1, self.directions))
        fill = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top_norm**2 - (x**2).sum(1)))
        if query:  # only the direction of a query matters
            x = x * (self.top_norm / np.sqrt((x**2).sum(1)))[:, None]
        full = np.column_stack([x, fill])
        return np.moveaxis(full @ a / (self.cell * self.top_norm) + b, 0, 1)

    def keys(self, cells: np.ndarray, length: int) -> np.ndarray:
        """64-bit names of cells ``(..., tables, directions)``."""
        from vertexloom.llm.common import mix64

        with np.errstate(over="ignore"):
            out = np.broadcast_to(np.arange(self.tables, dtype=np.uint64) + np.uint64(1000 * length), cells.shape[:-1])
            for k in range(self.directions):
                out = mix64(out + cells[..., k].astype(np.int64).astype(np.uint64))
        return out.view(np.int64)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Names of the first ``count`` cells of each query, ``(rows, tables, count)``."""
        at = self.project(x, True)
        cell = np.floor(at)
        low = at - cell
        steps = np.array(list(product((0, -1, 1), repeat=self.directions)))
        cost = np.einsum("rtk,sk->rts", low**2, (steps == -1).astype(float)) + np.einsum("rtk,sk->rts", (1 - low) ** 2, (steps == 1).astype(float))
        count = min(count, len(steps))
        first = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        cells = cell[:, :, None, :] + steps[first]
        return self.keys(np.moveaxis(cells, 1, 2), x.shape[1]).transpose(0, 2, 1)


def _fit_probes(grid: Grid, x: np.ndarray, k: int, aim: float) -> int:
    """Fewest cells per table with which the sample's queries find ``aim`` of their neighbours."""
    most = 3**grid.directions
    if len(x) < 2:
        return most
    q = x[:SAMPLE_QUERIES]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argsort(-scores, axis=1)[:, :k]
    own = grid.keys(np.floor(grid.project(x, False)), x.shape[1])  # (rows, tables)
    rank = np.full((len(q), k), most + 1)
    probes = grid.probes(q, most)
    for i in range(len(q)):
        for t in range(grid.tables):
            place = {name: r for r, name in reversed(list(enumerate(probes[i, t].tolist())))}
            got = [place.get(name, most + 1) for name in own[near[i], t].tolist()]
            rank[i] = np.minimum(rank[i], got)
    wanted = int(np.ceil(aim * rank.size)) - 1
    return int(min(most, np.sort(rank, axis=None)[wanted] + 1))


def nearest(
    rows: DataFrame,
    scratch: Scratch,
    is_query,
    k: int = 20,
    seed: int = 11,
    aim: float = AIM,
    tables: int = TABLES,
    directions: int = DIRECTIONS,
    cell: float = CELL,
    block: int = BLOCK,
    queries_at_once: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from ``rows(vec_id, v)``.

    ``is_query`` is a condition on ``vec_id``.  Nearest first, ties to the smaller
    id; a query is no candidate of its own, so rows that share its id are not
    either.  Rows without an id or with a vector that is null, empty, zero or not
    finite take no part, and vectors of different length are no candidates of
    each other.  A query that finds fewer than ``k`` is compared with all rows.
    """
    rows = scratch.save(rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("v").cast("array<double>").alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    counts = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).collect()  # a row per vector length
    n = sum(r["n"] for r in counts)
    schema = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    grids, probes = {}, {}
    for r in counts:
        grid = Grid(seed, float(np.sqrt(r["top"])), tables, directions, cell)
        part = rows.where((F.size("v") == r["length"]) & sampled(F.col("vec_id"), r["n"], SAMPLE_ROWS))
        sample = part.orderBy(F.xxhash64("vec_id")).toPandas()  # about SAMPLE_ROWS
        grids[r["length"]] = grid
        probes[r["length"]] = _fit_probes(grid, matrix(sample["v"]), k, aim) if len(sample) else 3**directions

    def place(batches):
        import pandas as pd

        for batch in batches:
            for length, part in batch.groupby(batch["v"].map(len)):
                grid = grids[length]
                names = grid.keys(np.floor(grid.project(matrix(part["v"]), False)), length)
                for t in range(grid.tables):
                    yield pd.DataFrame({"t": t, "key": names[:, t], "vec_id": part["vec_id"], "v": part["v"]})

    def visit(batches):
        import pandas as pd

        for batch in batches:
            for length, part in batch.groupby(batch["v"].map(len)):
                for lo in range(0, len(part), 256):
                    some = part.iloc[lo : lo + 256]
                    names = grids[length].probes(matrix(some["v"]), probes[length])
                    per = names.shape[1] * names.shape[2]
                    yield pd.DataFrame({"query_id": np.repeat(some["vec_id"].to_numpy(), per), "length": length, "t": np.tile(np.repeat(np.arange(names.shape[1]), names.shape[2]), len(some)), "key": names.reshape(-1)})

    placed = scratch.save(rows.mapInPandas(place, "t int, key long, vec_id long, v array<double>"), "placed")
    sizes = placed.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.first(F.size("v")).alias("length"))
    sizes = scratch.save(sizes, "sizes")
    groups = group_count(n * tables)
    group = F.pmod(F.xxhash64("t", "key", "block"), F.lit(groups)).cast("int")
    candidates = placed.join(sizes, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    candidates = scratch.save(candidates.select("t", "key", "vec_id", "v", group.alias("g")), "candidates")
    queries = rows.where(is_query)
    visits = queries.mapInPandas(visit, "query_id long, length int, t int, key long").join(sizes.drop("length"), ["t", "key"])
    found = scratch.save(_meet(candidates, queries, visits, group, k, scratch, block, queries_at_once), "found")
    best = _top(found, k)

    few = queries.select(F.col("vec_id").alias("query_id"), F.size("v").alias("length")).distinct()
    wanted = F.lit(None)
    for r in counts:
        wanted = F.when(F.col("length") == r["length"], F.lit(min(k, r["n"] - 1))).otherwise(wanted)
    few = few.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < wanted)
    few = scratch.save(few.select("query_id", "length"), "few")
    if few.isEmpty():
        return best
    # Every row is in a cell of table 0, so visiting all its cells is a full search.
    visits = few.join(sizes.where("t = 0"), "length").select("query_id", "t", "key", "blocks")
    more = _meet(candidates, queries, visits, group, k, scratch, block, queries_at_once)
    return _top(found.unionByName(more), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _deal(candidates: DataFrame, queries: DataFrame, visits: DataFrame, group, scratch: Scratch, queries_at_once: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and asking queries by ``g`` and ``part``.

    A group with more than ``queries_at_once`` queries or ``VISITS`` visits is dealt into
    parts by query, and its candidates are copied once for each.
    """
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = scratch.save(visits.groupBy("query_id", group.alias("g")).agg(F.collect_set("key").alias("keys")), "visits")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / queries_at_once, F.sum(F.size("keys")) / VISITS)).cast("int")
    parts = scratch.save(visits.groupBy("g").agg(parts.alias("parts")), "parts")  # a row per group
    asked = visits.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"]), "query_id")
    copies = candidates.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return copies, asked


def _meet(candidates: DataFrame, queries: DataFrame, visits: DataFrame, group, k: int, scratch: Scratch, block: int = BLOCK, queries_at_once: int = QUERIES) -> DataFrame:
    """Best ``k`` of each query within each part of a group of buckets, by exact score."""
    candidates, asked = _deal(candidates, queries, visits, group, scratch, queries_at_once)

    def best(out):
        import pandas as pd

        found = pd.DataFrame({c: np.concatenate(v) for c, v in zip(["query_id", "vec_id", "score"], zip(*out))}).drop_duplicates(["query_id", "vec_id"])
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    def rank(left, right):
        import pandas as pd

        names = ["query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        asking: dict[int, list[int]] = {}
        for i, keys in enumerate(right["keys"]):
            for key in keys:
                asking.setdefault(key, []).append(i)
        ids, asked_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        out, held = [], 0
        for key, at in left.groupby("key").indices.items():
            asks = np.array(asking.get(key, []), int)
            x = matrix(left["v"].iloc[at])
            for lo in range(0, len(asks), block):
                of = asks[lo : lo + block]
                q = matrix(right["q"].iloc[of])
                if x.shape[1] != q.shape[1]:
                    continue
                rough = q @ x.T
                rough[asked_ids[of][:, None] == ids[at][None, :]] = -np.inf
                # A little below the k-th rough score, so that rounding and ties are settled exactly.
                last = np.partition(rough, -k, axis=1)[:, -k] if len(at) > k else np.full(len(of), -np.inf)
                i, j = np.nonzero((rough >= (last - 1e-9 * np.abs(last).clip(1))[:, None]) & np.isfinite(rough))
                out.append((asked_ids[of][i], ids[at][j], (q[i] * x[j]).sum(1)))
                held += len(i)
                if held > HELD_ROWS:
                    some = best(out)
                    out, held = [tuple(some[c].to_numpy() for c in names)], 0
        if not out:
            return pd.DataFrame({c: [] for c in names})
        return best(out)

    return candidates.groupBy("g", "part").cogroup(asked.groupBy("g", "part")).applyInPandas(rank, "query_id long, vec_id long, score double")
