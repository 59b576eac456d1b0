"""Pairs of close vectors by spherical-cap filters (Becker, Ducas, Gama & Laarhoven, 2016).

Filters are directions on the sphere, and a vector belongs to those that point
within a cap around it.  The directions are a random product code: blocks of
coordinates have a codebook each, and every choice of one codeword per block is a
filter.  A vector's filters are decoded block by block, dropping beginnings that
cannot reach the bound any more, without looking at all filters.  Close vectors share filters with
near certainty and others rarely; pairs within a filter are verified exactly.

The height of the caps and the size of the code follow the number of vectors, so
that a filter holds about ``FILTER_ROWS`` unrelated vectors and a pair at the
threshold is missed once in ``1 / MISS`` cases, whatever the size of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.vectors import group_count, matrix, usable
from vertexloom.operators.components import connected_components
from vertexloom.operators.index import index_graph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import HOT_ROWS

THRESHOLD = 0.9
FILTER_ROWS = 200
SHARED = 1.5  # by one code
MISS = 0.01  # share of pairs at the threshold that may share no filter
TRIALS = 1_000  # random pairs on which that is measured
CODEBOOK = 512  # codewords of a block at most; beyond it another block is added
BLOCK = 1_000  # members of a filter that are compared in one task call with so many others


@dataclass(frozen=True)
class CapCode:
    """Random product codes for vectors of ``length`` coordinates.

    One code misses a close pair more often than independent filters would, as its
    filters share codewords; ``rounds`` codes of their own rotation make up for it.
    """

    length: int
    blocks: int
    codewords: int
    bound: float
    seed: int
    rounds: int = 1

    @classmethod
    def of(cls, length: int, n: int, threshold: float, seed: int, filter_rows: int = FILTER_ROWS, shared: float = SHARED, miss: float = MISS) -> CapCode:
        share = min(0.5, filter_rows / max(n, 1))  # of unrelated vectors in one cap
        inner = np.linspace(-1, 1, 20_001)[1:-1]
        density = (1 - inner**2) ** ((length - 3) / 2)
        above = np.cumsum(density[::-1])[::-1] / density.sum()
        height = float(inner[np.argmax(above <= share)]) if length > 1 else 0.0
        # Pairs at the threshold and how often both are in a cap that holds the first.
        rng = np.random.default_rng([seed, length])
        x = rng.normal(size=(TRIALS, length))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = rng.normal(size=x.shape)
        if length > 1:
            y -= (y * x).sum(1)[:, None] * x
            y /= np.linalg.norm(y, axis=1)[:, None]
            y = threshold * x + math.sqrt(1 - threshold**2) * y
        else:
            y = x
        inside = inner >= height
        weight = density[inside] / density[inside].sum()
        t = rng.choice(inner[inside], size=20_000, p=weight)
        side = rng.choice(inner, size=20_000, p=density / density.sum())
        also = float((threshold * t + np.sqrt((1 - threshold**2) * (1 - t**2)) * side >= height).mean())
        filters = shared / (share * max(also, 0.01))
        blocks = 1
        while blocks < length and filters ** (1 / blocks) > CODEBOOK:
            blocks += 1
        blocks = min(max(blocks, 2), length)
        code = cls(length, blocks, math.ceil(filters ** (1 / blocks)), height, seed)
        books = code.books()
        pairs = zip(code.decode(x, books), code.decode(y, books))
        missed = sum(not len(np.intersect1d(a, b)) for a, b in pairs) / TRIALS
        rounds = 1 if missed == 0 else math.ceil(math.log(miss) / math.log(min(missed, 0.98)))
        return cls(length, blocks, code.codewords, height, seed, max(1, rounds))

    def books(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """For each round a random rotation, and codewords for the coordinates of each block."""
        rng, out = np.random.default_rng([self.seed, self.length, 1]), []
        for _ in range(self.rounds):
            rotation, _ = np.linalg.qr(rng.normal(size=(self.length, self.length)))
            books = []
            for part in np.array_split(np.arange(self.length), self.blocks):
                words = rng.normal(size=(self.codewords, len(part)))
                # Every block of a filter has its share of the unit length.
                words *= (math.sqrt(len(part) / self.length) / np.linalg.norm(words, axis=1))[:, None]
                books.append(words)
            out.append((rotation, books))
        return out

    def decode(self, unit: np.ndarray, books) -> list[np.ndarray]:
        """Sorted numbers of the filters of each unit vector."""
        found: list[list[np.ndarray]] = [[] for _ in unit]
        for turn, (rotation, words) in enumerate(books):
            x = unit @ rotation
            parts = np.split(x, np.cumsum([w.shape[1] for w in words])[:-1], axis=1)
            scores = [p @ w.T for p, w in zip(parts, words)]
            rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]  # best of block b and all after it
            for i in range(len(x)):
                total, number = np.zeros(1), np.full(1, turn, np.int64)
                for b, s in enumerate(scores):
                    after = rest[b + 1][i] if b + 1 < len(scores) else 0.0
                    grown = total[:, None] + s[i][None, :]
                    keep, word = np.nonzero(grown >= self.bound - after)
                    total, number = grown[keep, word], number[keep] * self.codewords + word
                found[i].append(np.sort(number))
        return [np.concatenate(f) for f in found]


MET = "node string, other string, n long"


def cosine_links(
    rows: DataFrame,
    scratch: Scratch,
    threshold: float = THRESHOLD,
    seed: int = 5,
    filter_rows: int = FILTER_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``(vec_id, n_links, component_id)``, one row per row of ``rows(vec_id, v)``.

    ``n_links`` counts the other rows within the threshold, ``component_id`` is the
    smallest id reachable over links.  Vectors that are null, empty, zero or not
    finite have no links and are their own component; vectors of different length
    are never linked.  Equal vectors are compared once and counted as often as they
    occur; a row without an id has a null component unless linked to one with an id.
    """
    ok = usable(F.col("v"))
    named = rows.select("vec_id", F.when(ok, F.md5(F.array_join(F.col("v").cast("array<string>"), ","))).alias("node"), F.when(ok, F.col("v")).alias("v"))
    once = named.where("node IS NOT NULL").groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    once = scratch.save(once, "vectors")
    counts = once.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per vector length
    codes = {r["length"]: CapCode.of(r["length"], r["n"], threshold, seed, filter_rows) for r in counts}

    def decode(batches):
        import pandas as pd

        books = {}
        for batch in batches:
            for length, part in batch.groupby(batch["v"].map(len)):
                code = codes[length]
                if length not in books:
                    books[length] = code.books()
                for lo in range(0, len(part), 1024):
                    some = part.iloc[lo : lo + 1024]
                    unit = matrix(some["v"])
                    unit /= np.linalg.norm(unit / np.abs(unit).max(1)[:, None], axis=1)[:, None] * np.abs(unit).max(1)[:, None]
                    yield pd.DataFrame({"node": some["node"], "v": some["v"], "copies": some["copies"], "length": length, "filters": code.decode(unit, books[length])})

    kind = once.schema["v"].dataType.simpleString()
    members = once.select("node", "v", "copies").mapInPandas(decode, f"node string, v {kind}, copies long, length int, filters array<long>")
    members = scratch.save(members, "members")
    listed = members.select("length", F.explode("filters").alias("filter"))
    sizes = listed.groupBy("length", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.select("length", "filter", F.ceil(F.col("size") / block).cast("int").alias("blocks"), "size")
    sizes = scratch.save(sizes, "sizes")
    total = sizes.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    own = members.withColumn("filter", F.explode("filters")).join(sizes, ["length", "filter"])
    own = own.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(
        "node", "v", "copies", "length", "filter", "filters", "mine",
        F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"),
    )
    group = F.pmod(F.xxhash64("length", "filter", "low", "high"), F.lit(group_count(total))).cast("int")

    def compare(part):
        return _compare(part, threshold)

    met = scratch.save(own.withColumn("g", group).groupBy("g").applyInPandas(compare, MET), "met")
    links = met.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    joined = met.where("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    graph = index_graph(once.select(F.col("node").alias("id")), joined, scratch, HOT_ROWS)
    component = connected_components(graph, scratch, HOT_ROWS).withColumnRenamed("id", "node")
    nodes = once.select("node", "copies", "first_id").join(component, "node").join(links, "node", "left")
    nodes = scratch.save(nodes, "nodes")
    least = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        named.select("vec_id", "node")
        .join(nodes, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def _compare(part, threshold: float):
    """Links within the filters of a group.

    Rows ``(node, null, links)`` count a pair in the first filter its vectors share
    only; rows ``(node, other, 0)`` connect linked vectors.
    """
    import pandas as pd

    counted, joined = [], []
    nodes, copies, mine = part["node"].to_numpy(object), part["copies"].to_numpy(), part["mine"].to_numpy()
    filters = part["filters"].to_numpy()
    for (_, number, low, high), at in part.groupby(["length", "filter", "low", "high"]).indices.items():
        x = matrix(part["v"].iloc[at])
        norms = np.sqrt((x * x).sum(1))
        near = (x @ x.T) / (norms[:, None] * norms[None, :]) >= threshold
        np.fill_diagonal(near, False)
        if low != high:  # pairs within a block are met in its own group
            near &= mine[at][:, None] != mine[at][None, :]
        inside = np.flatnonzero(near.any(axis=1))
        if not len(inside):
            continue
        near = near[np.ix_(inside, inside)]
        at = at[inside]
        label = np.arange(len(at))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(at)).min(axis=1))
            if (least == label).all():
                break
            label = least
        other = label != np.arange(len(at))
        joined.append((nodes[at][other], nodes[at][label[other]]))
        earlier = [f[f < number] for f in filters[at]]
        names, column = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(at), len(names)), np.float32)
        held[np.repeat(np.arange(len(at)), [len(e) for e in earlier]), column] = 1
        fresh = near & (held @ held.T == 0)
        counted.append((nodes[at], fresh @ copies[at]))
    frames = [pd.DataFrame({"node": n, "other": None, "n": c}) for n, c in counted]
    frames += [pd.DataFrame({"node": n, "other": o, "n": 0}) for n, o in joined]
    frames = [f for f in frames if len(f)]
    if not frames:
        return pd.DataFrame({"node": [], "other": [], "n": []}).astype({"node": object, "other": object, "n": "int64"})
    out = pd.concat(frames, ignore_index=True)
    links = out[out["other"].isna()].groupby("node", as_index=False)["n"].sum()
    links.insert(1, "other", None)
    out = pd.concat([links, out[out["other"].notna()].drop_duplicates()], ignore_index=True)
    return out.astype({"node": object, "other": object, "n": "int64"})
