"""Hard negatives by exact integer products of anchor and candidate tiles.

Vectors become integers.  Anchors and candidates are dealt into groups by a hash
of their ids, and every pair of groups is one task call, which multiplies its
two int64 matrices tile by tile with Strassen's recursion.  What a call keeps are
heaps of bounded size that merge with those of other calls: the best rows of an
anchor's own label (its positives), and then, for each positive, the best rows of
other labels whose score lies in the window below the positive's.

Rows with a null id, label, vector or component, or a non-finite component, take no
part.  Of rows that share an id the one with the smallest label, then the smallest
vector, counts.  Vectors shorter than the longest are continued with zeros.  An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.vectors import group_count
from vertexloom.operators.scratch import Scratch

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LEAF = 32  # matrices with a side of so many rows or less are multiplied directly
ANCHOR_GROUP = 2_048  # anchors and candidates of one task call, about
CANDIDATE_GROUP = 8_192
TILE = 2_048  # candidates multiplied at once
EXACT_FLOAT = 2.0**53
EXACT_LONG = 2.0**62
LONG = np.iinfo(np.int64)
NONE = LONG.min  # score of a pair that is out of the question

POSITIVE_SCHEMA = "anchor_id long, positive_id long, positive_score long"
NEGATIVE_SCHEMA = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's seven products.

    Odd sides are padded with a zero row or column.  Sums wrap around modulo 2**64
    like numpy's, so the result is exact wherever the true one fits 64 bits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _direct(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain product; in floating point where all partial sums are exact integers there."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < EXACT_FLOAT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def integers(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of each component, int64, or Python integers if one is too large."""
    scaled = np.zeros((len(vectors), width))
    for row, v in zip(scaled, vectors):
        row[: len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    if not scaled.size or np.abs(scaled).max() < EXACT_LONG:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, one row per anchor.

    Where 64 bits might not do they are computed with Python's integers, and what
    exceeds 64 bits is held at the nearest number that does not.
    """
    if anchors.dtype != object and candidates.dtype != object:
        longest = [np.sqrt((x.astype(float) ** 2).sum(axis=1)).max(initial=0.0) for x in (anchors, candidates)]
        if longest[0] * longest[1] < EXACT_LONG:
            return strassen(anchors, np.ascontiguousarray(candidates.T))
    exact = anchors.astype(object) @ candidates.astype(object).T
    return np.vectorize(lambda x: min(max(int(x), LONG.min + 1), LONG.max), otypes=[np.int64])(exact)


class Heaps:
    """The best ``size`` candidates of each row: highest score, then smallest id."""

    def __init__(self, rows: int, size: int):
        self.size = size
        self.score = np.full((rows, 0), NONE, np.int64)
        self.id = np.zeros((rows, 0), np.int64)

    def merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in a tile of scores; its columns are the candidates ``ids``.

        ``NONE`` marks pairs that are no candidates.
        """
        if score.shape[1] > self.size:
            at = score.shape[1] - self.size
            least = np.partition(score, at, axis=1)[:, at]
            # Everything above the last place, and all that tie for it.
            row, col = np.nonzero((score >= least[:, None]) & (score != NONE))
        else:
            row, col = np.nonzero(score != NONE)
        mine = np.nonzero(self.score != NONE)
        row = np.concatenate([mine[0], row])
        s = np.concatenate([self.score[mine], score[row[len(mine[0]) :], col]])
        i = np.concatenate([self.id[mine], ids[col]])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kept = place < self.size
        self.score = np.full((self.score.shape[0], self.size), NONE, np.int64)
        self.id = np.zeros(self.score.shape, np.int64)
        self.score[row[kept], place[kept]] = s[kept]
        self.id[row[kept], place[kept]] = i[kept]


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores ``s`` with ``low * p <= 100 * s <= high * p``; empty if first > second."""
    p = int(positive_score)
    return max(-(-low * p // 100), LONG.min + 1), min(high * p // 100, LONG.max)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Usable rows ``(vec_id, label, v)``, one per id; the smallest of an id's rows counts."""
    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("v").cast("array<double>"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    least = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return least.select("vec_id", "r.label", "r.v")


def _dealt(rows: DataFrame, groups: int, own: str, others: int, other: str) -> DataFrame:
    """Each row in a group of its own side, once for every group of the other side."""
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    return rows.withColumn(own, group).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _meet(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_rows: int, run, schema: str) -> DataFrame:
    """``run`` on every pair of an anchor group and a candidate group."""
    qs, cs = group_count(n_anchors, ANCHOR_GROUP), group_count(n_rows, CANDIDATE_GROUP)
    left = _dealt(anchors, qs, "__q", cs, "__c").groupBy("__q", "__c")
    right = _dealt(candidates, cs, "__c", qs, "__q").groupBy("__q", "__c")
    return left.cogroup(right).applyInPandas(run, schema)


def _tiles(anchors, candidates) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of all anchors with a tile of candidates, and the tile's ids and labels."""
    width = max(max(map(len, anchors["v"])), max(map(len, candidates["v"])))
    a = integers(list(anchors["v"]), width)
    for at in range(0, len(candidates), TILE):
        tile = candidates.iloc[at : at + TILE]
        c = integers(list(tile["v"]), width)
        yield scores(a, c), tile["vec_id"].to_numpy(np.int64), tile["label"].to_numpy(np.int64)


def _positives(anchors, candidates):
    import pandas as pd

    names = [x.split()[0] for x in POSITIVE_SCHEMA.split(", ")]
    if not len(anchors) or not len(candidates):
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
    ids, labels = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    heaps = Heaps(len(anchors), POSITIVES)
    for score, other, label in _tiles(anchors, candidates):
        alike = (labels[:, None] == label[None]) & (ids[:, None] != other[None])
        heaps.merge(np.where(alike, score, NONE), other)
    row, place = np.nonzero(heaps.score != NONE)
    return pd.DataFrame(dict(zip(names, (ids[row], heaps.id[row, place], heaps.score[row, place]))))


def _negatives(low: int, high: int):
    def run(anchors, candidates):
        import pandas as pd

        names = [x.split()[0] for x in NEGATIVE_SCHEMA.split(", ")]
        if not len(anchors) or not len(candidates):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        # One heap per anchor and positive; `owner` is the anchor's row.
        lists = [list(x) for x in anchors["positives"]]
        owner = np.repeat(np.arange(len(anchors)), [len(x) for x in lists])
        positives = [(int(p["positive_id"]), int(p["positive_score"])) for x in lists for p in x]
        windows = [window(score, low, high) for _, score in positives]
        lo = np.array([w[0] for w in windows], np.int64)[:, None]
        hi = np.array([w[1] for w in windows], np.int64)[:, None]
        labels = anchors["label"].to_numpy(np.int64)
        heaps = Heaps(len(owner), NEGATIVES)
        for score, other, label in _tiles(anchors, candidates):
            wide = score[owner]
            fits = (labels[owner][:, None] != label[None]) & (wide >= lo) & (wide <= hi)
            heaps.merge(np.where(fits, wide, NONE), other)
        row, place = np.nonzero(heaps.score != NONE)
        positive = np.array(positives, np.int64).reshape(-1, 2)[row]
        ids = anchors["vec_id"].to_numpy(np.int64)[owner[row]]
        columns = (ids, positive[:, 0], positive[:, 1], heaps.id[row, place], heaps.score[row, place])
        return pd.DataFrame(dict(zip(names, columns)))

    return run


def _best(found: DataFrame, keys: list[str], score: str, row_id: str, size: int) -> DataFrame:
    """Merge heaps: the first ``size`` rows of each key, with their ``rank``."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc(score), row_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(
    rows: DataFrame, scratch: Scratch, anchor: Column, low: int = 30, high: int = 90
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has ``(vec_id, label, v)`` and ``anchor`` chooses the anchors among them.
    A negative's score is ``low`` to ``high`` per cent of its positive's.
    """
    usable = scratch.save(labelled_rows(rows), "labelled")
    anchors = usable.where(anchor)
    n_rows, n_anchors = usable.count(), anchors.count()
    met = _meet(anchors, usable, n_anchors, n_rows, _positives, POSITIVE_SCHEMA)
    best = _best(met, ["anchor_id"], "positive_score", "positive_id", POSITIVES)
    # At most POSITIVES entries per anchor.
    lists = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = scratch.save(anchors.join(lists, anchors["vec_id"] == lists["anchor_id"]).drop("anchor_id"), "asking")
    met = _meet(asking, usable, n_anchors, n_rows, _negatives(low, high), NEGATIVE_SCHEMA)
    best = _best(met, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
