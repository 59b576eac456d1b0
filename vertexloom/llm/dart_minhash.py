"""Near-duplicate documents by DartMinHash (Christiani, 2020).

Every element of a weighted set owns a strip of the plane: weight upwards, rank
to the right.  Hashed darts hit the strip at places that depend on the element
alone, on average one per unit of area, weight region by weight region (0 to 1, 1
to 2, 2 to 4, ...).  A dart counts if it lies below the element's weight, and
belongs to one of ``k`` coordinates; the earliest dart of each coordinate is the
signature.  Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity.  Ranks are thrown up to a limit of about ``k log k`` darts per
set, so a long text costs one hash an element and not ``k``.

Signatures are joined in bands.  All members of a bucket are compared with its
smallest member, exactly on their shingles, then whatever is left in another
component is compared in blocks with everything else in the bucket.  A link
between candidates is thus found, or its ends are known to be connected already.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import mix64, release_memory
from vertexloom.operators.components import connected_components
from vertexloom.operators.index import index_graph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import HOT_ROWS

SHINGLE = 5
SIMILARITY = 0.8
TOGETHER = 20_000  # elements whose darts are thrown in one step
BLOCK = 1_000  # members of a bucket compared in one task at once

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Bands:
    """``count`` bands of ``rows`` coordinates: at 0.8 one pair in 2,800 shares no band."""

    count: int = 20
    rows: int = 5

    @property
    def coordinates(self) -> int:
        return self.count * self.rows


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of ``words`` words, with repetitions.

    Words are what ASCII white space separates.  A text with fewer words is one
    shingle, one without words none.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _SPACES[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * _powers(len(raw), _BASE), dtype=np.uint64)])
        word = mix64((sums[stops] - sums[starts]) * _powers(len(raw) + 1, inverse)[starts])
        n = min(words, len(word))
        out = np.zeros(len(word) - n + 1, np.uint64)
        for i in range(n):
            out = mix64(out + word[i : len(word) - n + 1 + i] + np.uint64(i + 1))
    return out


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def _throw(sets: list[tuple[np.ndarray, np.ndarray]], k: int, darts: float) -> np.ndarray:
    """Earliest dart of each coordinate, a row per set; 0 where no dart fell."""
    sizes = [len(e) for e, _ in sets]
    elements, weights = (np.concatenate(x) for x in zip(*sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    limits = darts / np.bincount(owner, weights=weights, minlength=len(sets))
    ids, ranks, slots = [], [], []
    with np.errstate(over="ignore"):
        low, width, region = 0.0, 1.0, 0
        while len(elements):
            state = mix64(elements + np.uint64(0x632BE59BD9B4E019) * np.uint64(region + 1))
            rank, bound, limit, own = np.zeros(len(state)), weights, limits[owner], owner
            while len(state):
                state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
                rank = rank - np.log(_uniform(state)) / width
                going = rank <= limit
                state, rank, bound, limit, own = state[going], rank[going], bound[going], limit[going], own[going]
                height = low + width * _uniform(mix64(state ^ np.uint64(0xA0761D6478BD642F)))
                hit = height <= bound
                ids.append(state[hit])
                ranks.append(rank[hit])
                slots.append(own[hit] * k + (mix64(state[hit] + np.uint64(1)) % np.uint64(k)).astype(np.int64))
            low, width, region = low + width, low + width, region + 1
            higher = weights > low
            elements, weights, owner = elements[higher], weights[higher], owner[higher]
    ids, ranks, slots = (np.concatenate(x) for x in (ids, ranks, slots))
    order = np.lexsort((ids, ranks, slots))
    first = order[np.diff(slots[order], prepend=-1) > 0]
    out = np.zeros(len(sets) * k, np.uint64)
    out[slots[first]] = ids[first] | np.uint64(1)
    return out.reshape(len(sets), k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of ``k`` coordinates for each ``(distinct elements, weights over 0)``, none empty.

    Sets with a coordinate that no dart has hit get twice as many darts; those
    thrown before are among them.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, darts = np.arange(len(sets)), k * np.log(k) + 2 * k
    while len(todo):
        out[todo] = _throw([sets[i] for i in todo], k, darts)
        todo, darts = todo[(out[todo] == 0).any(axis=1)], 2 * darts
    return out


def band_hashes(found: np.ndarray, bands: Bands) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(1, bands.count + 1, dtype=np.uint64)
        for column in found.reshape(bands.count, bands.rows).T:
            out = mix64(out + column)
    return out.view(np.int64)


def document_elements(text: str | None, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles with their weights: how often they occur, or 1 each."""
    found, counts = np.unique(shingles(text or ""), return_counts=True)
    return found, counts.astype(np.float64) if weighted else np.ones(len(found))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - both
    return float(both / union) if union else 0.0


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    threshold: float = SIMILARITY,
    weighted: bool = False,
    bands: Bands = Bands(),
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, text_key, class_id, component)`` for every row of ``docs``.

    Documents with the same text are one class; classes whose texts are linked,
    directly or through others, are one as well.  ``class_id`` is the smallest
    doc_id of the class, null if none of its rows has one; ``component`` names every
    class, by the key of one of its texts.  Null texts are empty,
    and texts without words are only linked to equal texts.  ``weighted`` lets a
    shingle count as often as it occurs; without it sets of shingles are
    compared.  Other columns of ``docs`` are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("text_key", F.md5("text"))
    buckets = _buckets(own, scratch, weighted, bands)
    spokes = scratch.save(
        buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "spokes"
    )
    texts = scratch.save(_texts_of(own, spokes), "texts")
    links = scratch.save(_verified(spokes, texts, threshold, weighted), "links")
    labels = scratch.save(_components(links, scratch), "labels")
    more = _rest(buckets, labels, texts, threshold, weighted, block, scratch)
    if more is not None:
        links = scratch.save(links.unionByName(more), "all-links")
        labels = scratch.save(_components(links, scratch), "all-labels")

    # Copies of a text are counted once per class before the join, so that no text's
    # key has many rows on either side but the final one.
    named = own.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    named = named.join(labels.withColumnRenamed("id", "text_key"), "text_key", "left")
    named = named.withColumn("component", F.coalesce("component", "text_key"))
    named = scratch.save(named, "named")
    classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = named.join(classes, "component").select("text_key", "class_id", "component")
    return own.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "class_id", "component")


def _buckets(own: DataFrame, scratch: Scratch, weighted: bool, bands: Bands) -> DataFrame:
    """``(band, key, node, hub, size)`` of the buckets with several texts; hub: the smallest."""

    def sign(batches):
        import pandas as pd

        for batch in batches:
            keys, found, sets, held = [], [], [], 0
            for key, text in zip(batch["text_key"].array, batch["text"].array):
                elements = document_elements(text, weighted)
                if len(elements[0]):
                    keys.append(key)
                    sets.append(elements)
                    held += len(elements[0])
                if held >= TOGETHER:
                    found.extend(band_hashes(x, bands) for x in signatures(sets, bands.coordinates))
                    sets, held = [], 0
            if sets:
                found.extend(band_hashes(x, bands) for x in signatures(sets, bands.coordinates))
            yield pd.DataFrame({"node": pd.Series(keys, dtype=object), "bands": pd.Series(found, dtype=object)})
        release_memory()

    signed = own.select("text_key", "text").mapInPandas(sign, "node string, bands array<long>")
    signed = signed.groupBy("node").agg(F.first("bands").alias("bands"))  # equal for equal texts
    rows = signed.select("node", F.posexplode("bands").alias("band", "key"))
    rows = scratch.save(rows, "bands")
    hubs = rows.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return scratch.save(rows.join(hubs, ["band", "key"]), "buckets")


def _texts_of(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, text)`` of the texts in any pair, one row each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    found = own.select("text_key", "text").join(wanted, "text_key", "left_semi")
    return found.groupBy(F.col("text_key").alias("node")).agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Pairs ``(a, b)`` whose similarity reaches the threshold."""

    def check(batches):
        import pandas as pd

        for batch in batches:
            keep, last, left = [], None, None
            for a, text_a, text_b in zip(batch["a"].array, batch["text_a"].array, batch["text_b"].array):
                if a != last:
                    last, left = a, document_elements(text_a, weighted)
                keep.append(similarity(left, document_elements(text_b, weighted)) >= threshold)
            keep = np.array(keep, bool)
            yield pd.DataFrame({"a": batch["a"].to_numpy(object)[keep], "b": batch["b"].to_numpy(object)[keep]})

    of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(of_b, "b").join(of_a, "a").mapInPandas(check, "a string, b string")


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of all texts with a link."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    graph = index_graph(nodes, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch, HOT_ROWS)
    return connected_components(graph, scratch, HOT_ROWS)


def _rest(
    buckets: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, weighted: bool, block: int, scratch: Scratch
) -> DataFrame | None:
    """Links between members of a bucket that are not yet in one component.

    Outsiders, members not in the component of their bucket's hub, are compared
    with all members but the hub.  A bucket is dealt out in blocks of outsiders
    and blocks of members, so that no task gets more than two blocks.
    """
    name = labels.select(F.col("id").alias("node"), F.col("component"))
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    placed = buckets.where("size > 2").join(name, "node", "left").join(of_hub, "hub", "left")
    placed = placed.select(
        "band", "key", "node", "hub", "size",
        F.coalesce("component", "node").alias("component"),
        F.coalesce("hub_component", "hub").alias("hub_component"),
    )
    placed = scratch.save(placed.where("node <> hub").withColumn("outside", F.col("component") != F.col("hub_component")), "placed")
    open_buckets = placed.groupBy("band", "key").agg(F.sum(F.col("outside").cast("long")).alias("outsiders")).where("outsiders > 0")
    # The same members often meet in several bands: one of equal buckets is enough.
    members = placed.join(open_buckets, ["band", "key"])
    content = (
        members.groupBy("band", "key")
        .agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("total"), F.sum(F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")).alias("total_2"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    once = content.groupBy("total", "total_2", "n").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    members = members.join(once, ["band", "key"])
    members = members.select(
        "band", "key", "node", "component", "outside",
        F.ceil(F.col("outsiders") / block).cast("int").alias("o_blocks"),
        F.ceil(F.col("size") / block).cast("int").alias("m_blocks"),
    )
    members = scratch.save(members, "members")
    if members.isEmpty():
        return None
    part = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    as_member = members.select(
        "band", "key", "node", "component", F.lit(False).alias("outsider"),
        F.pmod(part, F.col("m_blocks")).cast("int").alias("m"),
        F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)).alias("o"),
    )
    as_outsider = members.where("outside").select(
        "band", "key", "node", "component", F.lit(True).alias("outsider"),
        F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"),
        F.pmod(part, F.col("o_blocks")).cast("int").alias("o"),
    )
    dealt = as_member.unionByName(as_outsider).join(_shingle_table(texts, weighted), "node")

    def compare(rows):
        return _compare_block(rows, threshold)

    return dealt.groupBy("band", "key", "m", "o").applyInPandas(compare, "a string, b string")


def _shingle_table(texts: DataFrame, weighted: bool) -> DataFrame:
    def cut(batches):
        import pandas as pd

        for batch in batches:
            sets = [document_elements(t, weighted) for t in batch["text"].array]
            yield pd.DataFrame({"node": batch["node"], "elements": [s[0].view(np.int64) for s in sets], "weights": [s[1] for s in sets]})

    return texts.mapInPandas(cut, "node string, elements array<long>, weights array<double>")


def _compare_block(rows, threshold: float):
    """Links of the outsiders of a block with its members of other components.

    Members are indexed by shingle; an outsider meets only members that share
    shingles with it.  Linked components are merged on the way, so that pairs
    connected meanwhile are skipped.
    """
    import pandas as pd

    members = rows[~rows["outsider"]].reset_index(drop=True)
    outsiders = rows[rows["outsider"]]
    if members.empty or outsiders.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    sizes = np.array([len(x) for x in members["elements"]])
    flat = np.concatenate([np.asarray(x, np.int64) for x in members["elements"]])
    weight = np.concatenate([np.asarray(x, float) for x in members["weights"]])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, weight, owner = flat[order], weight[order], owner[order]
    totals = np.array([float(np.sum(w)) for w in members["weights"]])
    names = {c: i for i, c in enumerate(pd.unique(rows["component"]))}
    component = np.array([names[c] for c in members["component"]])
    merged = np.arange(len(names))
    found = []
    for node, own, elements, weights in zip(outsiders["node"], outsiders["component"], outsiders["elements"], outsiders["weights"]):
        mine = merged[names[own]]
        other = component != mine
        if not other.any():
            continue
        elements, weights = np.asarray(elements, np.int64), np.asarray(weights, float)
        low, high = np.searchsorted(flat, elements, "left"), np.searchsorted(flat, elements, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], weights=np.minimum(np.repeat(weights, n), weight[at]), minlength=len(members))
        like = both / np.maximum(weights.sum() + totals - both, 1e-300)
        for i in np.flatnonzero((like >= threshold) & other):
            if component[i] != mine:
                found.append((members["node"][i], node))
                merged[merged == component[i]] = mine
                component[component == component[i]] = mine
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)
