"""Token alignment between two tokenizers, scored by counts over the corpus.

Both tokenizers cut the same bytes.  Offsets where tokens of both end divide a text
into groups, and every stretch between two token ends belongs to one token of
either side: these two are linked.  The count of a pair of ids is the number of
documents that hold it linked.

First pass: tasks align their documents and emit, per bucket of pairs, the sorted
pairs and the number of documents of each.  The distinct pairs of a bucket, gathered in
a tree, get a minimal perfect hash function, and counts become dense vectors
indexed by it, which are added up in a tree.  Second pass: documents are aligned
again and their pairs looked up; the pair stored at an index proves that it is the
one asked for.

There are at most as many pairs as the two vocabularies allow, whatever the size of
the corpus.  Up to ``LISTED_PAIRS`` of them are broadcast; beyond that the pairs of
the documents meet the counts in a join.

Null and empty texts, and texts whose tokens do not spell the text behind a blank,
have no tokens: zeros and an empty digest.  Repeated rows are documents of their own,
columns other than doc_id and text are not read, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import fair_share, mix64, tokenizer_file
from vertexloom.llm.tokenizing import Encoder, blanks_alone, text_batches
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import find_hot, lookup_join

BUCKETS = 64  # of pairs, each with a hash function and vectors of its own
FAN_IN = 64  # partial results merged at once
LISTED_PAIRS = 4_000_000  # counts that are broadcast, some 20 bytes each
ROOM = 2  # bits per key on a level of the hash function
REMEMBERED = 160 << 20  # bytes of aligned stretches one worker remembers, about
ENTRY = 250  # bytes a stretch takes besides its text, its links and its groups, about

BLANK_STARTS = re.compile(r"(?<=\S)(?= )")
MARK = "▁"  # fixed value: stands for a blank in the pieces
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

PART_SCHEMA = "part long, bucket int, keys binary, counts binary"
HASH_SCHEMA = "bucket int, sizes array<long>, bits binary, keys binary"
VECTOR_SCHEMA = "bucket int, part long, counts binary"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
RESULT = DIGESTS + ", n_best long, count_sum long, groups_sha256 string"


# -- minimal perfect hashing ----------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix64(keys ^ salt) % np.uint64(size)


class PerfectHash:
    """Distinct 64-bit keys onto 0 to n - 1.

    On each level the keys left take one of ``ROOM`` times as many bits; a bit that
    one key alone takes is set, the other keys go on to the next level.  The index of
    a key is the number of bits set before its own.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = [int(s) for s in sizes]
        self.words = np.frombuffer(bits, "<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            size = -(-ROOM * len(keys) // 64) * 64
            at = _place(keys, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").tobytes())
            sizes.append(size)
            keys = keys[~alone[at]]
            level += 1
        return cls(sizes, b"".join(parts))

    @property
    def bits(self) -> bytes:
        return self.words.tobytes()

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of keys it was not built for, -1 or that of another key."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + _place(keys[left], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, start = left[~hit], start + size
            if not len(left):
                break
        return out


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys) >> np.uint64(40)) % np.uint64(BUCKETS)


class PairCounts:
    """Dense counts by perfect hash, bucket by bucket, and the best count of each A id."""

    def __init__(self, rows: list[tuple], best: dict[int, int]):
        self.buckets = {
            r[0]: (PerfectHash(r[1], bytes(r[2])), np.frombuffer(bytes(r[3]), "<u8"), np.frombuffer(bytes(r[4]), "<i8")) for r in rows
        }
        self.best = best

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 for those that the corpus does not hold."""
        out, bucket = np.zeros(len(keys), np.int64), bucket_of(keys)
        for b in np.unique(bucket).tolist():
            if b not in self.buckets:
                continue
            mine = np.nonzero(bucket == b)[0]
            hash_of, stored, counts = self.buckets[b]
            at = hash_of.index(keys[mine])
            same = (at >= 0) & (stored[at] == keys[mine])
            out[mine[same]] = counts[at[same]]
        return out

    def best_of(self, keys: np.ndarray) -> np.ndarray:
        """The highest count of each pair's A id."""
        ids = (keys >> np.uint64(32)).astype(np.int64).tolist()
        return np.array([self.best.get(a, -1) for a in ids], np.int64)


# -- alignment of stretches of text ---------------------------------------


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Aligner:
    """Alignments of stretches between blanks, remembered up to ``limit`` bytes.

    Neither tokenizer has a token that goes on from a letter to a blank, so a text is
    aligned stretch by stretch.  Should side B have such pieces, texts stay whole.
    Without ``texts`` groups are counted but not spelled out.
    """

    def __init__(self, a: str, b: str, texts: bool = True, limit: int = REMEMBERED):
        import sentencepiece

        self.a = Encoder(a, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte_of = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else b""
        b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.sides = [_ByteTable(a_bytes), _ByteTable(b_bytes)]
        self.by_blank = not any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.blank = self.b.piece_to_id(MARK)
        self.names = list(map(str, range(max(len(a_bytes), len(b_bytes))))) if texts else None
        self.limit = limit
        self.clear()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)])
        return piece.replace(MARK, " ").encode()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.pairs: dict[int, int] = {}
        self.size = 0
        self.stats = np.zeros((0, 5), np.int64)  # usable, tokens of A and B, groups, links
        self.groups: list[str] = []
        self.links = np.zeros(0, np.int64)  # numbers of pairs, stretch by stretch
        self.link_stops = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return self.size > self.limit

    def pair_keys(self) -> np.ndarray:
        """Pairs in the order of their numbers: id of A in the upper, of B in the lower half."""
        return np.fromiter(self.pairs, np.uint64, len(self.pairs))

    def read(self, texts: list[str]) -> list[list[int]]:
        """Numbers of each text's stretches; of an empty text none."""
        look_up, out = self.numbers.__getitem__, []
        for text in texts:
            if not text:
                out.append([])
            elif self.by_blank and blanks_alone(" " + text):
                out.append([look_up(w) for w in text.split(" ")])
            elif self.by_blank:
                out.append([look_up(c[1:]) for c in BLANK_STARTS.split(" " + text)])
            else:
                out.append([look_up(text)])
        new, self.numbers.new = self.numbers.new, []
        if new:
            self._learn(new)
        return out

    def _learn(self, words: list[str]) -> None:
        """Align the stretches ``" " + word``, all in one go."""
        raw = [b" " + w.encode() for w in words]
        a = self.a.chunks([" " + w for w in words])
        b = self.b.encode(words, num_threads=1)
        b = [ids if w else [self.blank] for w, ids in zip(words, b)]  # a blank at the end of a text
        n = len(words)
        ids = [np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64)]
        counts = [np.array([len(x) // 4 for x in a]), np.array([len(x) for x in b])]
        owners = [np.repeat(np.arange(n), c) for c in counts]
        sizes = np.array([len(r) for r in raw])
        usable = np.ones(n, bool)
        for table, i, owner in zip(self.sides, ids, owners):
            length = table.sizes[i]
            usable &= np.bincount(owner, length, n).astype(np.int64) == sizes
            usable[owner[length == 0]] = False
        spelled = np.frombuffer(b"".join([r for r, ok in zip(raw, usable) if ok]), np.uint8)
        byte_owner = np.repeat(np.nonzero(usable)[0], sizes[usable])
        wrong = np.zeros(len(spelled), bool)
        for table, i, owner in zip(self.sides, ids, owners):
            wrong |= table.spell(i[usable[owner]]) != spelled
        usable[byte_owner[wrong]] = False

        # All usable stretches side by side are one text: each of them ends with both sides.
        kept = [usable[owner] for owner in owners]
        ids = [i[k] for i, k in zip(ids, kept)]
        owner = owners[0][kept[0]]
        ends = [np.cumsum(table.sizes[i]) for table, i in zip(self.sides, ids)]
        cuts = _distinct(np.concatenate(ends))
        left, right = np.searchsorted(ends[0], cuts), np.searchsorted(ends[1], cuts)
        keys = (ids[0][left] << 32) | ids[1][right]
        n_links = np.bincount(owner[left], minlength=n)
        common = ends[0][ends[1][np.minimum(np.searchsorted(ends[1], ends[0]), len(ends[1]) - 1)] == ends[0]] if len(ends[1]) else cuts
        group_owner = owner[np.searchsorted(ends[0], common)]
        n_groups = np.bincount(group_owner, minlength=n)

        distinct, inverse = np.unique(keys, return_inverse=True)
        pairs = self.pairs
        number = np.array([pairs.setdefault(k, len(pairs)) for k in distinct.tolist()], np.int64)
        stats = np.stack([usable, counts[0], counts[1], n_groups, n_links], axis=1).astype(np.int64)
        base = self.link_stops[-1] if len(self.link_stops) else 0
        self.stats = np.concatenate([self.stats, stats])
        self.links = np.concatenate([self.links, number[inverse]])
        self.link_stops = np.concatenate([self.link_stops, base + np.cumsum(n_links)])
        if self.names is None:
            self.groups += [""] * n
        else:
            texts = iter(self._group_texts(ids, ends, common, group_owner))
            self.groups += [next(texts) if k else "" for k in n_groups.tolist()]
            self.size += 60 * n + 6 * sum(map(len, ids))
        self.size += ENTRY * n + int(sizes.sum()) + 8 * int(n_links.sum())

    def _group_texts(self, ids, ends, common, owner) -> list[str]:
        """Groups of each stretch that has some, such as ``1,2|3;4|5``."""
        group = np.concatenate([np.searchsorted(common, e) for e in ends])
        side = np.repeat([0, 1], [len(i) for i in ids])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, token = group[order], side[order], np.concatenate(ids)[order].tolist()
        stretch = owner[group]
        # What follows a token: another of its side and group, the other side, a group, a stretch.
        after = np.zeros(len(token), np.int64)
        after[:-1][side[1:] != side[:-1]] = 1
        after[:-1][group[1:] != group[:-1]] = 2
        after[:-1][stretch[1:] != stretch[:-1]] = 3
        marks = map(",|;\n".__getitem__, after.tolist())
        pieces = [x for pair in zip(map(self.names.__getitem__, token), marks) for x in pair]
        return "".join(pieces[:-1]).split("\n") if pieces else []

    def links_of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs linked in the stretches, and the place of each one's stretch."""
        stops = self.link_stops[stretches]
        n = self.stats[stretches, 4]
        place = np.repeat(np.arange(len(stretches)), n)
        within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return self.links[np.repeat(stops - n, n) + within], place


class _ByteTable:
    """Bytes of ids, side by side."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        return self.bytes[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - stops + sizes, sizes)]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted and without repetitions; faster than hashing them."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=numbers[:1] - 1) != 0]


@lru_cache(maxsize=1)
def aligner(a: str, b: str, texts: bool) -> Aligner:
    """The worker's aligner, kept between tasks of a pass."""
    return Aligner(tokenizer_file(a), tokenizer_file(b), texts)


class _Batch:
    """Documents of a batch as rows of (document, stretch)."""

    def __init__(self, own: Aligner, texts: list[str]):
        self.own, read = own, own.read(texts)
        self.n = len(texts)
        lengths = np.array([len(x) for x in read], np.int64)
        self.doc = np.repeat(np.arange(self.n), lengths)
        self.stretch = np.fromiter(chain.from_iterable(read), np.int64, int(lengths.sum()))
        bad = np.zeros(self.n, bool)
        bad[self.doc[own.stats[self.stretch, 0] == 0]] = True
        good = ~bad[self.doc]
        self.doc, self.stretch = self.doc[good], self.stretch[good]

    def document_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, number of a pair)."""
        n = len(self.own.groups) + 1
        once = _distinct(self.doc * n + self.stretch)
        pair, place = self.own.links_of(once % n)
        width = len(self.own.pairs) + 1
        found = _distinct((once // n)[place] * width + pair)
        return found // width, found % width

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per document of a value per row of (document, stretch)."""
        total = np.concatenate([[0], np.cumsum(values)])
        stops = np.searchsorted(self.doc, np.arange(self.n), "right")
        starts = np.searchsorted(self.doc, np.arange(self.n), "left")
        return total[stops] - total[starts]

    def digests(self) -> dict[str, np.ndarray]:
        stats = self.own.stats[self.stretch]
        return {name: self.sums(stats[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"), 1)}

    def group_hashes(self) -> list[str]:
        texts, stretch = self.own.groups, self.stretch.tolist()
        stops = np.searchsorted(self.doc, np.arange(self.n), "right").tolist()
        starts = np.searchsorted(self.doc, np.arange(self.n), "left").tolist()
        return [
            hashlib.sha256(";".join([texts[s] for s in stretch[i:j]]).encode()).hexdigest() if j > i else ""
            for i, j in zip(starts, stops)
        ]


# -- first pass ------------------------------------------------------------


def _count_pairs(a: str, b: str):
    def run(batches):
        import pandas as pd

        own = aligner(a, b, False)
        part = TaskContext.get().partitionId() << 20
        counts = np.zeros(0, np.int64)

        def flush():
            nonlocal part, counts
            seen = np.nonzero(counts)[0]
            keys, n = own.pair_keys()[seen], counts[seen]
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            bucket = bucket_of(keys)
            rows = [(part, int(k), keys[bucket == k].tobytes(), n[bucket == k].tobytes()) for k in np.unique(bucket)]
            part, counts = part + 1, np.zeros(0, np.int64)
            return pd.DataFrame(rows, columns=["part", "bucket", "keys", "counts"])

        for batch in batches:
            for texts in text_batches(batch["text"].array):
                if own.full:
                    yield flush()
                    own.clear()
                _, pair = _Batch(own, texts).document_pairs()
                n = np.bincount(pair, minlength=len(own.pairs))
                n[: len(counts)] += counts
                counts = n
        yield flush()

    return run


def _in_tree(parts: DataFrame, n_parts: int, scratch: Scratch, merge: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Merge the parts of each bucket ``FAN_IN`` at a time until one is left.

    ``merge`` makes parts numbered by their branch out of those of as many branches.
    """
    while True:
        branches = -(-n_parts // FAN_IN)
        parts = merge(parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(branches))), branches)
        if branches == 1:
            return parts
        parts, n_parts = scratch.save(parts, "merged"), branches


def _distinct_keys(parts: DataFrame, branches: int) -> DataFrame:
    def run(group):
        keys = [np.frombuffer(k, "<u8") for k in group["keys"]]
        first = group.iloc[:1][["bucket", "part"]].copy()
        first["keys"] = [np.unique(np.concatenate(keys)).tobytes()]
        return first

    return parts.groupBy("bucket", "part").applyInPandas(run, "bucket int, part long, keys binary")


def _hash_functions(keys: DataFrame) -> DataFrame:
    """``(bucket, sizes, bits, keys)``: a bucket's function, and its keys in that order."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for bucket, raw in zip(batch["bucket"], batch["keys"]):
                found = np.frombuffer(raw, "<u8")
                hash_of = PerfectHash.of(found)
                ordered = np.empty(len(found), "<u8")
                ordered[hash_of.index(found)] = found
                rows.append((bucket, hash_of.sizes, hash_of.bits, ordered.tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "sizes", "bits", "keys"])

    return keys.select("bucket", "keys").mapInPandas(run, HASH_SCHEMA)


def _dense(parts: DataFrame, hashes: DataFrame, n_parts: int, scratch: Scratch) -> DataFrame:
    """``(bucket, counts)``: vectors indexed by the hash functions, summed in a tree."""
    branches = -(-n_parts // FAN_IN)

    def fill(key, mine, functions):
        import pandas as pd

        if not len(mine) or not len(functions):
            return pd.DataFrame({"bucket": [], "part": [], "counts": []})
        f = functions.iloc[0]
        hash_of = PerfectHash(f["sizes"], f["bits"])
        out = np.zeros(len(f["keys"]) // 8, np.int64)
        for keys, counts in zip(mine["keys"], mine["counts"]):
            out[hash_of.index(np.frombuffer(keys, "<u8"))] += np.frombuffer(counts, "<i8")
        return pd.DataFrame({"bucket": [key[0]], "part": [key[1]], "counts": [out.tobytes()]})

    def add(group):
        first = group.iloc[:1][["bucket", "part"]].copy()
        first["counts"] = [np.sum([np.frombuffer(c, "<i8") for c in group["counts"]], axis=0).tobytes()]
        return first

    def merge(vectors: DataFrame, n: int) -> DataFrame:
        return vectors.groupBy("bucket", "part").applyInPandas(add, VECTOR_SCHEMA)

    dealt = parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(branches)))
    offered = hashes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))))
    vectors = dealt.groupBy("bucket", "part").cogroup(offered.groupBy("bucket", "part")).applyInPandas(fill, VECTOR_SCHEMA)
    if branches > 1:
        vectors = _in_tree(scratch.save(vectors, "vectors"), branches, scratch, merge)
    return vectors.select("bucket", "counts")


def _entries(counted: DataFrame) -> DataFrame:
    """``(pair, a, n)`` for every pair, from ``(bucket, sizes, bits, keys, counts)``."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                keys = np.frombuffer(keys, "<i8")
                yield pd.DataFrame({"pair": keys, "a": keys >> 32, "n": np.frombuffer(counts, "<i8")})

    return counted.select("keys", "counts").mapInPandas(run, "pair long, a long, n long")


# -- second pass -----------------------------------------------------------


def _look_up(a: str, b: str, shared):
    def run(batches):
        import pandas as pd

        own, table = aligner(a, b, True), PairCounts(*shared.value)
        n = best = np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for texts in text_batches(batch["text"].array):
                if own.full:
                    own.clear()
                    n = best = np.zeros(0, np.int64)
                rows = _Batch(own, texts)
                new = own.pair_keys()[len(n) :]
                more = table.of(new)
                n = np.concatenate([n, more])
                best = np.concatenate([best, more == table.best_of(new)])
                stretches, at = np.unique(rows.stretch, return_inverse=True)
                pair, place = own.links_of(stretches)
                if not n[pair].all():
                    raise ValueError("a pair that the first pass did not see")
                frame = rows.digests()
                for name, values in (("n_best", best), ("count_sum", n)):
                    total = np.concatenate([[0], np.cumsum(values[pair])])
                    stops = np.cumsum(np.bincount(place, minlength=len(stretches)))
                    frame[name] = rows.sums((total[stops] - total[np.concatenate([[0], stops[:-1]])])[at]) if len(stretches) else 0
                frame["groups_sha256"] = rows.group_hashes()
                found.append(pd.DataFrame(frame))
            if found:
                out = pd.concat(found, ignore_index=True)
                out.insert(0, "doc_id", batch["doc_id"].array)
                yield out

    return run


def _spread_pairs(a: str, b: str):
    """Digests of documents with the pairs of each and how often they are linked."""

    def run(batches):
        import pandas as pd

        own = aligner(a, b, True)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = []
            for texts in text_batches(batch["text"].array):
                if own.full:
                    own.clear()
                rows, keys = _Batch(own, texts), own.pair_keys().astype(np.int64)
                pair, place = own.links_of(rows.stretch)
                both, times = np.unique(rows.doc[place] * (len(keys) + 1) + pair, return_counts=True)
                doc, pair = both // (len(keys) + 1), both % (len(keys) + 1)
                bounds = np.searchsorted(doc, np.arange(rows.n + 1))
                frame = rows.digests()
                frame["groups_sha256"] = rows.group_hashes()
                frame["pairs"] = [keys[pair[i:j]] for i, j in zip(bounds[:-1], bounds[1:])]
                frame["times"] = [times[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
                found.append(pd.DataFrame(frame))
            if found:
                out = pd.concat(found, ignore_index=True)
                out.insert(0, "doc_id", batch["doc_id"].array)
                out.insert(0, "row", row + np.arange(len(out)))
                row += len(out)
                yield out

    return run


def _joined(docs: DataFrame, counted: DataFrame, best: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """The second pass where the counts are too many to broadcast."""
    schema = "row long, " + DIGESTS + ", groups_sha256 string, pairs array<long>, times array<long>"
    own = scratch.save(docs.mapInPandas(_spread_pairs(a, b), schema), "document-pairs")
    entries = _entries(counted).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    linked = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    n_rows = own.agg(F.sum(F.size("pairs"))).first()[0] or 0
    hot = find_hot(linked, "pairs", n_rows, fair_share(own, n_rows))
    found = lookup_join(linked, "pairs", entries, "pair", hot, "row")
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    joined = own.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return joined.select(*[x.split()[0] for x in RESULT.split(", ")])


def align_documents(
    docs: DataFrame,
    scratch: Scratch,
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    listed_pairs: int = LISTED_PAIRS,
) -> DataFrame:
    """Per document the sizes of its alignment and how common its links are.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``:
    ``n_best`` counts links whose pair is the commonest of its A id, ``count_sum`` adds
    the counts of all links.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = scratch.save(own.select("text").mapInPandas(_count_pairs(a, b), PART_SCHEMA), "pair-counts")
    n_parts = max(1, parts.select("part").distinct().count())
    keys = _in_tree(parts.select("bucket", "part", "keys"), n_parts, scratch, _distinct_keys)
    hashes = scratch.save(_hash_functions(keys), "hash-functions")
    counted = scratch.save(hashes.join(_dense(parts, hashes, n_parts, scratch), "bucket"), "dense-counts")
    # One row per id of A that occurs: at most the size of its vocabulary.
    best = _entries(counted).groupBy("a").agg(F.max("n").alias("best"))
    n_pairs = counted.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
    if n_pairs > listed_pairs:
        return _joined(own, counted, scratch.save(best, "best"), a, b, scratch)
    rows = [tuple(r) for r in counted.select("bucket", "sizes", "bits", "keys", "counts").collect()]
    shared = docs.sparkSession.sparkContext.broadcast((rows, {r["a"]: r["best"] for r in best.collect()}))
    return own.mapInPandas(_look_up(a, b, shared), RESULT)
