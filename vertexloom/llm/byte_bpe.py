"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string the BPE encoding ends in exactly one token.
That token is the only one that is a suffix of the prefix and may follow the last
token of what precedes it, so one pass that stores the last token of each prefix
encodes the string: linear in its length whatever it holds.  An automaton over the
tokens knows the longest one that ends at a byte, and each token knows the longest
shorter one that ends it, so candidates are tried from long to short.  Two tokens may
stand next to each other if merging their bytes gives just these two again, and
a sequence is the encoding of its bytes if all its neighbours may.

The stored prefixes make an append exact without looking back, and an edit has
to redo only the prefixes from the edit on, until they agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import tokenizer_file
from vertexloom.llm.tokenizing import Memory, blanks_alone, text_batches

MEMORY = 128 << 20  # bytes of stretches and of words one worker remembers, about
MAX_PAIRS = 500_000  # pairs of tokens remembered by one worker, some 100 bytes each


class ByteBPE:
    """Encoder for a table of ranks (token bytes to id; lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.most = max(map(len, ranks), default=1)
        self.span = max(self.bytes_of, default=0) + 1
        self.length = [0] * self.span
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.sizes = np.array(self.length, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.side_by_side = np.frombuffer(b"".join([self.bytes_of.get(i, b"") for i in range(self.span)]), np.uint8)
        self._build()

    def _build(self) -> None:
        """The automaton: ``child`` by state and byte, the state to fall back to, the
        longest token that ends in a state (-1: none) and the next shorter one."""
        child: dict[int, int] = {}
        parents, depth = [(0, 0)], [0]
        ends: dict[int, int] = {}
        for token, i in self.ranks.items():
            state = 0
            for byte in token:
                following = child.get(state << 8 | byte)
                if following is None:
                    following = child[state << 8 | byte] = len(parents)
                    parents.append((state, byte))
                    depth.append(depth[state] + 1)
                state = following
            ends[state] = i
        self.child, self.back = child, [0] * len(parents)
        self.longest, self.shorter = [-1] * len(parents), [-1] * self.span
        for state in sorted(range(1, len(parents)), key=depth.__getitem__):
            parent, byte = parents[state]
            self.back[state] = self._step(self.back[parent], byte) if parent else 0
            below = self.longest[self.back[state]]
            self.longest[state] = ends.get(state, below)
            if state in ends:
                self.shorter[ends[state]] = below

    def _step(self, state: int, byte: int) -> int:
        """State after one more byte."""
        following = self.child.get(state << 8 | byte)
        while following is None and state:
            state = self.back[state]
            following = self.child.get(state << 8 | byte)
        return following or 0

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                return None
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                ranked = [(self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives these two tokens.

        Takes their merges back, latest first, and looks whether a merge across
        the seam would have come before the merge taken back last.
        """
        key = left * self.span + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._may_follow(left, right)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Merges ranked below `bound` come before the last one taken back.  Of two
        # equal merges the left one comes first, so one taken back on the right
        # yields to an equal one at the seam.
        bound = len(self.ranks) + 1
        while True:
            seam = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if seam is not None and seam < bound:
                return False
            of_a, of_b = self._parts(a), self._parts(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                bound, a = a, of_a[1]
            else:
                bound, b = b + 1, of_b[0]

    def advance(self, text: bytes, last: list[int], states: list[int], start: int):
        """Fill in the last token and the automaton's state of each prefix longer than
        ``start``, one at a time; yields its length.  Shorter ones are known."""
        child, back, longest, shorter = self.child, self.back, self.longest, self.shorter
        length, pairs, span = self.length, self.pairs, self.span
        state = states[start]
        for p in range(start + 1, len(text) + 1):
            byte = text[p - 1]
            following = child.get(state << 8 | byte)
            while following is None and state:
                state = back[state]
                following = child.get(state << 8 | byte)
            states[p] = state = following or 0
            token = longest[state]
            while token >= 0 and (at := p - length[token]):
                left = last[at]
                fits = pairs.get(left * span + token)
                if self.may_follow(left, token) if fits is None else fits:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError("the ranks lack a byte of the text")
            last[p] = token
            yield p

    def last_tokens(self, text: bytes) -> list[int]:
        """Last token of each prefix of ``text``, -1 for the empty one."""
        last = [-1] * (len(text) + 1)
        for _ in self.advance(text, last, [0] * len(last), 0):
            pass
        return last

    def walk(self, last: list[int], end: int) -> list[int]:
        """Ids of the prefix of length ``end``, read from its last token backwards."""
        ids, p = [], end
        while p > 0:
            ids.append(last[p])
            p -= self.length[last[p]]
        return ids[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of matches of the pattern, as bytes of little-endian uint32.

        In sorted order a word goes on from the prefix it shares with the one before.
        """
        out: list[bytes] = [b""] * len(words)
        room = max(map(len, words), default=0) + 1
        last, states, before = [-1] * room, [0] * room, b""
        for n in sorted(range(len(words)), key=words.__getitem__):
            word = words[n]
            known = self.ranks.get(word)
            if known is not None:
                out[n] = known.to_bytes(4, "little")
                continue
            start = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                start += 1
            for _ in self.advance(word, last, states, start):
                pass
            before = word
            out[n] = b"".join([i.to_bytes(4, "little") for i in self.walk(last, len(word))])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of all tokens, gathered from one array that holds them side by side."""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[ids] - stops + sizes, sizes)
        return self.side_by_side[at].tobytes()


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, bpe: ByteBPE, text: bytes = b""):
        self.bpe, self.text = bpe, b""
        self.last, self.states = [-1], [0]
        self.append(text)

    def ids(self, end: int | None = None) -> list[int]:
        return self.bpe.walk(self.last, len(self.text) if end is None else end)

    def append(self, more: bytes) -> None:
        start = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        self.states += [0] * len(more)
        for _ in self.bpe.advance(self.text, self.last, self.states, start):
            pass

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for the bytes from ``start`` to ``stop``; prefixes redone.

        A prefix depends on the bytes and last tokens one token length back, so
        once that many in a row agree with the old ones all later ones do.
        """
        old, before, shift = self.last, self.states, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        more = len(self.text) - start
        last, states = old[: start + 1] + [-1] * more, before[: start + 1] + [0] * more
        alike, redone = 0, 0
        for p in self.bpe.advance(self.text, last, states, start):
            redone += 1
            alike = alike + 1 if p > start + len(new) and last[p] == old[p - shift] else 0
            if alike >= self.bpe.most:
                last[p + 1 :] = old[p - shift + 1 :]
                states[p + 1 :] = before[p - shift + 1 :]
                break
        self.last, self.states = last, states
        return redone


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def text_encoder(ranks: str, pattern: str | None):
    """The worker's encoder of whole texts, kept between tasks."""
    import regex

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    bpe = ByteBPE(load_ranks(tokenizer_file(ranks)))
    return TextEncoder(bpe, regex.compile(pattern))


class TextEncoder:
    """Splits texts by the pattern and encodes each match by itself.

    The public pattern never matches across a blank that follows something other
    than white space, so whole stretches from blank to blank are remembered.
    ``by_blank`` says whether that holds for the pattern in use.
    """

    def __init__(self, bpe: ByteBPE, pattern, by_blank: bool = True, limit: int = MEMORY):
        self.bpe, self.pattern, self.by_blank = bpe, pattern, by_blank
        self.words = Memory(lambda new: bpe.encode_words([w.encode() for w in new]), limit=limit)
        self.first = Memory(self._apart, limit=limit)
        self.rest = Memory(self._after_blanks, limit=limit)

    def _apart(self, chunks: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self.words.of([self.pattern.findall(c) for c in chunks])]

    def _after_blanks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a blank; those that end in a letter are split in one go."""
        safe = [c for c in chunks if c and not c[-1].isspace()]
        matches = self.pattern.findall(" " + " ".join(safe)) if safe else []
        found = self.words.of([matches])[0]
        stops = np.searchsorted(np.cumsum([len(m) for m in matches]), np.cumsum([len(c) + 1 for c in safe])) + 1
        starts = iter([0, *stops.tolist()])
        stops = iter(stops.tolist())
        other = iter(self._apart([" " + c for c in chunks if not c or c[-1].isspace()]))
        return [b"".join(found[next(starts) : next(stops)]) if c and not c[-1].isspace() else next(other) for c in chunks]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian uint32."""
        split = [t.split(" ") if self.by_blank and blanks_alone(t) else [t] for t in texts]
        first = self.first.of([parts[:1] for parts in split])
        rest = self.rest.of([parts[1:] for parts in split])
        return [np.frombuffer(b"".join(a + b), "<u4") for a, b in zip(first, rest)]

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


def encode_documents(
    docs: DataFrame,
    ranks: str = "byte_bpe_50k.tiktoken",
    pattern: str | None = None,
    ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode it again.

    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and with ``ids`` also the
    ids as an array.  Null texts are empty, rows with equal ids or texts are
    encoded one by one, other columns are not read; without ``pattern`` the public
    one is used.
    """

    def run(batches):
        import pandas as pd

        encoder = text_encoder(ranks, pattern)
        for batch in batches:
            rows = []
            for texts in text_batches(batch["text"].array):
                for found in encoder.batch(texts):
                    decoded = encoder.bpe.decode(found)
                    row = [len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    rows.append(row + [found.astype(np.int64)] if ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.mapInPandas(run, schema + ", ids array<long>" * ids)
