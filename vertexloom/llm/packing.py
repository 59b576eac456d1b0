"""Packing of token sequences under several limits at once.

Vector bin packing: each piece has a size in three dimensions (tokens, segments,
loss-bearing tokens) and so has each sequence.  An open sequence takes, again
and again, the fitting piece with the largest dot product of its size and the
room left, both as shares of the limits.  Large pieces go first and a dimension
that is nearly used up counts little.

Each task packs the documents of its own input split, with a pool of bounded
size, so there is no shuffle and a lost task is simply run again with the same
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.tokenizing import encoder

POOL = 1024  # pieces a task chooses from
TASK_SHIFT = 32  # sequence ids: number of the task, then number within the task

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """Largest content of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Piece:
    """``loss`` marks the loss-bearing tokens of the piece."""

    owner: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.owner, self.start, self.ids[:at], self.loss[:at], self.total),
            Piece(self.owner, self.start + at, self.ids[at:], self.loss[at:], self.total),
        )


def pack(
    examples: Iterable[tuple[int | None, np.ndarray, np.ndarray]],
    limits: Limits,
    cut: bool,
    pool_size: int = POOL,
) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces, from ``(owner, ids, loss mask)``.

    With ``cut`` a gap that no whole piece fits is filled with part of one, so
    sequences are full; one that another limit ends before, and the last ones, are
    dealt out in lengths that are powers of two, which need no padding.  Without it
    examples stay whole, and one that exceeds a limit by itself is cut at the
    limits, as it fits nowhere else.
    """
    pool: list[Piece] = []
    table = np.zeros((pool_size + 1, 3))  # sizes of the pieces in the pool
    shares = np.zeros((pool_size + 1, 3))  # the same as shares of the limits
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)

    def size(p: Piece) -> np.ndarray:
        return np.array([len(p.ids), 1, np.count_nonzero(p.loss)], float)

    def fitting(p: Piece, tokens: float, loss: float) -> int:
        """Length of the longest beginning of ``p`` within both amounts."""
        bearing = np.count_nonzero(p.loss)
        if bearing <= loss:
            return int(min(len(p.ids), tokens))
        if bearing == len(p.ids):
            return int(min(tokens, loss))
        by_loss = np.searchsorted(np.cumsum(p.loss), loss, side="right")
        return int(min(len(p.ids), tokens, by_loss))

    def add(piece: Piece) -> None:
        table[len(pool)] = size(piece)
        shares[len(pool)] = table[len(pool)] / cap
        pool.append(piece)

    def take(i: int) -> Piece:
        """Remove piece ``i``; the last one moves to its place."""
        piece, last = pool[i], len(pool) - 1
        pool[i] = pool[last]
        table[i] = table[last]
        shares[i] = shares[last]
        pool.pop()
        return piece

    def next_sequence() -> list[Piece]:
        room, chosen = cap.copy(), []
        while pool and room[0] > 0 and room[1] > 0:
            sizes = table[: len(pool)]
            fits = (sizes[:, 0] <= room[0]) & (sizes[:, 1] <= room[1]) & (sizes[:, 2] <= room[2])
            if not fits.any():
                if not cut:
                    break
                donor = int(np.argmax(sizes[:, 0]))
                at = fitting(pool[donor], room[0], room[2])
                if at == 0:
                    break
                head, tail = take(donor).cut(at)
                add(tail)
                chosen.append(head)
                room -= size(head)
                continue
            gain = np.where(fits, shares[: len(pool)] @ (room / cap), -1.0)
            best = int(np.argmax(gain))
            room -= sizes[best]
            chosen.append(take(best))
        return chosen

    def finished(sequence: list[Piece]) -> Iterator[list[Piece]]:
        n = sum(len(p.ids) for p in sequence)
        if cut and n < limits.tokens:
            return _powers_of_two(sequence, n)
        return iter([sequence])

    for owner, ids, loss in examples:
        rest = Piece(owner, 0, ids, loss, len(ids))
        while (at := fitting(rest, limits.tokens, limits.loss_tokens)) < len(rest.ids):
            head, rest = rest.cut(at)
            yield from finished([head])
        if len(rest.ids) == limits.tokens:
            yield [rest]
        elif len(rest.ids):
            add(rest)
        while len(pool) >= pool_size:
            yield from finished(next_sequence())
    while pool:
        yield from finished(next_sequence())


def _powers_of_two(pieces: list[Piece], n: int) -> Iterator[list[Piece]]:
    """Deal pieces of ``n`` tokens out in lengths that are powers of two."""
    queue = pieces[::-1]
    while n:
        want = 1 << (n.bit_length() - 1)
        n -= want
        part = []
        while want:
            p = queue.pop()
            if len(p.ids) > want:
                p, tail = p.cut(want)
                queue.append(tail)
            part.append(p)
            want -= len(p.ids)
        yield part


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    limits: Limits = Limits(),
    cut: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    A document is its ids and ``end_id``; all of them bear loss.  Null and empty
    texts are the end id alone, repeated rows are documents of their own, an
    empty table gives no rows, and columns other than doc_id and text are not
    read.  ``sequence_id`` is unique, ``offset`` counts from 0 without gaps.
    """

    def examples(batch):
        end = np.array([end_id], "<u4")
        for owner, found in zip(batch["doc_id"].array, encoder(tokenizer).each(batch["text"].array)):
            ids = np.concatenate([found, end])
            yield owner, ids, np.ones(len(ids), bool)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _packed(own, examples, limits, cut)


def pack_examples(
    rows: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    limits: Limits = Limits(loss_tokens=1024),
    cut: bool = False,
) -> DataFrame:
    """Like :func:`pack_documents` for instruction data, of which only some tokens bear loss.

    ``rows`` has ``doc_id`` and ``parts``, an array of ``(text, loss)`` in order: prompts
    without and answers with loss.  Each part is encoded by itself and the end id
    bears loss if the last part does.  Null parts and texts are empty, a null ``loss``
    is false.  Unless ``cut``, an example stays in one sequence where it fits in one.
    """

    def examples(batch):
        parts = [[] if p is None else [x for x in p if x is not None] for p in batch["parts"]]
        found = encoder(tokenizer).each([x["text"] for p in parts for x in p])
        for owner, of in zip(batch["doc_id"].array, parts):
            ids, loss = [], []
            for part in of:
                ids.append(next(found))
                loss.append(np.full(len(ids[-1]), bool(part["loss"])))
            ids.append(np.array([end_id], "<u4"))
            loss.append(np.array([bool(of and of[-1]["loss"])]))
            yield owner, np.concatenate(ids), np.concatenate(loss)

    own = rows.select(F.col("doc_id").cast("long"), F.col("parts").cast("array<struct<text: string, loss: boolean>>"))
    return _packed(own, examples, limits, cut)


def _packed(rows: DataFrame, examples, limits: Limits, cut: bool) -> DataFrame:
    """Pieces of what ``examples`` makes of each batch: ``(owner, ids, loss mask)``."""

    def run(batches):
        import pandas as pd

        base = TaskContext.get().partitionId() << TASK_SHIFT
        given = ((None if pd.isna(owner) else int(owner), ids, loss) for batch in batches for owner, ids, loss in examples(batch))
        out = []
        for number, sequence in enumerate(pack(given, limits, cut)):
            offset = 0
            for p in sequence:
                out.append((p.owner, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, base + number, offset, int(p.loss.sum())))
                offset += len(p.ids)
            if len(out) >= 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return rows.mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]):
    import pandas as pd

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"doc_id": "Int64"})
