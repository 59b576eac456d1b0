"""Rounds over all edges of a long graph, on arrays.

A round that joins every edge with the state of its source and adds up by destination
moves and hashes a row per edge.  For a long graph the vertices are dealt to blocks, in
which a vertex is a place in an array, and the edges that leave a block are laid out once,
by the block they lead to and by destination.  A round is then a lookup in an array and a
reduction of its stretches, and moves one number for each destination that a block
reaches.  Blocks, states and messages are rows with a few arrays each, in tables bucketed by
block: no block or state is shuffled in a round, only messages are.

A vertex number is the partition it was numbered in and its row there (see
``index.index_graph``), from which block and place follow without a lookup.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import shuffle_partitions

DENSE_FROM = 4_000_000  # edges of a graph whose rounds go over arrays
EDGES_PER_BLOCK = 3_000_000
MOST_IN_BLOCK = 4 * EDGES_PER_BLOCK  # edges that a task may lay out; skewed graphs have more in one block
LOCAL_BITS = 33  # of the numbers that monotonically_increasing_id gives
BLOCK_SCHEMA = "k int, to int, sources binary, counts binary, targets binary, times binary"
MESSAGE_SCHEMA = "k int, sender int, kind int, targets binary, vals binary"


@dataclass(frozen=True)
class Layout:
    """Where each vertex lies: ``group`` partitions of numbers make up a block.

    A block is known by a key whose hash deals it to the partition of its number, so that
    each task has one block.
    """

    group: int
    keys: list[int]

    @classmethod
    def of(cls, vertices: DataFrame, n_edges: int) -> Layout:
        spark = vertices.sparkSession
        last = vertices.agg(F.max("v")).first()[0] or 0
        parts = (last >> LOCAL_BITS) + 1
        cores = spark.sparkContext.defaultParallelism
        wanted = max(math.ceil(n_edges / EDGES_PER_BLOCK), min(2 * cores, math.ceil(n_edges / 100_000)))
        group = max(1, parts // wanted)
        return cls(group, _keys(spark, math.ceil(parts / group)))

    def block(self, v: str) -> Column:
        return F.floor(F.shiftright(v, LOCAL_BITS) / self.group).cast("int")

    def key(self, v: str) -> Column:
        return F.element_at(F.lit(self.keys), self.block(v) + 1)

    def place(self, v: str) -> Column:
        local = F.col(v).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
        return (local * self.group + F.pmod(F.shiftright(v, LOCAL_BITS), F.lit(self.group))).cast("int")

    def vertices(self, key: int, places: np.ndarray) -> np.ndarray:
        """Vertex numbers of places in a block."""
        part = self.keys.index(key) * self.group + places % self.group
        return (part.astype(np.int64) << LOCAL_BITS) | (places // self.group)


def _keys(spark: SparkSession, blocks: int) -> list[int]:
    """For each block a number that hashes to it."""
    found: dict[int, int] = {}
    n = 16
    while len(found) < blocks:
        n *= 4
        numbers = spark.range(n * blocks).select(F.col("id").cast("int").alias("k"))
        at = numbers.select("k", F.pmod(F.hash("k"), F.lit(blocks)).alias("at")).groupBy("at").agg(F.min("k").alias("k"))
        found = {row["at"]: row["k"] for row in at.collect()}
    return [found[i] for i in range(blocks)]


# -- arrays in rows ---------------------------------------------------------


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes each as the largest takes."""
    size = np.min_scalar_type(int(numbers.max(initial=0))).itemsize
    return bytes([size, 0, 0, 0, 0, 0, 0, 0]) + numbers.astype(f"u{size}").tobytes()


def _unpack(data: pa.Scalar) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer, dtype=f"u{buffer[0]}", offset=8).astype(np.int64)


def array_of(state: pa.Table, name: str, dtype: str = "f8") -> np.ndarray:
    return np.frombuffer(state[name][0].as_buffer(), dtype=dtype)


def rows_of(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


# -- building ---------------------------------------------------------------


@dataclass(frozen=True)
class DenseGraph:
    """Edges laid out by the block of their source, and empty states."""

    layout: Layout
    scratch: Scratch
    tables: list[DataFrame] = field(default_factory=list)

    @classmethod
    def fits(cls, layout: Layout, edges: DataFrame, *ends: str) -> bool:
        """Whether no block has more edges, by any of these ends, than a task may lay out."""
        for end in ends:
            sizes = edges.groupBy(layout.block(end).alias("block")).agg(F.count(F.lit(1)).alias("n"))
            if (sizes.agg(F.max("n")).first()[0] or 0) > MOST_IN_BLOCK:
                return False
        return True

    def lay_out(self, edges: DataFrame, source: str, target: str, name: str) -> DataFrame:
        """Blocks of the edges ``(source, target, m)``."""
        at = self.layout
        rows = edges.select(
            at.key(source).alias("k"),
            at.place(source).alias("i"),
            (F.shiftleft(at.block(target).cast("long"), 32) + at.place(target)).alias("t"),
            F.col("m").cast("long").alias("m"),
        )
        made = rows.repartition(len(at.keys), "k").mapInArrow(_laid_out(at.keys), BLOCK_SCHEMA)
        return self._kept(self._save(made, name)[0])

    def states(self, vertices: DataFrame, make: Callable, schema: str, name: str, *more: Column, **aggregates: Column) -> tuple[DataFrame, dict]:
        """A row of arrays for each block, which ``make(key, places, *more)`` gives in the
        columns of ``schema``, of which the first is the key."""
        at = self.layout
        rows = vertices.select(at.key("v").alias("k"), at.place("v").alias("i"), *more)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, columns = _gathered(batches)
            if key is not None:
                yield from rows_of(schema, [[x] for x in make(key, *columns)]).to_batches()

        return self._save(rows.repartition(len(at.keys), "k").mapInArrow(made, schema), name, **aggregates)

    def round(
        self, sends: list[tuple[DataFrame, Callable]], state: DataFrame, receive: Callable, schema: str, name: str, **aggregates: Column
    ) -> tuple[DataFrame, dict]:
        """State after a round.  ``send(key, blocks, state)`` gives messages for the blocks of
        each table, ``receive(key, messages, state)`` the next state."""
        with shuffle_partitions(state.sparkSession, len(self.layout.keys)):
            sent = None
            for blocks, send in sends:
                found = blocks.groupBy("k").cogroup(state.groupBy("k")).applyInArrow(_with_key(send), MESSAGE_SCHEMA)
                sent = found if sent is None else sent.unionByName(found)
            following = sent.groupBy("k").cogroup(state.groupBy("k")).applyInArrow(_with_key(receive), schema)
            return self._save(following, name, **aggregates)

    def rows(self, state: DataFrame, make: Callable, schema: str) -> DataFrame:
        """Rows of the vertices of each block, which ``make(key, state)`` gives as columns."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for i in range(table.num_rows):
                    one = table.slice(i, 1)
                    yield from rows_of(schema, make(one["k"][0].as_py(), one)).to_batches(max_chunksize=100_000)

        return state.mapInArrow(made, schema)

    def release(self) -> None:
        self.scratch.drop(*self.tables)

    def _kept(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def _save(self, df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
        return self.scratch.save_dealt(df, name, "k", len(self.layout.keys), **aggregates)


def _with_key(function: Callable) -> Callable:
    def called(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return function(key[0].as_py(), left, right)

    return called


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, list[np.ndarray]]:
    """The key of a task's rows and their other columns."""
    key, parts = None, []
    for batch in batches:
        if batch.num_rows:
            key = batch.column(0)[0].as_py()
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
    return key, [np.concatenate(p) for p in zip(*parts)]


def _laid_out(keys: list[int]) -> Callable:
    """Edges ``(k, i, t, m)`` of a block as a row for each block that they lead to, by
    destination, after a row with the number of edges that leave each place."""

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, columns = _gathered(batches)
        if key is None:
            return
        i, t, m = columns
        del columns
        out = np.bincount(i, weights=m)
        yield from rows_of(BLOCK_SCHEMA, [[key], [None], [out.tobytes()], [None], [None], [None]]).to_batches()
        order = np.argsort(t)
        i, t = i[order], t[order]
        times = bool((m != 1).any())
        m = m[order] if times else None
        del order
        ends = np.append(np.flatnonzero(np.diff(t >> 32)) + 1, len(t))
        begin = 0
        for end in ends:
            to = keys[int(t[begin] >> 32)]
            target, counts = np.unique(t[begin:end] & 0xFFFFFFFF, return_counts=True)
            row = [_pack(i[begin:end]), _pack(counts), _pack(np.diff(target, prepend=0)), _pack(m[begin:end]) if times else None]
            yield from rows_of(BLOCK_SCHEMA, [[key], [to], *([x] for x in row)]).to_batches()
            begin = end

    return laid_out


# -- sending and receiving --------------------------------------------------


def out_of(blocks: pa.Table, n: int) -> np.ndarray:
    """Edges that leave each of ``n`` places."""
    out = np.zeros(n)
    for row in range(blocks.num_rows):
        if not blocks["to"][row].is_valid:
            found = np.frombuffer(blocks["sources"][row].as_buffer())
            out[: len(found)] = found
    return out


def messages(key: int, blocks: pa.Table, vals: np.ndarray, add: bool, none: float | int, kind: int = 0) -> pa.Table:
    """The sum, or else the least, of the values of the places that lead to each destination;
    destinations that get nothing but ``none`` are left out."""
    columns: list[list] = [[], [], [], [], []]
    senders = vals != none
    if senders.any():
        for row in range(blocks.num_rows):
            if not blocks["to"][row].is_valid:
                continue
            sources = _unpack(blocks["sources"][row])
            sent = vals[sources]
            if add and blocks["times"][row].is_valid:
                sent = sent * _unpack(blocks["times"][row])
            counts = _unpack(blocks["counts"][row])
            starts = np.cumsum(counts) - counts
            got = np.add.reduceat(sent, starts) if add else np.minimum.reduceat(sent, starts)
            some = got != none
            if not some.any():
                continue
            targets = blocks["targets"][row].as_buffer()
            if not some.all():
                chosen = np.cumsum(_unpack(blocks["targets"][row]))[some]
                targets, got = _pack(np.diff(chosen, prepend=0)), got[some]
            for column, x in zip(columns, (blocks["to"][row].as_py(), key, kind, bytes(targets), got.tobytes())):
                column.append(x)
    return rows_of(MESSAGE_SCHEMA, columns)


def received(sent: pa.Table, n: int, add: bool, none: float | int, kind: int = 0) -> np.ndarray:
    """What the messages of a kind come to at each of ``n`` places, in one order for all runs."""
    total = np.full(n, none)
    senders = sent["sender"].to_numpy()
    for row in np.argsort(senders, kind="stable"):
        if sent["kind"][row].as_py() != kind:
            continue
        at = np.cumsum(_unpack(sent["targets"][row]))
        got = np.frombuffer(sent["vals"][row].as_buffer(), dtype=total.dtype)
        # The destinations of one message are distinct.
        total[at] = total[at] + got if add else np.minimum(total[at], got)
    return total
