"""Token ids in fixed-width bit packing.

A store is a folder of files written and read by Spark.  Each row is a block of
consecutive documents in ascending id order: the ids in as few bits each as the
vocabulary needs, little end first, behind the number of ids before each
document.  Any id or document of a block can be read without the rest, and a
shard's blocks know how many ids of the shard precede them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.tokenizing import encoder

BLOCK_IDS = 1 << 18  # a block ends with the document that reaches so many ids

SCHEMA = (
    "shard int, block int, width int, n_ids long, first_id long, "
    "doc_ids array<long>, doc_offsets array<long>, payload binary"
)


def id_width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Bit-pack ids; id ``n`` lies in the bits from ``n * width`` on.

    The positions repeat after as many ids as fill whole 64-bit words, so one
    vectorised step places every id of the same position within that cycle.
    """
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("id beyond the vocabulary")
    lanes, words = 64 // math.gcd(64, width), width // math.gcd(64, width)
    padded = np.zeros(-(-len(ids) // lanes) * lanes, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(-1, lanes)
    out = np.zeros((len(padded), words), "<u8")
    for lane in range(lanes):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= padded[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= padded[:, lane] >> np.uint64(64 - shift)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_ids(payload: bytes, width: int, n_ids: int) -> np.ndarray:
    """All ids of a packed block, by the same steps as :func:`pack_ids`."""
    lanes, words = 64 // math.gcd(64, width), width // math.gcd(64, width)
    cycles = -(-n_ids // lanes)
    packed = np.zeros(8 * cycles * words, np.uint8)
    packed[: len(payload)] = np.frombuffer(payload, np.uint8)
    packed = packed.view("<u8").reshape(cycles, words)
    out = np.empty((cycles, lanes), "<u4")
    for lane in range(lanes):
        word, shift = divmod(lane * width, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= packed[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n_ids]


def read_ids(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block; only their bytes are touched."""
    if stop <= start:
        return np.zeros(0, "<u4")
    first, last = start * width // 8, -(-stop * width // 8)
    raw = np.zeros(last - first + 8, np.uint8)
    raw[: last - first] = np.frombuffer(payload, np.uint8)[first:last]
    bit = np.arange(start, stop, dtype=np.int64) * width - first * 8
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(stop - start, np.uint64)
    for k in range((width + 14) // 8):
        value |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype("<u4")


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    vocabulary: int = 50_257,
) -> None:
    """Encode all documents and write them in ascending ``doc_id`` order.

    Null ids come first; rows with the same id are ordered by a hash of their
    text.  Null texts are empty: the end id alone.  Columns other than doc_id and
    text are not read.
    """
    width = id_width(vocabulary)

    def run(batches):
        import pandas as pd

        encode = encoder(tokenizer).each
        end = np.array([end_id], "<u4")
        shard = TaskContext.get().partitionId()
        block, before, parts, owners, offsets = 0, 0, [], [], [0]

        def flush():
            ids = np.concatenate(parts)
            row = (shard, block, width, len(ids), before, owners, offsets, pack_ids(ids, width))
            return pd.DataFrame([row], columns=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for owner, found in zip(batch["doc_id"].array, encode(batch["text"].array)):
                ids = np.concatenate([found, end])
                parts.append(ids)
                owners.append(None if pd.isna(owner) else int(owner))
                offsets.append(offsets[-1] + len(ids))
                if offsets[-1] >= BLOCK_IDS:
                    yield flush()
                    block, before, parts, owners, offsets = block + 1, before + offsets[-1], [], [], [0]
        if owners:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = own.withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInPandas(run, SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of a store, ``ids`` as packed uint32 bytes."""
    return _read(spark, path, "ids binary", lambda ids: ids.tobytes())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files of a store."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def _read(spark: SparkSession, path: str, column: str, digest) -> DataFrame:
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # One small row per shard; a shard is an output partition of the writer.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, total = {}, 0
    for row in totals:
        starts[row["shard"]] = total
        total += row["n"]

    def run(batches):
        import pandas as pd

        name = column.split()[0]
        for batch in batches:
            for b in batch.itertuples(index=False):
                at = starts[b.shard] + b.first_id
                bounds = np.asarray(b.doc_offsets, np.int64)
                rows = {"doc_id": pd.array(list(b.doc_ids), "Int64"), "start": at + bounds[:-1], "n_tokens": np.diff(bounds)}
                ids = unpack_ids(b.payload, b.width, b.n_ids)
                rows[name] = [digest(ids[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pd.DataFrame(rows)

    return blocks.mapInPandas(run, f"doc_id long, start long, n_tokens long, {column}")
