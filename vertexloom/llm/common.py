"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOLD_OUT = 5  # one row in so many is held out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by five; false for a null id."""
    remainder = F.crc32(F.col(doc_id).cast("string")) % HOLD_OUT
    return F.coalesce(remainder == 0, F.lit(False))


def trainable(doc_id: str = "doc_id") -> Column:
    """Rows a model may learn from: those with an id that is not held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def sampled(key: Column, n_rows: int, wanted: int) -> Column:
    """Keep about ``wanted`` of ``n_rows`` rows, chosen by a hash of their key."""
    share = min(1.0, wanted / max(n_rows, 1))
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1


def fair_share(df: DataFrame, n_rows: int, least: int = 1_000) -> int:
    """Rows of one key above which it is hot: more than a partition's share of all rows."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_rows // partitions))


def release_memory() -> None:
    """Give memory that a worker has freed back to the system.

    Workers stay when their task has ended, and the allocators keep what was freed.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def mix64(x):
    """Scramble an array of uint64 hashes (a bijection of 64-bit numbers)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, looked up on the machine that reads it."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
