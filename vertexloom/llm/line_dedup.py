"""Removal of repeated runs of lines by winnowing.

A run counts as repeated if it has ``min_words`` words or more and the same lines
in the same order stand at an earlier place, in order of document id and line.
All its lines are deleted there; the earliest copy of every line stays.

1. For each line, the window of lines from it on that first reaches
   ``min_words`` words elects the line with the smallest hash (the last of equal
   ones).  Lines elected are the document's fingerprints.  Copies of a run elect
   the same lines, so a repeated run cannot be missed: it holds a whole window.
2. Fingerprints are joined over all documents; only windows whose fingerprint
   stands at more than one place go on.
3. Matches are extended both ways.  A repeated run is covered by the windows that
   start at its lines and those that end at them, so it is enough to find, for
   each such window, the earliest place of the same lines.  That needs one row
   per window and no pairs of places: a passage that a third of all documents
   share costs as many rows as it has places.
4. Lines in a window with an earlier copy are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.scratch import Scratch

MIN_WORDS = 25

WINDOWS = "doc_id long, text_hash long, fingerprint long, elected int, first int, last int, content long"


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def line_windows(hashes: list[int], words: list[int], min_words: int) -> set[tuple[int, int]]:
    """``(first, last)`` of the shortest windows with ``min_words`` words, from each line on and back."""
    found, stop, total = set(), 0, 0
    for start in range(len(hashes)):
        while stop < len(hashes) and total < min_words:
            total += words[stop]
            stop += 1
        if total < min_words:
            break
        found.add((start, stop - 1))
        total -= words[start]
    start, total = 0, 0
    for stop in range(len(hashes)):
        total += words[stop]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            found.add((start, stop))
    return found


def _windows_of(text: str, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(fingerprint, elected, first, last, content)``; blank lines are skipped over."""
    import numpy as np
    import xxhash

    at, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        parts = line.split()
        if parts:
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(parts)))
            words.append(len(parts))
    windows = line_windows(hashes, words, min_words)
    if not windows:
        return []
    packed = np.array(hashes, np.uint64).tobytes()
    rows = []
    for first, last in windows:
        if first == last:
            elected, content = first, hashes[first]
        else:
            elected = min(range(first, last + 1), key=lambda i: (hashes[i], -i))
            content = xxhash.xxh3_64_intdigest(packed[8 * first : 8 * last + 8])
        rows.append((hashes[elected] - (1 << 63), at[elected], at[first], at[last], content - (1 << 63)))
    return rows


def repeated_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_hash, lines)``: numbers of the lines to delete, ascending.

    Only documents with such lines have a row.  Rows with the same id and text
    are one document.
    """

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in WINDOWS.split(", ")]
        for batch in batches:
            rows = []
            for owner, key, text in zip(batch["doc_id"].array, batch["text_hash"].array, batch["text"].array):
                if not pd.isna(text):
                    owner = None if pd.isna(owner) else int(owner)
                    rows.extend((owner, key, *w) for w in _windows_of(text, min_words))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    own = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    windows = scratch.save(own.mapInPandas(run, WINDOWS), "windows")

    place = F.struct("doc_id", "text_hash", "elected")
    shared = (
        windows.groupBy("fingerprint")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("fingerprint")
    )
    matched = windows.join(shared, "fingerprint", "left_semi")
    matched = scratch.save(matched.select("doc_id", "text_hash", "first", "last", "content"), "matched")

    place = F.struct("doc_id", "text_hash", "first")
    earliest = matched.groupBy("content").agg(F.min(place).alias("origin"), F.max(place).alias("final"))
    earliest = earliest.where(F.col("origin") != F.col("final")).drop("final")
    later = matched.join(earliest, "content").where(F.col("origin") != place)
    lines = later.select("doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    return lines.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated runs, and the column ``__removed`` (line numbers).

    All other columns stay as they are.  A document that loses every line keeps
    its row with an empty text; null texts stay null; rows without an id come
    before all others; several rows with the same id and text are treated alike
    and do not count as copies of each other.
    """
    removed = repeated_lines(docs, scratch, min_words).select(
        F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), F.col("lines").alias("__lines")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (text_hash() == F.col("__text_hash"))
    joined = docs.join(removed, same, "left")
    gone = F.coalesce("__lines", F.array().cast("array<int>"))
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines"))
    # The lambda's variable holds the split lines, so that a text is split once.
    parts = F.array(F.struct(lines.alias("line"), places.alias("at")))
    kept = F.transform(parts, lambda p: F.array_join(F.transform(p["at"], lambda i: F.get(p["line"], i)), "\n"))[0]
    columns = [
        F.when(F.size(gone) > 0, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return joined.select(*columns, gone.alias("__removed"), F.size(lines).alias("__n_lines"))
