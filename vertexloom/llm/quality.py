"""Text quality by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text.
A text that resembles one of them compresses better with it.  The difference of
the two compressed sizes, per byte of the text, is the feature; a logistic curve
fitted on labelled documents that neither dictionary has seen turns it into a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import sampled, trainable

SAMPLE_DOCS = 2_000  # labelled documents of each class, about; half for the dictionary
DICTIONARY_BYTES = 64 << 10
SAMPLE_PIECE = 2_000  # characters of a training sample of the dictionary
THRESHOLD = 0.3
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """``slopes`` for the size difference, the better ratio and the text's log length, then the offset."""

    good: bytes
    bad: bytes
    slopes: tuple[float, ...]
    offset: float

    def scores(self, texts) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        x = features(texts, self.good, self.bad)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.slopes) + self.offset, -30, 30)))


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    return tuple(
        zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO),
            write_content_size=False,
            write_dict_id=False,
        )
        for d in (good, bad)
    )


def features(texts, good: bytes, bad: bytes) -> np.ndarray:
    """One row per text; null and empty texts give zeros."""
    by_good, by_bad = _compressors(good, bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        raw = text.encode()
        g, b = len(by_good.compress(raw)), len(by_bad.compress(raw))
        out[i] = (b - g) / len(raw), min(g, b) / len(raw), np.log(len(raw))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge-damped Newton steps on standardised features."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return slopes, float(w[-1] - slopes @ mean)


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    pieces = [t[i : i + SAMPLE_PIECE].encode() for t in texts for i in range(0, len(t), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: its raw bytes serve
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on about ``sample_docs`` labelled documents of each class.

    Rows that are held out, unlabelled or empty teach nothing, and contradictory
    labels of a document are left out.  Without both classes every text gets the
    share of good labels (0.5 if there are none).
    """
    marks = (
        labels.where(trainable() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("__most"))
        .where(F.col("quality") == F.col("__most"))
        .drop("__most")
    )
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = sum(counts.values())
    share = min(max(counts.get(1, 0) / n_all, 0.01), 0.99) if n_all else 0.5
    constant = QualityModel(b"", b"", (0.0, 0.0, 0.0), float(np.log(share / (1 - share))))
    if len(counts) < 2:
        return constant
    chosen = F.lit(False)
    for quality, n in counts.items():
        chosen |= (F.col("quality") == quality) & sampled(F.col("doc_id"), n, sample_docs)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = (
        own.join(F.broadcast(marks.where(chosen)), "doc_id")  # 2 * sample_docs short rows
        .where(F.length("text") > 0)
        .select("doc_id", "quality", "text", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half"))
        .collect()  # bounded by sample_docs
    )
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    by = {q: [r["text"] for r in rows if r["quality"] == q and r["half"] == 0] for q in (0, 1)}
    if not by[0] or not by[1]:
        by = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        return constant
    good, bad = _dictionary(by[1]), _dictionary(by[0])
    fit = [r for r in rows if r["half"] == 1] or rows
    x = features([r["text"] for r in fit], good, bad)
    y = np.array([r["quality"] for r in fit], float)
    # The sample takes equal numbers of both classes; weights by counts restore the base rate.
    slopes, offset = _logistic(x, y)
    seen = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    offset += float(np.log((counts[1] / seen[1]) / (counts[0] / seen[0])))
    return QualityModel(good, bad, tuple(slopes.tolist()), offset)


def quality_score(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Probability that a text is good, from 0 to 1; null counts as empty.

    Empty texts get the score of the fitted curve for zero features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return score(F.col(text).cast("string"))
