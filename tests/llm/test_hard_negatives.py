"""Hard negatives against a plain loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import hard_negatives as H
from vertexloom.operators.scratch import Scratch

SCHEMA = "vec_id long, v array<double>, label int, score string"


def brute(rows, every=100):
    chosen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256.0 * x) for x in v]
        old = chosen.get(i)
        if old is None or (label, v) < old[:2]:
            chosen[i] = (label, v, ints)

    def score(a, b):
        return sum(x * y for x, y in zip(chosen[a][2], chosen[b][2]))

    out = []
    for a in chosen:
        if a % every:
            continue
        alike = sorted((-score(a, b), b) for b in chosen if b != a and chosen[b][0] == chosen[a][0])[:5]
        others = sorted((-score(a, b), b) for b in chosen if chosen[b][0] != chosen[a][0])
        for p, b in alike:
            fit = [(-s, c) for s, c in others if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, b, n + 1, c, -p, s) for n, (s, c) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, every=100):
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    result = H.hard_negatives(table, Scratch(spark), F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 64, 70), (65, 31, 33), (40, 40, 40), (0, 4, 3)])
def test_strassen_equals_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (H.strassen(a, b, leaf=4) == a @ b).all()
    big = rng.integers(-(2**40), 2**40, (m, k))
    assert (H.strassen(big, b, leaf=4) == big @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    score = rng.integers(0, 6, (4, 50))
    ids = rng.permutation(50)
    for cuts in ([50], [7, 20, 50], [1, 2, 3, 50]):
        heaps, start = H.Heaps(4, 5), 0
        for stop in cuts:
            heaps.merge(score[:, start:stop], ids[start:stop])
            start = stop
        for r in range(4):
            best = sorted((-s, i) for s, i in zip(score[r], ids))[:5]
            assert list(zip(-heaps.score[r], heaps.id[r])) == best


def test_equals_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", 60)
    monkeypatch.setattr(H, "ANCHOR_GROUP", 3)
    monkeypatch.setattr(H, "CANDIDATE_GROUP", 100)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(0, 900, 2)]
    result = found(spark, rows)
    assert result == brute(rows) and len(result) > 50


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.9], 2), (100, [1.0, 1.0], 1), (200, None, 1),
        (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1), (500, [None, 1.0], 1), (600, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, [0.1, 0.9], 3), (4, [0.0, 0.0], 1),
        (5, [-1.0, -1.0], 1), (6, [1e30, 1.0], 7), (700, [1e30, -1e30], 7), (8, [1e12, 1e12], 1), (9, [3e11, 4e11], 2),
        (10, [], 1), (11, [1.0], 2),
    ]
    plain = [r for r in rows if r[0] not in (6, 700, 8, 9)]
    assert found(spark, plain) == brute(plain)
    wide = [r for r in rows if r[0] not in (6, 700)]
    assert found(spark, wide) == brute(wide)  # products up to 10**29 beside small ones
    found(spark, rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
