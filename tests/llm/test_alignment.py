"""Cross-tokenizer alignment against a plain loop over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vertexloom.llm import alignment as A
from vertexloom.llm.tokenizing import byte_letters
from vertexloom.operators.scratch import Scratch

SIDE_A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
SIDE_A.encode_special_tokens = True
SIDE_B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
BYTES = {letter: byte for byte, letter in byte_letters().items()}


def b_bytes(i):
    piece = SIDE_B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if SIDE_B.is_byte(i) else piece.replace("▁", " ").encode()


def aligned(text):
    """(ids of A, ids of B, links, groups) of a whole text, or nothing."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    a = SIDE_A.encode(" " + text, add_special_tokens=False).ids
    b = SIDE_B.encode(text)
    sides = [[bytes(BYTES[x] for x in SIDE_A.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
    if b"".join(sides[0]) != whole or b"".join(sides[1]) != whole:
        return [], [], [], []
    spans = [[], []]
    for tokens, own in zip(sides, spans):
        at = 0
        for t in tokens:
            own.append((at, at + len(t)))
            at += len(t)
    links, j = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < e:
            links.append((a[i], b[k]))
            k += 1
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for end in ends:
        parts = [",".join(str(x) for x, (s, e) in zip(ids, own) if start < e <= end) for ids, own in zip((a, b), spans)]
        groups.append("|".join(parts))
        start = end
    return a, b, links, groups


def brute(rows):
    found = [(i, *aligned(t)) for i, t in rows]
    count = Counter(k for *_, links, _ in found for k in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (i, len(a), len(b), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
            for i, a, b, links, groups in found
        ),
        key=str,
    )


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_a string, row int")
    return sorted((tuple(r) for r in A.align_documents(table.repartition(3), Scratch(spark), **options).collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  blanks  "), (5, "a trailing blank "), (6, "\n\ttabs \n lines\n\n x"), (7, "<|endoftext|> is text, <s> too"),
    (8, "a mark ▁ inside"), (9, "▁"), (10, "日本語 のテキスト 😀😀"), (11, "<0x41> no byte"), (12, "zero\x00 \x1c \x85 \xa0 　 x"),
    (13, "same text"), (13, "same text"), (None, "same text"), (14, "don't we'll 1234567 abc_def é é"), (15, "x" * 5000), (16, "ab " * 3000), (17, "漢" * 3000),
    (18, "ﬁ ligature ½ ™ fullwidth ＡＢ"), (19, "right​zero ﻿mark ‮back"), (20, "x  y  z"),
]


@pytest.mark.parametrize("listed", [A.LISTED_PAIRS, 0])
def test_equals_plain_loop(spark, monkeypatch, listed):
    monkeypatch.setattr(A, "FAN_IN", 2)  # trees of several levels
    monkeypatch.setattr(A, "fair_share", lambda df, n: 20)
    rng = random.Random(4)
    words = ["the", "running", "Straße", "über,", "tokenization.", "naïve", "12", "\n\nA", "zq", "piñata", "l'été", "(x)"]
    rows = ODD + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(120)]
    result = found(spark, rows, listed_pairs=listed)
    assert result == brute(rows)
    assert any(r[4] > r[3] for r in result) and any(0 < r[5] < r[4] for r in result)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab eéß1_'.\n\t 　日▁<0x>A")), max_size=40))
def test_stretches_equal_whole_texts(text):
    own = A.aligner("byte_bpe_50k.json", "piece_bpe_32k.model", True)
    batch = A._Batch(own, [text])
    a, b, links, groups = aligned(text)
    digest = [int(v[0]) for v in batch.digests().values()]
    expected = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
    assert batch.group_hashes() == [expected]
    assert digest == [len(a), len(b), len(groups), len(links)]
    pairs = own.pair_keys()[batch.document_pairs()[1]].tolist()
    assert sorted(pairs) == sorted({x << 32 | y for x, y in links})


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n).astype(np.uint64))
    hash_of = A.PerfectHash.of(keys)
    again = A.PerfectHash(hash_of.sizes, hash_of.bits)
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))


def test_memory_is_bounded():
    own = A.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), limit=100_000)
    rng, sizes = random.Random(1), []
    for _ in range(30):
        if own.full:
            own.clear()
        own.read([" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(100))])
        sizes.append(own.size)
    assert max(sizes) < 300_000 and min(sizes[1:]) < max(sizes)
