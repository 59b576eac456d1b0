"""Methods of the operators on small inputs, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vertexloom.llm import byte_bpe, dart_minhash, language_id, line_dedup, packing, token_store
from vertexloom.llm.cap_filters import CapCode
from vertexloom.llm.tokenizing import encoder

ODD = ["", "a", "  a  b ", "x \n y", "\t a", "a\x1c b", "²½ Ⅷ ", "<|endoftext|> hi", "日本語  テ", "😀 don't we'll", "\r\n x"]
LETTERS = st.text(alphabet=" \n\t\x1c\x85 aAéß1²'.,!_日😀s", max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=LETTERS)
def test_memoised_ids_equal_the_library(library, text):
    assert encoder("byte_bpe_50k.json").ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, reference_bpe, text):
    assert encoder("byte_bpe_50k.json").ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert byte_bpe.text_encoder("byte_bpe_50k.tiktoken", None).ids(text).tolist() == reference_bpe.encode_ordinary(text)


def test_every_token_string_encodes_to_itself():
    e = encoder("byte_bpe_50k.json")
    assert [t for t, i in e.tokens.items() if t != "<|endoftext|>" and [k.id for k in e.model.tokenize(t)] != [i]] == []


@settings(max_examples=300, deadline=None)
@given(text=LETTERS)
def test_prefix_encoding_equals_merging(reference_bpe, text):
    e = byte_bpe.text_encoder("byte_bpe_50k.tiktoken", None)
    ids = e.ids(text)
    assert ids.tolist() == reference_bpe.encode_ordinary(text)
    assert e.bpe.decode(ids) == text.encode()


def test_appends_and_edits_equal_encoding_anew():
    bpe = byte_bpe.text_encoder("byte_bpe_50k.tiktoken", None).bpe
    rng = random.Random(3)
    prefixes = byte_bpe.Prefixes(bpe, b"tokens of a wonderful world " * 20)
    prefixes.append(b"and more tokens")
    assert prefixes.last == bpe.last_tokens(prefixes.text)
    redone = []
    for _ in range(100):
        start = rng.randrange(len(prefixes.text))
        stop = min(len(prefixes.text), start + rng.randrange(4))
        redone.append(prefixes.replace(start, stop, bytes(rng.choice(b"abcde tokens") for _ in range(rng.randrange(4)))))
        assert prefixes.last == bpe.last_tokens(prefixes.text)
    assert np.median(redone) < len(prefixes.text) / 2


@pytest.mark.parametrize("width", [1, 3, 7, 8, 15, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype("<u4")
    packed = token_store.pack_ids(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert (token_store.read_ids(packed, width, 0, 1000) == ids).all()
    assert (token_store.read_ids(packed, width, 123, 777) == ids[123:777]).all()
    assert len(token_store.read_ids(packed, width, 5, 5)) == 0


@pytest.mark.parametrize("cut", [True, False])
def test_packing_keeps_every_token_within_the_limits(cut):
    rng = np.random.default_rng(1)
    examples = [(i, rng.integers(0, 50_000, n).astype("<u4"), rng.random(n) < 0.7) for i, n in enumerate(rng.integers(1, 5000, 300))]
    limits = packing.Limits(2048, 12, 1200)
    sequences = list(packing.pack(iter(examples), limits, cut, pool_size=64))
    seen = {i: [] for i, _, _ in examples}
    for pieces in sequences:
        assert sum(len(p.ids) for p in pieces) <= 2048 and len(pieces) <= 12
        assert sum(int(p.loss.sum()) for p in pieces) <= 1200
        for p in pieces:
            seen[p.owner].append((p.start, p.ids))
    for i, ids, _ in examples:
        parts = sorted(seen[i], key=lambda x: x[0])
        assert [s for s, _ in parts] == np.cumsum([0] + [len(x) for _, x in parts])[:-1].tolist()
        assert np.array_equal(np.concatenate([x for _, x in parts]), ids)


def test_packing_without_loss_limit_wastes_nothing():
    rng = np.random.default_rng(2)
    examples = [(i, np.zeros(n, "<u4"), np.ones(n, bool)) for i, n in enumerate(rng.integers(1, 4000, 500))]
    sizes = [sum(len(p.ids) for p in s) for s in packing.pack(iter(examples), packing.Limits(), True)]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n != 2048 for n in sizes) <= 11


def test_signatures_agree_as_often_as_weighted_sets_are_alike():
    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        n = rng.integers(20, 300)
        ids = np.sort(dart_minhash.mix64(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        weights = rng.exponential(2, n) + 0.01
        some = rng.random(n) < 0.9
        a, b = (ids, weights), (ids[some], (weights * rng.choice([1, 1, 0.5, 2], n))[some])
        true = dart_minhash.similarity(a, b)
        found = dart_minhash.signatures([a, b], 400)
        errors.append(((found[0] == found[1]).mean() - true) / np.sqrt(true * (1 - true) / 400))
    assert abs(np.mean(errors)) < 0.5 and np.std(errors) < 1.6


def test_shingles_follow_words():
    assert len(dart_minhash.shingles("a b c d e f")) == 2
    assert len(dart_minhash.shingles(" a  b ")) == 1 and len(dart_minhash.shingles(" \n")) == 0
    assert dart_minhash.shingles("a b\nc d e") == dart_minhash.shingles("  a b c  d e ")
    assert dart_minhash.shingles("a b c d e") != dart_minhash.shingles("a b c e d")


def test_close_pairs_share_a_cap():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    code = CapCode.of(64, 50_000, 0.9, 5)
    books = code.books()
    shared = [len(np.intersect1d(x, y)) for x, y in zip(code.decode(a, books), code.decode(b, books))]
    assert np.mean(np.array(shared) == 0) <= 0.02


def test_viterbi_equals_trying_all_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(50):
        scores = -rng.random((6, 3)) * 6
        cost = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(cost, product(range(3), repeat=6)))
        assert cost(language_id.viterbi(scores, 4.0)) == pytest.approx(best)


def test_windows_cover_every_repeated_run():
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 15))]
        windows = line_dedup.line_windows(list(range(len(words))), words, 20)
        for a in range(len(words)):
            for b in range(a, len(words)):
                if sum(words[a : b + 1]) >= 20:
                    inside = [w for w in windows if a <= w[0] and w[1] <= b]
                    assert {i for x, y in inside for i in range(x, y + 1)} == set(range(a, b + 1))


def test_digest_of_ids():
    ids = byte_bpe.text_encoder("byte_bpe_50k.tiktoken", None).ids("hello world")
    assert hashlib.sha256(ids.tobytes()).hexdigest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_only_letters_are_letters():
    parts = language_id.split_words(["😀😀", "🎉", "𝒜𝒷", "𠀀字", "a1", "12", "﷽"])
    assert parts.letters.tolist() == [0, 0, 2, 2, 1, 0, 0]


def test_texts_without_blanks_fill_no_memory():
    """Stretches without blanks are encoded and forgotten, whatever their number."""
    e = encoder("byte_bpe_50k.json")
    bpe = byte_bpe.text_encoder("byte_bpe_50k.tiktoken", None)
    rng = random.Random(7)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200)) for _ in range(2_000)]
    memories = [e.after_blank, e.other, bpe.first, bpe.rest]
    before = [m.size for m in memories], [len(m.known) for m in memories]
    for at in range(0, len(texts), 100):
        e.batch(texts[at : at + 100])
        bpe.batch(texts[at : at + 100])
    assert ([m.size for m in memories], [len(m.known) for m in memories]) == before


def test_memory_starts_afresh_beyond_its_limit():
    from vertexloom.llm.tokenizing import Memory

    made = []
    memory = Memory(lambda words: [made.append(w) or w.encode() for w in words], limit=2_000)
    for turn in range(50):
        words = [f"w{turn}-{i}" for i in range(5)] + ["often", "x" * 1_000]
        assert memory.of([words, ["often"]]) == [[w.encode() for w in words], [b"often"]]
        assert memory.size <= 2_000 + 6 * 200 and "x" * 1_000 not in memory.known
    assert 2 < made.count("often") < 50 and made.count("x" * 1_000) == 50


def test_short_texts_are_packed_without_padding():
    examples = ((i, np.full(3, i, "<u4"), np.ones(3, bool)) for i in range(12_000))
    sequences = list(packing.pack(examples, packing.Limits(), True))
    sizes = [sum(len(p.ids) for p in s) for s in sequences]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert sum(sizes) == 36_000 and padded < 0.05 * 36_000
    assert max(len(s) for s in sequences) <= 256 and max(sizes) <= 2048


def test_a_word_is_not_encoded_again_with_a_line_break_beside_it():
    """Words end at line breaks as well, and ids are those of whole texts (op6_packing)."""
    from tokenizers import Tokenizer

    from vertexloom.llm.common import tokenizer_file
    from vertexloom.llm.tokenizing import Encoder

    path = tokenizer_file("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), Encoder(path)
    given, whole = [], e.chunks
    e.chunks = lambda chunks: given.extend(chunks) or whole(chunks)
    e.batch(["a qwerty\nqwerty Zürich\nqwerty"])
    assert set(given) == {" qwerty", " Zürich", "\nqwerty"}
    texts = [
        "a qwerty, qwerty. qwerty\nqwerty! Zürich?\nZürich\nit's, it's) 42.",
        "x², x²\n日本, a¹. é́, ñ̸= qwerty'. 'll, '. ,a .\na",
        "a\n\nb,\n\n\nc. \nd\r\ne\n f\n", "\na.\n", "a,\n", " \n", "\n", "a \n", "a\t\nb \n\n c.", "a \nb  c　 d",
        "a... b.. c... _a_, a_. a\u0085\nb a  b",
    ]
    for text in texts:
        assert e.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "7", "²", " ", "\n", ",", ".", "'", "s", "_", "\t", "\r", " ", "日", "́", "\x1c", "“", "*"]
    for _ in range(4_000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 14)))
        assert e.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_match_goes_to_the_library_once_a_batch():
    """The same word with other marks beside it is not encoded again (op6_packing)."""
    from tokenizers import Tokenizer

    from vertexloom.llm.common import tokenizer_file
    from vertexloom.llm.tokenizing import Encoder

    path = tokenizer_file("byte_bpe_50k.json")
    e, given = Encoder(path), []

    class Recorder:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts):
            given.extend(m for t in texts for m in t.split(e.divider))
            return self.model.encode_batch_fast(texts)

    e.pieces_only = Recorder(e.pieces_only)
    texts = ["a qwerty, qwerty. qwerty!", "b qwerty", None, "", "a  qwerty? qwerty\n", "c "] * 3
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in e.each(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    rest = [m for m in given if m.endswith("qwerty")]
    assert len(rest) <= 2  # after blanks, and in the texts of double blanks


def test_a_worker_gives_back_what_it_no_longer_needs():
    """Rare words of a task stay in no memory of its worker (pipeline, op6_packing)."""
    import re
    from pathlib import Path

    from vertexloom.llm.common import tokenizer_file
    from vertexloom.llm.tokenizing import Encoder

    def megabytes():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("needs Linux")
    e, rng = Encoder(tokenizer_file("byte_bpe_50k.json")), random.Random(5)
    list(e.each(["some words", "others"]))
    texts = (" ".join(f"{rng.getrandbits(40):x}" for _ in range(1_000)) for _ in range(500))
    before = megabytes()
    for _ in e.each(texts):
        pass
    assert megabytes() - before < 50


class Recorder:
    """A tokenizer that keeps what it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_rare_match_far_on_is_not_encoded_again():
    """Texts are encoded in batches of 8 M characters, so a task's rare words seldom come twice (op9_token_files)."""
    from vertexloom.llm.common import tokenizer_file
    from vertexloom.llm.tokenizing import Encoder

    e = Encoder(tokenizer_file("byte_bpe_50k.json"))
    e.pieces_only = Recorder(e.pieces_only)
    texts = ["a b" * 50_000 + " zxqwerty."] + ["a b" * 50_000] * 40 + ["c zxqwerty, d"]
    assert len(list(e.each(texts))) == 42
    assert [m for call in e.pieces_only.calls for t in call for m in t.split(e.divider)].count("Ġzxqwerty") == 1


def test_calls_with_whole_words_are_small():
    """The library gets words of other alphabets in calls of bounded size (op9_token_files)."""
    from vertexloom.llm.common import tokenizer_file
    from vertexloom.llm.tokenizing import Encoder

    path = tokenizer_file("byte_bpe_50k.json")
    library, e, rng = Tokenizer.from_file(path), Encoder(path), random.Random(2)
    texts = [" ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(9)) for _ in range(500)) for _ in range(80)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    e.tokenizer = Recorder(e.tokenizer)
    assert [x.tolist() for x in e.batch(texts)] == expected
    assert max(sum(map(len, call)) for call in e.tokenizer.calls) < 200_000


def test_matches_start_where_the_public_pattern_says():
    """Plain strings side by side are split each by itself (op9_token_files)."""
    import pyarrow as pa
    import regex

    from vertexloom.llm import tokenizing

    rng, pattern = random.Random(9), regex.compile(P.PATTERN)
    alphabet = [*"aB7_.'stmdrevl\n ", "é", "œ", "Ÿ", "ß", "'re", "'ll", "'s", "  "]
    for _ in range(3_000):
        strings = ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        raw, begin = tokenizing._buffers(pa.array(strings, pa.large_string()))
        starts = [*tokenizing.piece_starts(raw, begin).tolist(), len(raw)]
        expected = [m for s in strings for m in pattern.findall(s)]
        assert [bytes(raw[a:b]).decode() for a, b in zip(starts, starts[1:])] == expected, strings
    every = [chr(c) for c in range(0xD800)] + [chr(c) for c in range(0xE000, 0x11000)] + ["😀", "", "aé", "é×", "a\x7f"]
    good = tokenizing.plain(*tokenizing._buffers(pa.array(every, pa.large_string()))).tolist()
    assert [c for c, g in zip(every, good) if g] == [
        c for c in every if regex.fullmatch("[\\n -~À-ÖØ-öø-ÿŒœŠšŽžŸ]*", c)
    ]


def test_a_block_is_decoded_at_once():
    """Reading a store unpacks each block in one go, with the ids of reading it in parts (op9_token_files)."""
    rng = np.random.default_rng(3)
    for width in (1, 7, 16, 17, 32):
        for n in (0, 1, 63, 64, 1_001):
            ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4")
            found = token_store.unpack_ids(token_store.pack_ids(ids, width), width, n)
            assert found.dtype == "<u4" and found.tolist() == ids.tolist()
