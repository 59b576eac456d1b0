"""Encoding with a public byte-level BPE file, remembered by word.

Text between two blanks is encoded independently of its surroundings: the
tokenizer's pattern never matches across the start of a blank that follows
something other than white space.  A worker therefore encodes each distinct word
of a large batch of texts once, and of these each distinct match of the pattern
once.  It keeps the ids of words that are frequent in a batch.  Texts with the
strings of special tokens go to the library whole.

What is kept is bounded by its size in memory, and long stretches without blanks
are never kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from vertexloom.llm.common import release_memory, tokenizer_file

MEMORY = 48 << 20  # bytes one memory of words may take, about; then it starts afresh
LONGEST = 64  # characters of the longest stretch that is remembered
ENTRY = 170  # bytes an entry takes besides its content, about
BATCH_CHARS = 1 << 20  # texts handled at once have so many characters, or are one text
ENCODED_CHARS = 1 << 23  # the same for the encoder
WHOLE_CHARS = 1 << 17  # the same for texts the library gets whole
FREQUENT = 4  # words that occur so often in a batch are remembered
WORDS = 1 << 18  # words whose ids are put together at once, or those of one text
MATCHES = 10_000  # matches of the pattern the library gets in one call

#: Classes of bytes for the public pattern; all other bytes begin or continue a letter.
OTHER, DIGIT, BLANK, LETTER = range(4)
CLASSES = np.full(256, LETTER, np.uint8)
CLASSES[ord(" ") : ord("~") + 1] = [
    BLANK if c == " " else DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER for c in map(chr, range(ord(" "), ord("~") + 1))
]
CLASSES[ord("\n")] = BLANK
#: Characters whose classes these are, besides those of ASCII: pairs of bytes as numbers.
PLAIN_PAIRS = np.zeros(1 << 16, bool)
PLAIN_PAIRS[[int.from_bytes(c.encode()) for c in "ŒœŠšŽžŸ" + "".join(map(chr, range(0xC0, 0x100))) if c not in "×÷"]] = True
PLAIN_BYTES = np.zeros(256, bool)
PLAIN_BYTES[[ord("\n"), *range(ord(" "), ord("~") + 1)]] = True
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
ASCII_SPACES = [c for c in SPACES if c.isascii()]
WORD_STARTS = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


def after_space(text: str, what: str) -> bool:
    """Whether ``what`` follows white space anywhere in the text."""
    spaces = ASCII_SPACES if text.isascii() else SPACES
    return any(c in text and c + what in text for c in spaces)  # one letter is found faster than two


def blanks_alone(text: str) -> bool:
    """Whether every blank of the text follows something other than white space."""
    return not after_space(text, " ")


def text_batches(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Texts, null ones empty, in lists of about ``chars`` characters."""
    batch, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        batch.append(text)
        size += len(text) + 1
        if size >= chars:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class _Known(dict):
    """Values by word; a word asked for in vain is noted and stands for itself."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> str:
        self.new.append(word)
        self[word] = word
        return word


class Memory:
    """What ``make`` returns for words, made for all new words of a batch at once.

    ``of(lists)`` has the values of words in place of the words.  Long words are
    forgotten again after the call.  ``weigh`` is the size of a value in bytes.
    Values must not be strings.
    """

    def __init__(self, make: Callable[[list[str]], list], weigh=len, limit: int = MEMORY):
        self.make, self.weigh, self.limit = make, weigh, limit
        self.known = _Known()
        self.size = 0

    def of(self, lists: list[list[str]]) -> list[list]:
        known = self.known
        if self.size > self.limit:
            known.clear()
            self.size = 0
        look_up = known.__getitem__
        found = [list(map(look_up, words)) for words in lists]
        new = known.new
        if not new:
            return found
        known.new = []
        values = self.make(new)
        known.update(zip(new, values))
        found = [[look_up(x) if x.__class__ is str else x for x in row] for row in found]
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(map(self.weigh, values))
        for word, value in zip(new, values):
            if len(word) > LONGEST:
                del known[word]
                self.size -= ENTRY + len(word) + self.weigh(value)
        return found


def _after_spaces(texts, what: str) -> list[bool]:
    """:func:`after_space` of each text of an Arrow array."""
    import pyarrow.compute as pc

    pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]" + what
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).tolist()


def _runs(bounds: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """First and last of texts that have about so many words together; ``bounds`` has where each text's words end."""
    first = 0
    while first < len(bounds):
        before = bounds[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(bounds, before + words, side="right")))
        yield first, last
        first = last


def _buffers(strings) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of large strings or binaries, and where each begins, with the end."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    begin = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, begin - begin[0]


def plain(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which of the strings side by side in ``raw`` have plain characters only."""
    odd = np.flatnonzero(~PLAIN_BYTES[raw])
    if not len(odd):
        return np.ones(len(begin) - 1, bool)
    value = raw[odd].astype(np.uint16)
    leads = value >= 0xC0
    after = raw[np.minimum(odd + 1, len(raw) - 1)]
    # A lead tells of its character; what is no lead and above 0x7F continues one.
    bad = np.where(leads, ~PLAIN_PAIRS[value << np.uint16(8) | after], value < 0x80)
    of = np.searchsorted(begin, odd[bad], side="right") - 1
    good = np.ones(len(begin) - 1, bool)
    good[of] = False
    return good


def piece_starts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the matches of the public pattern start in plain, non-empty strings side by side."""
    kind = CLASSES[raw]
    first = np.zeros(len(raw) + 3, bool)  # of a string
    first[begin] = True
    white = np.zeros(len(raw) + 1, bool)
    np.equal(kind, BLANK, out=white[:-1])
    now, before = white[1:-1], white[:-2]
    start = first[: len(raw)].copy()
    # Of several blanks the last one is left to what follows, unless the string ends there.
    start[1:] |= np.where(now, ~before | ~(white[2:] | first[2 : len(raw) + 1]), ~before & (kind[1:] != kind[:-1]))
    start[1:] |= ~now & (raw[:-1] == ord("\n"))
    marks = np.flatnonzero((raw == ord("'")) & start)
    if len(marks):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, list(b"stmd")) & ~first[marks + 1]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long &= ~first[marks + 1] & ~first[marks + 2]
        start[marks[short | long] + 1] = False
        behind = np.concatenate([marks[short] + 2, marks[long] + 3])
        start[behind[behind < len(raw)]] = True
    return np.flatnonzero(start)


class Encoder:
    """``batch(texts)`` equals the library's ``encode(text, add_special_tokens=False)``.

    With ``plain_specials`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False, limit: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.letters = byte_letters()
        self.letter_codes = np.array([ord(self.letters[b]) for b in range(256)], "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special and not plain_specials else None
        # The library's model on pieces that are cut already, divided by a letter no piece has.
        self.divider = self.letters[0]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words come here once, so its own cache would be asked in vain
        self.pieces_only = Tokenizer(self.model)
        self.pieces_only.pre_tokenizer = CharDelimiterSplit(self.divider)
        self.tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_length = np.zeros(max(self.tokens.values(), default=0) + 1, np.int64)
        for token, i in self.tokens.items():
            self.token_length[i] = len(token)
        self.after_blank = Memory(self._after_blanks, limit=limit)
        self.other = Memory(self.chunks, limit=limit)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = []
        for some in text_batches(texts, WHOLE_CHARS):  # the library takes some 100 bytes a token
            found += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return found

    def _encode_matches(self, divided: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern side by side, and how many each has: one call of the model.

        The byte 0 stands between matches, and its letter is the divider.
        """
        mapped = self.letter_codes[divided].tobytes().decode("utf-32-le")
        ids = np.array(self.pieces_only.encode_batch_fast([mapped])[0].ids, "<u4")
        return ids, np.diff(self._stops(ids, sizes), prepend=0)

    def _stops(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where stretches of ``sizes`` bytes side by side end among their ids."""
        return np.searchsorted(np.cumsum(self.token_length[ids]), np.cumsum(sizes)) + 1

    def _plain_ids(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain, non-empty strings side by side, and where those of each end.

        Each distinct match of the pattern is encoded once; tokens are dealt out by length.
        """
        import pyarrow as pa

        starts = np.append(piece_starts(raw, begin), len(raw))
        buffers = [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(raw))]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers).dictionary_encode()
        own, bounds = _buffers(coded.dictionary)
        sizes = np.diff(bounds)
        divided = np.zeros(len(own) + len(sizes), np.uint8)
        divided[np.arange(len(own)) + np.repeat(np.arange(len(sizes)), sizes)] = own
        counts, parts = [], []
        for i in range(0, len(sizes), MATCHES):
            stop = min(i + MATCHES, len(sizes))
            found = self._encode_matches(divided[bounds[i] + i : bounds[stop] + stop - 1], sizes[i:stop])
            parts.append(found[0])
            counts.append(found[1])
        stops = 4 * np.cumsum(np.concatenate([[0], *counts]), dtype=np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(np.concatenate(parts))])
        ids = _buffers(values.take(coded.indices))[0].view("<u4")
        return ids, self._stops(ids, np.diff(begin))

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of stretches of text, each by itself.

        Those of plain characters are split by the pattern side by side.
        """
        import pyarrow as pa

        strings = pa.array(chunks, pa.large_string())
        raw, begin = _buffers(strings)
        good = plain(raw, begin) & (np.diff(begin) > 0)
        if not good.all():
            raw, begin = _buffers(strings.filter(pa.array(good)))
        found = []
        if len(raw):
            ids, stops = self._plain_ids(raw, begin)
            raw_ids, stops = ids.tobytes(), (4 * stops).tolist()
            found = [raw_ids[a:b] for a, b in zip([0, *stops], stops)]
        if good.all():
            return found
        single = iter(found)
        whole = iter(self._whole([c for c, g in zip(chunks, good.tolist()) if c and not g]))
        return [next(single) if g else next(whole) if c else b"" for c, g in zip(chunks, good.tolist())]

    def _after_blanks(self, words: list[str]) -> list[bytes]:
        """Ids of words and the blank before them; a line break stands instead of one."""
        return self.chunks([w if w[:1] == "\n" else " " + w for w in words])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian uint32."""
        import pyarrow as pa

        special, heads, rests = [], [], []
        given = pa.array([t.encode() for t in texts], pa.large_binary()).cast(pa.large_string())  # a str would keep its bytes
        doubled, broken = _after_spaces(given, " "), _after_spaces(given, "\n")
        del given
        for text, two_blanks, blank_lines in zip(texts, doubled, broken):
            rests.append(None)
            if self.special is not None and self.special.search(text):
                special.append(text)
                heads.append(None)
            elif not two_blanks and " \n" not in text:
                head, blank, rest = (text if blank_lines else text.replace("\n", " \n")).partition(" ")
                heads.append([head])
                rests[-1] = rest if blank else None
            else:
                heads.append(WORD_STARTS.split(text))
        first = iter(self.other.of([h for h in heads if h is not None]))
        whole = iter(self._whole(special))
        begin = [np.frombuffer(next(whole) if h is None else b"".join(next(first)), "<u4") for h in heads]
        return [np.concatenate(x) if len(x[1]) else x[0] for x in zip(begin, self._words_ids(rests))]

    def _words_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of words divided by blanks, with the blanks before them; none for a null."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        coded = words.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        often = np.bincount(at, minlength=len(distinct)) >= FREQUENT
        raw = self.after_blank.of([distinct[often].tolist()])[0] + self._after_blanks(distinct[~often].tolist())
        place = np.empty(len(distinct), np.int64)
        place[np.concatenate([np.flatnonzero(often), np.flatnonzero(~often)])] = np.arange(len(distinct))
        values = pa.array(raw, pa.large_binary())
        found = []
        for n, m in _runs(bounds, WORDS):
            first = bounds[n - 1] if n else 0
            ids, stops = _buffers(values.take(pa.array(place[at[first : bounds[m - 1]]])))
            ends = stops[bounds[n:m] - first] // 4
            ids = ids.view("<u4")
            found += [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        return found

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text or ""])[0]

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of texts one by one, encoded in batches of bounded size."""
        try:
            for batch in text_batches(texts, ENCODED_CHARS):
                yield from self.batch(batch)
        finally:  # also where not all is read
            release_memory()


@lru_cache(maxsize=4)
def encoder(name: str, plain_specials: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    return Encoder(tokenizer_file(name), plain_specials)
