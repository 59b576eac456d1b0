"""Language of texts and of the spans of mixed texts.

Every word has a score per language, the log likelihood of its letter groups.
The script of a word narrows the languages: only those that use it in the
training text compete.  A Viterbi pass over the words with a penalty for each
switch labels spans; the language with most letters names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import mix64, release_memory, sampled, trainable

SAMPLE_DOCS = 3_000  # training documents of each language, about
BUCKETS = 1 << 16  # hashed letter groups
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01  # a language uses a script if so many of its words are in it
WORD_RANGE = 6.0  # one word counts against a language by so much at most
SWITCH = 12.0  # penalty for a change of language
MEMORY = 64 << 20  # bytes of words one worker remembers, about, then it starts afresh
ENTRY = 200  # bytes a word takes besides its letters and scores, about
TOGETHER = 500_000  # characters of texts whose new words are scored at once
UNKNOWN = "und"

#: First and last code points of scripts, in order.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1200, 0x137F, "Ethiopic"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
_FIRST = np.array([s[0] for s in SCRIPTS])
_LAST = np.array([s[1] for s in SCRIPTS])
_NAMES = [*dict.fromkeys(s[2] for s in SCRIPTS), "Other"]
_INDEX = np.array([_NAMES.index(s[2]) for s in SCRIPTS])
_LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
_EDGE = 10  # code of the line feed between words
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass(frozen=True)
class WordParts:
    """Letter groups of many words: ``bucket[i]`` belongs to word ``word[i]``."""

    letters: np.ndarray  # per word
    script: np.ndarray  # per word, index of the first letter's script; -1 without letters
    word: np.ndarray
    bucket: np.ndarray


def split_words(words: list[str]) -> WordParts:
    """One to three letter groups, edges of the word included, and the word as a whole.

    Only letters count, in lower case; all words are cut at once.
    """
    text = "\n" + "\n".join(words).lower() + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = codes == _EDGE
    letter = _LETTER[codes]
    word = np.cumsum(edge) - 1
    letters = np.bincount(word[letter], minlength=len(words) + 1)[: len(words)]
    keep = edge | letter
    codes, edge, word = codes[keep].astype(np.uint64), edge[keep], word[keep]
    inside = np.flatnonzero(~edge)
    script = np.full(len(words), -1)
    first = inside[np.diff(word[inside], prepend=-1) > 0]
    at = np.searchsorted(_FIRST, codes[first].astype(np.int64), side="right") - 1
    known = (at >= 0) & (codes[first] <= _LAST[np.maximum(at, 0)])
    script[word[first]] = np.where(known, _INDEX[np.maximum(at, 0)], len(_NAMES) - 1)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            start = np.arange(len(codes) - n + 1)
            ok = ~edge[start] if n == 1 else ~edge[start + 1] if n == 3 else ~(edge[start] & edge[start + 1])
            start = start[ok]
            hashed = np.full(len(start), n, np.uint64)
            for k in range(n):
                hashed += codes[start + k] * _MIX[k]
            owners.append(word[start])
            hashes.append(mix64(hashed))
        if len(first):
            place = (inside - np.repeat(first, np.diff(np.append(np.searchsorted(inside, first), len(inside))))).astype(np.uint64)
            whole = np.add.reduceat(mix64(codes[inside] + place * _MIX[0]), np.searchsorted(inside, first))
            owners.append(word[first])
            hashes.append(mix64(whole))
    bucket = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.concatenate(owners)
    used = owner < len(words)
    return WordParts(letters, script, owner[used], bucket[used])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray  # (languages,) log share of the training documents
    table: np.ndarray  # (BUCKETS, languages) log probability less the mean over languages
    scripts: dict[str, np.ndarray]  # script: which languages use it


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from about ``sample_docs`` documents of each language.

    Held-out rows and those without an id, a text or a language teach nothing.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    own = own.where(trainable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32), {})
    chosen = F.lit(False)
    for language, n in counts.items():
        chosen |= (F.col("lang") == language) & sampled(F.col("doc_id"), n, sample_docs)

    def count(batches):
        for batch in batches:
            for language, part in batch.groupby("lang"):
                seen: dict[str, int] = {}
                for text in part["text"].array:
                    for word in text.split():
                        seen[word] = seen.get(word, 0) + 1
                parts = split_words(list(seen))
                times = np.fromiter(seen.values(), np.int64, len(seen))
                groups = np.bincount(parts.bucket, weights=times[parts.word], minlength=BUCKETS).astype(np.int64)
                has = parts.script >= 0
                uses = np.bincount(parts.script[has], weights=times[has], minlength=len(_NAMES)).astype(np.int64)
                scripts = {name: int(n) for name, n in zip(_NAMES, uses) if n}
                at = np.flatnonzero(groups)
                if len(at):
                    yield pd.DataFrame({"lang": language, "script": "", "bucket": at, "n": groups[at]})
                    yield pd.DataFrame({"lang": language, "script": list(scripts), "bucket": -1, "n": list(scripts.values())})
        release_memory()

    found = own.where(chosen).select("lang", "text").mapInPandas(count, "lang string, script string, bucket int, n long")
    totals = found.groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    place = {language: i for i, language in enumerate(languages)}
    grid = np.zeros((BUCKETS, len(languages)))
    groups = totals[totals["bucket"] >= 0]
    grid[groups["bucket"].to_numpy(), groups["lang"].map(place).to_numpy(int)] = groups["n"]
    logs = np.log((grid + SMOOTHING) / (grid.sum(0) + SMOOTHING * BUCKETS))
    scripts = {}
    words = totals[totals["bucket"] < 0]
    for script, part in words.groupby("script"):
        uses = np.zeros(len(languages), bool)
        for language, n in zip(part["lang"], part["n"]):
            all_words = words.loc[words["lang"] == language, "n"].sum()
            uses[place[language]] = n >= SCRIPT_SHARE * all_words
        scripts[script] = uses
    shares = np.array([counts[x] for x in languages], float)
    return LanguageModel(languages, np.log(shares / shares.sum()), (logs - logs.mean(1, keepdims=True)).astype(np.float32), scripts)


class _Words:
    """Scores and letters of the words seen, by row."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.row: dict[str, int] = {}
        self.size = 0  # bytes, about
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.uses = np.zeros((len(_NAMES) + 1, len(model.languages)), bool)
        for i, name in enumerate(_NAMES):
            if name in model.scripts:
                self.uses[i] = model.scripts[name]

    def learn(self, words: list[str]) -> None:
        """0 for the likeliest language, less for others; all 0 if no language uses the script."""
        parts = split_words(words)
        found = np.column_stack(
            [np.bincount(parts.word, weights=self.model.table[parts.bucket, k], minlength=len(words)) for k in range(len(self.model.languages))]
        )
        uses = self.uses[parts.script]
        found = np.where(uses, found, -np.inf)
        top = found.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            found = np.where(uses.any(axis=1)[:, None], np.maximum(found - top, -WORD_RANGE), 0)
        at = len(self.row)
        self.size += sum(map(len, words)) * 2 + (ENTRY + 4 * len(self.model.languages)) * len(words)
        self.row.update(zip(words, range(at, at + len(words))))
        room = max(len(self.row), len(self.letters))
        if room > len(self.letters):
            room = max(room, 2 * len(self.letters), 1024)
            self.scores = np.concatenate([self.scores, np.zeros((room - len(self.letters), found.shape[1]), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(room - len(self.letters), np.int64)])
        self.scores[at : at + len(words)] = found
        self.letters[at : at + len(words)] = parts.letters


def viterbi(scores: np.ndarray, switch: float) -> list[int]:
    """Best language of each word; ties stay with the language before, else the first."""
    languages = range(scores.shape[1])
    value, back = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        top = max(value)
        source, jump = value.index(top), top - switch
        back.append([k if value[k] >= jump else source for k in languages])
        value = [max(value[k], jump) + row[k] for k in languages]
    path, at = [], value.index(max(value))
    for row in reversed(back):
        path.append(at)
        at = row[at]
    return path[::-1]


def _one_language_is_best(scores: np.ndarray, best: int, switch: float) -> bool:
    """Whether no stretch of words gains more than one switch costs in another language."""
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    before = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    return bool((gain - before).max() <= switch)


class Labeller:
    """Labels texts with a model, remembering the scores of words."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.words = _Words(model)

    def labels(self, texts) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """``(language, score, spans)`` of each text; spans are ``(language, first word, last word)``."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(text if isinstance(text, str) else "")
            held += len(group[-1])
            if held > TOGETHER:
                out.extend(self._group(group))
                group, held = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list:
        if not self.model.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        if self.words.size > MEMORY:
            self.words = _Words(self.model)
        split, row = [t.split() for t in texts], self.words.row
        new = dict.fromkeys(w for parts in split for w in parts if w not in row)
        if new:
            self.words.learn(list(new))
        return [self._label(parts) for parts in split]

    def _label(self, parts: list[str]) -> tuple[str, float, list[tuple[str, int, int]]]:
        at = np.fromiter(map(self.words.row.__getitem__, parts), np.int64, len(parts))
        letters = self.words.letters[at]
        n_letters = int(letters.sum())
        if n_letters == 0:
            return UNKNOWN, 0.0, []
        scores = self.words.scores[at]
        total = scores.sum(0, dtype=np.float64)
        best = int(np.argmax(total + self.model.prior))
        if _one_language_is_best(scores, best, self.switch):
            share, spans = 1.0, [(self.model.languages[best], 0, len(parts) - 1)]
        else:
            path = np.array(viterbi(scores, self.switch))
            by = np.bincount(path, weights=letters, minlength=len(total))
            best = int(np.argmax(by))
            share = float(by[best] / n_letters)
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = [(self.model.languages[path[a]], a, b - 1) for a, b in zip(edges, edges[1:])]
        odds = total + self.model.prior
        if share == 1.0:
            share = float(1 / np.exp(np.clip(odds - odds[best], -50, 50)).sum())
        return self.model.languages[best], share, spans


def language_labels(docs: DataFrame, model: LanguageModel, text: str = "text", switch: float = SWITCH) -> Column:
    """Struct ``(lang, score, spans)`` of a text column.

    ``score`` is the share of the letters in spans of the language named, or for
    a text in one language its probability.  Null texts and texts without
    letters, and all texts if nothing could be learned, are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kind = "lang string, score double, spans array<struct<lang:string,first:int,last:int>>"

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value, switch)
        for texts in batches:
            rows = labeller.labels(texts.array)
            yield pd.DataFrame(
                {
                    "lang": [r[0] for r in rows],
                    "score": [r[1] for r in rows],
                    "spans": [[{"lang": s[0], "first": s[1], "last": s[2]} for s in r[2]] for r in rows],
                }
            )
        del labeller
        release_memory()

    return label(F.col(text).cast("string"))
