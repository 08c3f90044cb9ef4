"""Per-document text metrics, all from one vectorised pass over Arrow batches, without a shuffle."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import steps
from .exprs import EMAIL, words

# English stop words.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "of", "to", "in", "on", "for", "with", "by", "at",
    "from", "as", "is", "are", "was", "were", "be", "been", "being", "it", "this", "that", "these", "those", "i", "you",
    "he", "she", "they", "we", "my", "your", "our", "their", "me", "him", "her", "them", "do", "does", "did", "have",
    "has", "had", "not", "no", "yes", "can", "could", "will", "would", "should", "may", "might", "about", "into",
    "than", "too", "very", "such", "so", "because", "while", "over", "under", "again", "further", "there", "here",
)

METRICS = (
    "char_count", "char_count_no_space", "word_count", "sentence_count", "line_count", "paragraph_count", "avg_word_length",
    "avg_sentence_length_words", "avg_line_length_chars", "unique_word_count", "type_token_ratio", "hapax_ratio", "stopword_ratio",
    "duplicate_line_ratio", "repeated_ngram_ratio", "max_ngram_frequency", "whitespace_ratio", "digit_ratio", "punctuation_ratio",
    "uppercase_ratio", "url_count", "email_count", "repeated_punctuation_count", "non_ascii_ratio", "char_entropy",
    "flesch_reading_ease", "flesch_kincaid_grade", "complex_word_ratio",
)

#: Bytes of text that one step works on (a single longer text makes a longer step): its arrays take some 300 times as much.
STEP = 1 << 18
_BLANKS = " \t\n\x0b\x0c\r"
_URL = re.compile(rf"https?://[^{_BLANKS}]+|www\.[^{_BLANKS}]+", re.IGNORECASE | re.ASCII)
_EMAIL = re.compile(EMAIL)
_PARAGRAPH = re.compile(rf"\n[{_BLANKS}]*\n+")
_SPACE = re.compile("[\\s\x1c-\x1f\x85\xa0]+")

# Kinds of characters, as bits.
_WORD, _DIGIT, _UPPER, _BLANK, _WIDE = 1, 2, 4, 8, 16
_kinds, _known = np.zeros(0x110000, np.uint8), np.zeros(0x1100, bool)


def _kind(code: int) -> int:
    c = chr(code)
    category = unicodedata.category(c)
    blank = c in _BLANKS
    wide = blank or c.isspace() and code != 0x1680
    return _WORD * (category[0] in "LN" or c == "_") | _DIGIT * (category == "Nd") | _UPPER * (category == "Lu") | _BLANK * blank | _WIDE * wide


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    """Kinds of characters, from a table that is filled by pages of 256 as they occur."""
    pages = np.flatnonzero(np.bincount(codes >> 8, minlength=1))
    for page in pages[~_known[pages]].tolist():
        _kinds[page << 8 : (page + 1) << 8] = [_kind(code) for code in range(page << 8, (page + 1) << 8)]
        _known[page] = True
    return _kinds[codes]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _Words:
    """Words of several lower-cased texts: start, end, row, and a 64-bit hash that stands for the word."""

    def __init__(self, texts: list[str]):
        self.codes, self.offsets = _codes([t.lower() for t in texts])
        n = len(self.codes)
        inside = np.concatenate(([False], _kinds_of(self.codes) & _WORD > 0, [False]))
        heads = self.offsets[:-1]
        head = np.zeros(n + 1, bool)
        head[heads] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | head[:-1]))
        tail = np.zeros(n + 1, bool)
        tail[self.offsets[1:]] = True
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | tail[1:])) + 1
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.offsets))[self.start]
        if len(_powers[0]) <= n:
            for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                grown = np.full(max(n + 1, 2 * STEP), base, np.uint64)
                grown[0] = 1
                _powers[k] = np.cumprod(grown)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_scramble(self.codes.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
        self.hash = _scramble((sums[self.end] - sums[self.start]) * _powers[1][self.start] + (self.end - self.start).astype(np.uint64))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and size of each group of equal keys in a row."""
    both = key.astype(np.uint64) + _scramble(row.astype(np.uint64) + np.uint64(0x1F83D9ABFB41BD6B))
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    return row[order[first]], np.diff(np.append(first, len(row)))


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    """Whether codes are one of some ASCII characters."""
    table = np.zeros(129, bool)
    table[[ord(c) for c in chars]] = True
    return table[np.minimum(codes, 128)]


def _syllables(w: _Words) -> np.ndarray:
    """Groups of vowels among the letters a-z of each word, less a silent closing e, one at least; 0 without letters."""
    begin = np.zeros(len(w.codes), np.int64)
    begin[w.start] = 1
    at = np.flatnonzero((w.codes >= 97) & (w.codes <= 122))
    word = (np.cumsum(begin) - 1)[at]
    letter = w.codes[at]
    vowel = _among(letter, "aeiouy")
    same = np.zeros(len(at), bool)
    same[1:] = word[1:] == word[:-1]
    begins = vowel.copy()
    begins[1:] &= ~(same[1:] & vowel[:-1])
    n = len(w.start)
    groups, letters = np.bincount(word[begins], minlength=n), np.bincount(word, minlength=n)
    last = np.append(~same[1:], True) if len(at) else same
    silent = np.zeros(n, bool)
    silent[word[last & (letter == 101)]] = True
    return np.where(letters == 0, 0, np.maximum(groups - (silent & (groups > 1)), 1))


def measure(texts: list[str]) -> np.ndarray:
    """METRICS of texts: a row per text."""
    n = len(texts)
    codes, offsets = _codes(texts)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = _kinds_of(codes)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=n) / np.maximum(size, 1)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    blank, wide = kinds & _BLANK > 0, kinds & _WIDE > 0
    # Sentences end with a piece between blanks that closes with . ! ? and is not the last.
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    ends = np.flatnonzero(~wide & (np.append(wide[1:], True) | edge[1:]))
    more = np.zeros(len(ends), bool)
    more[:-1] = row[ends[1:]] == row[ends[:-1]]
    sentences = np.bincount(row[ends[more & _among(codes[ends], ".!?")]], minlength=n) + (np.bincount(row[ends], minlength=n) > 0)
    mark = _among(codes, "!?.,;:")
    again = np.zeros(len(codes) + 1, bool)
    again[1:-1] = mark[1:] & (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]) if len(codes) else False
    doubled = np.bincount(row[np.flatnonzero(again[1:-1] & ~again[:-2]) + 1], minlength=n) if len(codes) else np.zeros(n)
    # Entropy, from the counts of the characters that occur.
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    if n * len(present) <= 8 * len(codes) + 4096:
        number = np.zeros(int(present.max(initial=0)) + 1, np.int64)
        number[present] = np.arange(len(present))
        table = np.bincount(row * len(present) + number[codes], minlength=n * len(present))
        at = np.flatnonzero(table)
        own, count = at // max(len(present), 1), table[at]
    else:
        own, count = _groups(row, codes)
    p = count / size[own]
    entropy = np.bincount(own, -p * np.log2(p), n)

    w = _Words(texts)
    word_count = np.bincount(w.row, minlength=n)
    letters = np.bincount(w.row, w.end - w.start, n)
    own, count = _groups(w.row, w.hash)
    unique, once = np.bincount(own, minlength=n), np.bincount(own[count == 1], minlength=n)
    stop = np.bincount(w.row[np.isin(w.hash, _stop_hashes())], minlength=n)
    h = w.hash
    grams = _scramble(h[:-2] * np.uint64(0xD1342543DE82EF95) + h[1:-1] * np.uint64(0xDA942042E4DD58B5) + h[2:]) if len(h) > 2 else h[:0]
    whole = w.row[2:] == w.row[:-2] if len(h) > 2 else np.zeros(0, bool)
    own, count = _groups(w.row[: len(grams)][whole], grams[whole])
    twice = count > 1
    repeated, most = np.bincount(own[twice], count[twice], n), (word_count >= 3).astype(float)
    np.maximum.at(most, own[twice], count[twice].astype(float))
    spoken = _syllables(w)
    syllables, complex_ = np.bincount(w.row, spoken, n), np.bincount(w.row[spoken >= 3], minlength=n)

    by_text = np.array([_by_text(t) for t in texts], float).reshape(n, 7)
    lines, line_chars, line_copies, line_filled, paragraphs, urls, emails = by_text.T
    enough, cut = word_count >= 3, np.maximum(sentences, 1)
    asl, asw = word_count / cut, ratio(syllables, word_count)
    spoken_ = word_count > 0
    return np.stack(
        [
            size, size - np.bincount(row[blank], minlength=n), word_count, sentences, lines, paragraphs, ratio(letters, word_count),
            ratio(word_count, sentences), ratio(line_chars, lines), unique, ratio(unique, word_count), ratio(once, word_count), ratio(stop, word_count),
            np.where(enough, ratio(line_copies, line_filled), 0.0), np.where(enough, ratio(repeated, word_count - 2), 0.0), most, share(blank), share(kinds & _DIGIT > 0), share((kinds & (_WORD | _BLANK)) == 0),
            share(kinds & _UPPER > 0), urls, emails, doubled, share(codes > 127), entropy,
            np.where(spoken_, 206.835 - 1.015 * asl - 84.6 * asw, 0.0), np.where(spoken_, 0.39 * asl + 11.8 * asw - 15.59, 0.0), ratio(complex_, word_count),
        ],
        1,
    )


def _by_text(t: str) -> tuple[int, ...]:
    """Lines, their characters, repeated and all filled lines, paragraphs, URLs and addresses: split by the interpreter."""
    lines = t.splitlines()
    filled = Counter(x for x in (" ".join(y.split()) if " " not in y else _SPACE.sub(" ", y).strip(" ") for y in lines) if x)
    pieces = _PARAGRAPH.split(t) if "\n" in t else [t]
    low = t.lower()
    urls = len(_URL.findall(t)) if "http" in low or "www." in low else 0
    emails = len(_EMAIL.findall(t)) if "@" in t else 0
    return len(lines), sum(map(len, lines)), sum(c for c in filled.values() if c > 1), sum(filled.values()), sum(bool(p.strip(_BLANKS)) for p in pieces), urls, emails


_stop: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _stop:
        _stop.append(np.sort(_Words(list(STOP_WORDS)).hash))
    return _stop[0]


def overlap(texts: list[str], labels: list[str]) -> np.ndarray:
    """Share of each label's words that its text holds."""
    both = []
    for side in (texts, labels):
        w = _Words(side)
        both.append((w.row, w.hash))
    row, _ = _groups(*both[1])
    size = np.bincount(row, minlength=len(texts))
    # A word of both sides is one group fewer in all than in the sides.
    apart = np.bincount(_groups(*both[0])[0], minlength=len(texts)) + size
    together = np.bincount(_groups(*[np.concatenate(x) for x in zip(*both, strict=True)])[0], minlength=len(texts))
    shared = apart - together
    return np.where(size > 0, shared / np.maximum(size, 1), 0.0)


def label_overlap(text: Column, label: Column) -> Column:
    """Share of the label's words that the text holds; null without a label."""
    own = F.array_distinct(words(label))
    shared = F.size(F.array_intersect(F.array_distinct(words(text)), own))
    return F.when(label.isNotNull(), F.coalesce(F.try_divide(shared.cast("double"), F.size(own)), F.lit(0.0)))


def _spread(df: DataFrame) -> DataFrame:
    """Deals out a table that the scan would read in fewer tasks than there are cores; larger ones stay where they are."""
    spark = df.sparkSession
    cores, leaves = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if STEP < size < cores * each else df


def text_metrics(df: DataFrame, text: str, label: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, text_missing, and all metrics of each row's text (null for a null text).

    Words and grams are counted by 64-bit hashes. A row needs its own text alone: no shuffle, and steps of bounded size."""
    names = [*METRICS, *(["label_keyword_overlap"] if label else [])]
    base = df.select(*keep, F.col(text).cast("string").alias("_t"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("_label"))
    base, kept = _spread(base), len(base.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, kept, STEP):
            texts = batch.column(kept).to_pylist()
            missing = np.array([t is None for t in texts], bool)
            filled = [t or "" for t in texts]
            values = measure(filled)
            columns = [pa.array(values[:, k], mask=missing) for k in range(len(METRICS))]
            if label:
                labels = batch.column(kept + 1).to_pylist()
                columns.append(pa.array(overlap(filled, [x or "" for x in labels]), mask=missing | np.array([x is None for x in labels], bool)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(missing), *columns], names=[*batch.schema.names[:kept], "text_missing", *names])

    schema = T.StructType([*base.schema.fields[:kept], T.StructField("text_missing", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return base.mapInArrow(run, schema)
