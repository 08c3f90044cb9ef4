"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens decoded by Viterbi."""

from __future__ import annotations

import bisect
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, Words, fold, prefix_hash, range_hash, steps

KINDS = ("assign", "access", "hex", "crf")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile("|".join(_either_case(w) for w in ("passw", "secret", "token", "api")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, kind, end) in code points; end exclusive. Matches that are too short are
    dropped after matching, so they still use up their text."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of [0-9a-f] is maximal either way, so the length can stand in the pattern.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- features ---------------------------------------------------------------------------------------------------

KEYWORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api", "key", "auth", "bearer", "authorization", "credential", "credentials", "private", "access", "login", "pin")
(_DIGIT, _UPPER, _LOWER, _HEX, _SYMBOL, _HIGH, _AT, _DOT) = range(8)
_CLASS = np.zeros((8, 256), bool)
for _k, _chars in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase, "0123456789abcdefABCDEF", "+/_=-!#$%^&*~?", "", "@", ".")):
    _CLASS[_k, [ord(c) for c in _chars]] = True
_CLASS[_HIGH, 128:] = True
#: Bytes of tokens: letters, digits, bytes of other scripts, and what secrets hold besides; all others separate.
_TOKEN = _CLASS.any(0)
#: Token bytes that end a sentence rather than a secret.
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".!?"]] = True
_SETS = np.zeros(256, bool)
_SETS[[ord(c) for c in "=:"]] = True

FEATURES = [
    *(f"length{k}" for k in range(7)), *(f"digits{k}" for k in range(4)), *(f"switches{k}" for k in range(4)),
    "inner_upper", "upper_and_lower", "only_hex", "only_upper_digits", "symbols", "other_script", "at", "dots", "plain_word",
    "is_keyword", "after_keyword", "two_after_keyword", "before_keyword", "after_sign", "quoted",
    "dense_before", "dense_after", "file_keyword", "file_digits", "file_signs",
]
_AT_FEATURE = {f: k for k, f in enumerate(FEATURES)}


class Tokens:
    """Tokens of several texts: start, end (bytes), row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _TOKEN[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        for _ in range(3):  # a few closing marks aren't part of the token
            end = end - ((end - self.start > 1) & _TAIL[data[end - 1]])
        self.end = end
        self.row = np.searchsorted(offsets, self.start, "right") - 1


_KEYWORD_HASHES: list[np.ndarray] = []


def _keyword_hashes() -> np.ndarray:
    if not _KEYWORD_HASHES:
        data = np.frombuffer("".join(KEYWORDS).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in KEYWORDS])
        _KEYWORD_HASHES.append(np.sort(range_hash(prefix_hash(data), ends - [len(w) for w in KEYWORDS], ends)))
    return _KEYWORD_HASHES[0]


def emissions(data: np.ndarray, offsets: np.ndarray, tokens: Tokens, weights: np.ndarray | None = None) -> np.ndarray:
    """Per token, the binary features (weights None) or their weighted sums by label. Shape, neighbours, file."""
    n, start, end, row = len(tokens.start), tokens.start, tokens.end, tokens.row
    out = np.zeros((n, len(FEATURES) if weights is None else weights.shape[1]), np.uint8 if weights is None else np.float32)

    def add(feature: str, flags: np.ndarray) -> None:
        k = _AT_FEATURE[feature]
        if weights is None:
            out[:, k] = flags
        else:
            at = np.flatnonzero(flags)
            if len(at) * 4 < n:
                out[at] += weights[k]
            else:
                out[:] += flags[:, None] * weights[k]

    if not n:
        return out
    size = end - start
    total = {k: (lambda s: s[end] - s[start])(np.concatenate(([0], np.cumsum(_CLASS[k][data], dtype=np.int32)))) for k in range(8)}
    digits, upper, lower = total[_DIGIT], total[_UPPER], total[_LOWER]
    kind = np.where(_CLASS[_DIGIT][data], 1, np.where(_CLASS[_UPPER][data], 2, np.where(_CLASS[_LOWER][data], 3, 0))).astype(np.int8)
    change = np.concatenate(([0, 0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)))
    switches = change[end] - change[start + 1]
    for k, (low, high) in enumerate(((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 1 << 60))):
        add(f"length{k}", (size >= low) & (size < high))
    for k, flags in enumerate((digits == 0, (digits > 0) & (4 * digits <= size), (4 * digits > size) & (2 * digits <= size), 2 * digits > size)):
        add(f"digits{k}", flags)
    for k, (low, high) in enumerate(((0, 1), (1, 3), (3, 6), (6, 1 << 60))):
        add(f"switches{k}", (switches >= low) & (switches < high))
    add("inner_upper", upper > _CLASS[_UPPER][data[start]])
    add("upper_and_lower", (upper > 0) & (lower > 0))
    add("only_hex", (total[_HEX] == size) & (size >= 8))
    add("only_upper_digits", (upper + digits == size) & (upper > 0) & (digits > 0) & (size >= 8))
    add("symbols", total[_SYMBOL] > 0)
    add("other_script", total[_HIGH] > 0)
    add("at", total[_AT] > 0)
    add("dots", total[_DOT] > 0)
    add("plain_word", lower + total[_HIGH] + (_CLASS[_UPPER][data[start]]) == size)
    word = range_hash(prefix_hash(fold(data)), start, end)
    known = _keyword_hashes()
    keyword = known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word

    def shift(flags: np.ndarray, by: int) -> np.ndarray:
        """Flags of the token `by` places before, in the same text."""
        moved = np.zeros(n, bool)
        if n > abs(by):
            src, dst = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
            moved[dst] = flags[src] & (row[src] == row[dst])
        return moved

    add("is_keyword", keyword)
    add("after_keyword", shift(keyword, 1))
    add("two_after_keyword", shift(keyword, 2) | shift(keyword, 3))
    add("before_keyword", shift(keyword, -1))
    # A sign between the token before and this one.
    signs = np.concatenate(([0], np.cumsum(_SETS[data], dtype=np.int32)))
    low = np.concatenate(([0], end[:-1]))
    low = np.maximum(low, offsets[row])
    add("after_sign", signs[start] > signs[low])
    quote = (data == 34) | (data == 39)
    add("quoted", (start > offsets[row]) & quote[np.maximum(start - 1, 0)] & (end < offsets[row + 1]) & quote[np.minimum(end, len(data) - 1)])
    dense = (size >= 8) & (digits > 0) & (upper + lower > 0)
    add("dense_before", shift(dense, 1))
    add("dense_after", shift(dense, -1))
    rows = len(offsets) - 1
    spread = np.bincount(row, minlength=rows)
    add("file_keyword", (np.bincount(row[keyword], minlength=rows) > 0)[row])
    add("file_digits", (10 * np.bincount(row[digits > 0], minlength=rows) > spread)[row])
    add("file_signs", (10 * (signs[offsets[1:]] - signs[offsets[:-1]]) > spread)[row])
    return out


# --- model ------------------------------------------------------------------------------------------------------


#: Bound on the weights of moves and starts, so that a clear lead of a token decides its label whatever stands around.
MOVE = 1.0


@dataclass
class Crf:
    """Weights of a chain over the labels outside, begin, inside (which reads as begin where nothing precedes it)."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray


def fit_crf(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.1, penalty: float = 1e-4) -> Crf:
    """Maximum likelihood with an L2 penalty (Adam, full batches). x: sequences x tokens x features; y: labels 0-2."""
    n, t, f = x.shape
    params = [np.zeros((f, 3)), np.zeros((3, 3)), np.zeros(3)]
    flat, hot = x.reshape(-1, f).astype(float), np.eye(3)[y]
    seen_moves = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for step in range(1, rounds + 1):
        w, a, s = params
        e = (flat @ w).reshape(n, t, 3)
        forward, backward = np.empty((n, t, 3)), np.zeros((n, t, 3))
        forward[:, 0] = s + e[:, 0]
        for k in range(1, t):
            forward[:, k] = total(forward[:, k - 1, :, None] + a, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            backward[:, k] = total(a + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
        z = total(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None])
        pairs = np.exp(forward[:, :-1, :, None] + a + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads = [flat.T @ (p - hot).reshape(-1, 3) / n, (pairs.sum((0, 1)) - seen_moves) / n, (p[:, 0] - hot[:, 0]).mean(0)]
        for k, g in enumerate(grads):
            g = g + penalty * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k:
                params[k] = np.clip(params[k], -MOVE, MOVE)
    w, a, s = params
    return Crf(w.astype(np.float32), a.astype(np.float32), s.astype(np.float32))


def viterbi(e: np.ndarray, crf: Crf) -> np.ndarray:
    """Best labels of one sequence."""
    best, back = crf.first + e[0], np.zeros((len(e), 3), np.int64)
    for k in range(1, len(e)):
        ways = best[:, None] + crf.moves
        back[k] = ways.argmax(0)
        best = ways.max(0) + e[k]
    out = np.zeros(len(e), np.int64)
    out[-1] = best.argmax()
    for k in range(len(e) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def decode(e: np.ndarray, row: np.ndarray, crf: Crf) -> np.ndarray:
    """Viterbi labels of many texts at once; equal to viterbi() on each.

    Relabelling one token as outside changes two moves at most. Where outside leads by more than these can weigh, the
    best path is outside whatever stands around: such tokens cut the texts into short stretches to decode one by one.
    """
    labels = np.zeros(len(e), np.int64)
    weights = np.concatenate((crf.moves.ravel(), crf.first))
    slack = 2 * float(weights.max() - weights.min()) + 1e-3
    open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= slack)
    if not len(open_):
        return labels
    gap = (np.diff(open_) > 1) | (row[open_][1:] != row[open_][:-1])
    heads = np.concatenate(([0], np.flatnonzero(gap) + 1))
    tails = np.concatenate((np.flatnonzero(gap), [len(open_) - 1]))
    zero = np.zeros((1, 3), np.float32)
    zero[0, 1:] = -1e6
    for a, b in zip(open_[heads], open_[tails] + 1, strict=True):
        lead = a > 0 and row[a - 1] == row[a]
        tail = b < len(e) and row[b] == row[b - 1]
        part = np.concatenate(([zero] if lead else []) + [e[a:b]] + ([zero] if tail else []))
        labels[a:b] = viterbi(part, crf)[int(lead) : len(part) - int(tail)]
    return labels


# --- training ---------------------------------------------------------------------------------------------------

_LEADS = ("password is", "my password:", "the secret key is", "api key", "use token", "bearer", "Authorization: Bearer", "pwd =", "login with passphrase", "private key", "credentials:", "access key is", "pin code", "key:", "auth token ->")


def _secret(rng: np.random.Generator) -> list[str]:
    letters, digits = string.ascii_letters, string.digits
    kind, size = rng.integers(6), int(rng.integers(10, 40))
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    if kind == 0:
        return [pick(letters + digits, size)]
    if kind == 1:
        return [pick("0123456789abcdef", max(size, 16))]
    if kind == 2:
        return [pick(string.ascii_uppercase + digits, max(size, 16))]
    if kind == 3:
        return [pick(["gh", "sk", "pk", "xo", "tk"], 1) + "_" + pick(letters + digits + "_-", size)]
    if kind == 4:
        return [pick(letters, 6) + pick("!#$%^&*", 1) + pick(digits, 3) + pick(letters, 4)]
    return [pick(letters + digits + "+/", 24) for _ in range(int(rng.integers(2, 4)))]


def _harmless(rng: np.random.Generator) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(rng.choice(list(string.ascii_lowercase), n(3, 10)))
    return [
        lambda: f"{word()}.{n(1, 99)}@mail{n(1, 9)}.example.com", lambda: f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}", lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 255)}",
        lambda: str(n(10**15, 10**16)), lambda: f"https://www.{word()}.org/{word()}/{word()}-{n(1, 999)}.html", lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}",
        lambda: f"{word()}_{word()}_{word()}", lambda: f"{word().title()}{word().title()}{n(1, 99)}", lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", lambda: f"#{n(0, 2**24):06x}",
        lambda: f"{n(1, 99)},{n(100, 999)}.{n(10, 99)}", lambda: word().upper() + "!!", lambda: word() + "***", lambda: f"the {rng.choice(['token', 'password', 'key', 'secret', 'api', 'access'])} {word()}", lambda: f"{word()}: {word()} = {word()}",
    ][n(0, 15)]()


def training_sequences(texts: list[str], sequences: int = 1500, width: int = 24, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Seeded sequences of equal width: stretches of sampled texts (their fixed-pattern spans labelled as secrets) and
    of drawn words, with secrets and harmless look-alikes of many shapes set in."""
    rng = np.random.default_rng(seed)
    pool = [t.split() for t in texts if t and len(t) > 40] or [[]]
    xs, ys = [], []
    while len(xs) < sequences:
        words = pool[int(rng.integers(len(pool)))]
        at = int(rng.integers(max(1, len(words) - 30)))
        parts: list[tuple[str, bool]] = [(w, False) for w in words[at : at + 30]]
        while len(parts) < 30:
            parts.append(("".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(1, 12)))), False))
        for _ in range(int(rng.integers(0, 3))):
            where = int(rng.integers(len(parts) - 8))
            if rng.random() < 0.5:
                quote = str(rng.choice(["", "", '"', "'"]))
                bare = rng.random() < 0.15
                lead = [] if bare else [(w, False) for w in str(rng.choice(_LEADS)).split()]
                pieces = _secret(rng)
                parts[where:where] = lead + [(quote + p + quote, True) for p in pieces]
            else:
                parts[where:where] = [(w, False) for w in _harmless(rng).split()]
        text, marks = "", []
        for word, secret in parts:
            if secret:
                marks.append((len(text), len(text) + len(word)))
            text += word + " "
        marks += [(a, b) if k else ASSIGN.match(text, a).span(2) for a, k, b in base_spans(text)]
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) != len(text):  # positions of marks are in characters, those of tokens in bytes
            place = np.cumsum([0, *(len(c.encode()) for c in text)])
            marks = [(int(place[a]), int(place[b])) for a, b in marks]
        offsets = np.array([0, len(data)])
        tokens = Tokens(data, offsets)
        if len(tokens.start) < width:
            continue
        labels, last = np.zeros(len(tokens.start), np.int64), None
        for k, (a, b) in enumerate(zip(tokens.start, tokens.end, strict=True)):
            inside = next((m for m in marks if a >= m[0] and b <= m[1] and b - a >= 6), None)
            labels[k] = 0 if inside is None else 1 if last is None else 2
            last = inside
        xs.append(emissions(data, offsets, tokens)[:width])
        ys.append(labels[:width])
    return np.stack(xs), np.stack(ys)


def _stretches(docs: DataFrame, each: int, seed: int) -> DataFrame:
    """Of each row (_key, _text) up to `each` stretches of 40 words, from seeded places of the whole text."""
    kind = docs.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, "_text"):
            words, raw, out = Words(data, offsets), data.tobytes(), []
            for row in range(batch.num_rows):
                count, first = int(words.count[row]), int(words.first[row])
                places = np.unique(np.random.default_rng((seed, count)).integers(0, max(1, count - 39), each)) if count else []
                out.append([raw[words.start[first + k] : words.end[first + min(k + 40, count) - 1]].decode("utf-8", "replace") for k in places])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["_key", "stretches"])

    return docs.mapInArrow(run, f"_key {kind}, stretches array<string>")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 200, sequences: int = 1500, seed: int = 5) -> Crf:
    """Trains the field on sequences drawn from `sample` documents (a bound on rows; those with the smallest seeded
    hashes of their key, a null key among them) and from seeded synthetic secrets. Stretches are drawn from the whole of
    these documents. An empty table trains on drawn words alone."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # Keys first: at most `sample` of them are broadcast, and only stretches of their texts are fetched.
    keys = rows.select(F.col("_key").alias("_chosen")).distinct().orderBy(F.xxhash64(F.lit(seed), "_chosen"), "_chosen").limit(sample)
    keys = docs.sparkSession.createDataFrame(keys.toArrow())
    chosen = rows.join(F.broadcast(keys), F.col("_key").eqNullSafe(F.col("_chosen"))).select("_key", "_text")
    found = _stretches(chosen, 2 * -(-sequences // sample), seed).groupBy("_key").agg(F.min("stretches").alias("t"))
    texts = [t for r in found.orderBy("_key").collect() for t in r.t or ()]
    return fit_crf(*training_sequences(texts, sequences, seed=seed))


# --- scan -------------------------------------------------------------------------------------------------------


def scan_step(data: np.ndarray, offsets: np.ndarray, crf: Crf | None) -> list[list[tuple[int, int, int]]]:
    """Spans of each text as sorted (start, kind, end) in code points: those of the patterns, and those the field adds
    where no pattern matched."""
    found = [base_spans(bytes(data[a:b]).decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if crf is None or not len(data):
        return found
    tokens = Tokens(data, offsets)
    if not len(tokens.start):
        return found
    labels = decode(emissions(data, offsets, tokens, crf.weights), tokens.row, crf)
    hits = np.flatnonzero(labels)
    ends: dict[int, np.ndarray] = {}  # per text, the farthest end of its pattern spans so far
    starts: dict[int, list[int]] = {}
    if len(hits):
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        begins = np.flatnonzero((labels[hits] == 1) | np.concatenate(([True], np.diff(hits) > 1)) | np.concatenate(([True], np.diff(tokens.row[hits]) > 0)))
        for a, b in zip(begins, [*begins[1:], len(hits)], strict=True):
            row = int(tokens.row[hits[a]])
            shift = points[offsets[row]]
            span = (int(points[tokens.start[hits[a]]] - shift), 3, int(points[tokens.end[hits[b - 1]]] - shift))
            if row not in starts:
                starts[row] = [x[0] for x in found[row]]
                ends[row] = np.maximum.accumulate([0, *(x[2] for x in found[row])])
            if ends[row][bisect.bisect_left(starts[row], span[2])] <= span[0]:
                found[row].append(span)
    return [sorted(x) for x in found]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, crf: Crf | None, text: str = "text") -> DataFrame:
    """Adds the column `secret_spans` (array of kind, start, end; replaces one of that name) to every row.

    A null or empty text has no spans. Rows are scanned on their own in steps of a few MB: no shuffle, and a lost
    executor repeats only its own steps. Repeated rows give repeated results.
    """
    keep = [c for c in docs.columns if c != "secret_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, data, offsets in steps(batches, text, STEP_BYTES):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in scan_step(data, offsets, crf)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "secret_spans"])

    schema = docs.select(*keep).schema.add("secret_spans", SPANS)
    return docs.select(*keep).mapInArrow(run, schema)


def redact(docs: DataFrame, crf: Crf | None, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """The documents with every secret span replaced by a mark, same columns; `length` (if present) is recounted."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, text):
            k = batch.schema.get_field_index(text)
            values, changed = batch.column(k).to_pylist(), {}
            for row, spans in enumerate(scan_step(data, offsets, crf)):
                if spans:
                    out, last = [], 0
                    for a, _, b in spans:
                        if a >= last:
                            out += [values[row][last:a], mark]
                        last = max(last, b)
                    changed[row] = "".join(out) + values[row][last:]
            if changed:
                columns = list(batch.columns)
                columns[k] = pa.array([changed.get(i, v) for i, v in enumerate(values)], batch.schema.field(k).type)
                if length in names:
                    j = batch.schema.get_field_index(length)
                    sizes = batch.column(j).to_pylist()
                    columns[j] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(sizes)], batch.schema.field(j).type)
                batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
