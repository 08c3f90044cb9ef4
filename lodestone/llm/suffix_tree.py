"""LM scoring: a probabilistic suffix tree whose contexts are bytes at the top and words below, and unigram base scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold, materialize, prefix_hash, range_hash, runs, shared_dir, steps, text_of

#: Symbols: bytes as they are; the end of a word (a blank) and the end of the text. No word holds these two bytes.
GAP, END = 0x20, 0x0A
#: Bytes of a window: a context of DEPTH symbols and the next one.
DEPTH = 5
#: Symbols of a text that are scored one after the other; DEPTH at least.
STRETCH = 256
#: Occurrences that are counted at once, unless one word has more.
BLOCK = 1 << 16
#: Hash of the token that ends each text.
END_TOKEN = np.uint64(0x5EED0F7E57)


def symbols(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts as lower-cased words, each with a GAP after it, and an END after the last; and the rows' offsets."""
    data = fold(data)
    size = words.end - words.start
    per_row = np.bincount(words.row, size + 1, words.rows).astype(np.int64) + 1
    out_offsets = np.concatenate(([0], np.cumsum(per_row)))
    out = np.full(out_offsets[-1], GAP, np.uint8)
    out[out_offsets[1:] - 1] = END
    # Place of each word: after all earlier words, gaps and ends of earlier texts.
    begin = np.cumsum(size + 1) - (size + 1) + words.row
    inside = np.repeat(begin - words.start, size)
    at = np.repeat(words.start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    out[at + inside] = data[at]
    return out, out_offsets


def windows(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each symbol, it and the DEPTH symbols before it, packed into a long, the latest lowest. Before a text stand
    zeros."""
    packed, row_start = np.zeros(len(text), np.uint64), np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(text)) - row_start
    for back in range(DEPTH + 1):
        value = np.zeros(len(text), np.uint64)
        value[back:] = text[: len(text) - back] if back else text
        value[place < back] = 0
        packed |= value << np.uint64(8 * back)
    return packed


def count(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Counts over the training texts: words (kind 0, by hash) and windows (kind 1). Combined in the worker per step
    and then by Spark before and after the shuffle."""
    held = _held_out(key)
    rows = docs.select(text_of(text).alias("_text"), held.alias("_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, "_text", 2 << 20):
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            words = Words(data, offsets)
            hashes = range_hash(prefix_hash(fold(data)), words.start, words.end)[train[words.row]]
            hashes = np.concatenate((hashes, np.full(int(train.sum()), END_TOKEN, np.uint64)))
            syms, bounds = symbols(data, offsets, words)
            packed = windows(syms, bounds)[np.repeat(train, np.diff(bounds))]
            for kind, values in ((0, hashes), (1, packed)):
                values = np.sort(values)
                first = runs(values)
                number = np.diff(np.append(first, len(values)))
                items = values[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), kind, np.int32)), pa.array(items), pa.array(number.astype(np.int64))], names=["kind", "item", "n"])

    return rows.mapInArrow(run, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


@dataclass
class Tree:
    """States of the tree with their transitions and log10 probabilities, by state and symbol. Symbols that no training
    text holds share the last column, as all of them have the same probability in each state."""

    move: np.ndarray
    logp: np.ndarray
    column: np.ndarray

    def logs(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol. Texts are cut into stretches of STRETCH symbols that advance side by side,
        the longest first so that those still running are a prefix. A state is the longest suffix of what was read, DEPTH
        symbols at most, so a stretch that starts inside a text finds its state from the DEPTH symbols before it."""
        size = np.diff(offsets)
        number = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), number)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = offsets[:-1][row] + nth * STRETCH
        length = np.minimum(STRETCH, offsets[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        start, length, later = start[order], length[order], np.flatnonzero(nth[order] > 0)
        symbols_, width = self.column[text], self.move.shape[1]
        move, logp = self.move.ravel(), self.logp.ravel()
        state = np.zeros(len(start), np.int64)
        for back in range(DEPTH, 0, -1):
            state[later] = move[state[later] * width + symbols_[start[later] - back]]
        out = np.empty(len(text), np.float32)
        running = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")
        for step, live in enumerate(running):
            place = start[:live] + step
            at = state[:live] * width + symbols_[place]
            out[place] = logp[at]
            state[:live] = move[at]
        return out

    def score(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        size = np.diff(offsets)
        return np.bincount(np.repeat(np.arange(len(size)), size), self.logs(text, offsets), len(size))


def grow(counts: dict[int, np.ndarray], totals: dict[int, np.ndarray], least: float, gain: float) -> Tree:
    """A tree from window counts by depth. counts[d]: contexts of d symbols with the next one (packed, sorted), totals[d]
    their counts. Contexts with a share of at least `least` of all symbols are candidates; one is retained if its
    next-symbol counts diverge from its parent's distribution by `gain` nats or more in all (a likelihood-ratio test),
    or if a retained context extends it. Distributions are smoothed towards the parent's by Witten and Bell."""
    n_all = max(1, int(totals[0].sum()))
    # Next-symbol counts of candidates, by context (packed, depth in the low bits of the key's pair).
    tables: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(256)}
    np.add.at(tables[0, 0], (counts[0] & np.uint64(0xFF)).astype(int), totals[0])
    for d in range(1, DEPTH + 1):
        context = counts[d] >> np.uint64(8)
        first = runs(context)
        summed = np.add.reduceat(totals[d], first) if len(first) else totals[d]
        ends = np.append(first[1:], len(context))
        for k in np.flatnonzero(summed >= max(2, least * n_all)):
            a, b = first[k], ends[k]
            table = np.zeros(256)
            table[(counts[d][a:b] & np.uint64(0xFF)).astype(int)] = totals[d][a:b]
            tables[d, int(context[a])] = table
    probs: dict[tuple[int, int], np.ndarray] = {}

    def smooth(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
        kinds = np.count_nonzero(own)
        return (own + kinds * parent) / (own.sum() + kinds)

    uniform = np.full(256, 1 / 256)
    kept: set[tuple[int, int]] = {(0, 0)}
    probs[0, 0] = smooth(tables[0, 0], uniform) if tables[0, 0].any() else uniform
    for d, c in sorted(tables):
        if not d:
            continue
        parent = d - 1, c & ((1 << 8 * (d - 1)) - 1)  # the context without its earliest symbol
        if parent not in probs:
            continue
        own = tables[d, c]
        probs[d, c] = smooth(own, probs[parent])
        seen = own > 0
        if (own[seen] * np.log(own[seen] / own.sum() / probs[parent][seen])).sum() >= gain:
            while (d, c) not in kept:  # with all its suffixes
                kept.add((d, c))
                d, c = d - 1, c & ((1 << 8 * (d - 1)) - 1)
    # Prefixes of retained contexts are states too, that a text can pass through; they speak for their longest suffix.
    states = set(kept)
    for d, c in kept:
        while d > 1:
            d, c = d - 1, c >> 8
            for k in range(d + 1):
                states.add((d - k, c & ((1 << 8 * (d - k)) - 1)))
    number = {s: k for k, s in enumerate(sorted(states))}
    used = np.flatnonzero(tables[0, 0])
    column = np.full(256, len(used), np.int64)
    column[used] = np.arange(len(used))
    # The last column is that of any unused symbol (or, with none, never read).
    spare = next((x for x in range(256) if not tables[0, 0][x]), 0)
    shown = np.append(used, spare)
    move, logp = np.zeros((len(number), len(shown)), np.int32), np.zeros((len(number), len(shown)), np.float32)
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, c in states:
        if d:
            follow.setdefault((d - 1, c >> 8), []).append((column[c & 0xFF], number[d, c]))
    for (d, c), k in sorted(number.items()):
        if d:
            shorter = number[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
            move[k] = move[shorter]
            logp[k] = np.log10(probs[d, c][shown]) if (d, c) in kept else logp[shorter]
        else:
            logp[k] = np.log10(probs[0, 0][shown])
        for symbol, to in follow.get((d, c), []):
            move[k, symbol] = to
    return Tree(move, logp, column)


def fit(windows_: DataFrame, least: float = 4e-6, gain: float = 8.0) -> Tree:
    """The tree of counted windows (item, n).

    Depths are summed up one from the other, the deepest first. Only windows whose context has the share `least` come to
    the driver: at each depth there are at most 1/least of these contexts, with at most 256 next symbols each, whatever
    the input. All of them are candidates, however many the tree retains: its table (eight bytes a state and used symbol,
    in every worker) grows with the number of symbols that the texts use.
    """
    total = windows_.agg(F.sum("n")).head()[0] or 0
    by_depth, totals = {}, {}
    level = windows_.select(F.col("item").alias("w"), "n")
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            level = materialize(level.groupBy(F.col("w").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("w")).agg(F.sum("n").alias("n")))
        cut = level
        if d:
            # Windows whose d earlier symbols aren't all in the text are no contexts of that depth.
            cut = level.where(F.shiftrightunsigned("w", 8 * d) > 0).withColumn("c", F.shiftrightunsigned("w", 8))
            heavy = cut.groupBy("c").agg(F.sum("n").alias("_n")).where(F.col("_n") >= max(2, least * total)).select("c")
            cut = cut.join(heavy, "c", "left_semi")
        table = cut.select("w", "n").toArrow()
        order = np.argsort(table["w"].to_numpy(), kind="stable")
        by_depth[d] = table["w"].to_numpy()[order].astype(np.uint64)
        totals[d] = table["n"].to_numpy()[order].astype(np.int64)
    return grow(by_depth, totals, least, gain)


def word_states(item: np.ndarray, train: np.ndarray, contexts: np.ndarray, follow: np.ndarray, logp: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """The tree below words: occurrences of words with the token that follows each and its log10 probability by bytes.
    Returns how often each word occurs in training texts, and log10 probabilities by the longest retained context.

    item: the word. contexts: hashes of the one and the two words before it, packed into the high and the low half (0:
    there is none). follow: the next token. All occurrences of a word must be given. A context is a candidate if training
    texts hold it twice, and retained by the test that `grow` makes: its next tokens diverge from what the context
    without its earliest word (a word alone: the bytes) says by `gain` nats in all. Smoothing is that of Witten and Bell.
    """
    near, far = contexts >> np.uint64(32), contexts & np.uint64(0xFFFFFFFF)
    group = np.unique(item, return_inverse=True)[1]
    _, symbol = np.unique(follow, return_inverse=True)
    before, out, known = 10.0 ** logp.astype(np.float64), logp.astype(np.float64), None
    whole = np.ones(len(item), bool)
    for more in (None, near, far):
        if more is not None:
            whole &= more > 0
            group = np.unique(_pairs(group, np.unique(more, return_inverse=True)[1]), return_inverse=True)[1]
        pair = np.unique(_pairs(group, symbol), return_inverse=True)[1]
        number = np.bincount(pair, train)
        own, total = number[pair], np.bincount(group, train)
        head = np.zeros(len(number), np.int64)
        head[pair] = group
        kinds = np.bincount(head, number > 0, len(total))
        seen = train & (own > 0)
        ratio = np.zeros(len(item))
        ratio[seen] = np.log(own[seen] / total[group[seen]] / before[seen])
        kept = (total >= 2) & (np.bincount(group, ratio, len(total)) >= gain)
        known = total[group] if known is None else known
        enough = whole & (total[group] >= 2)
        before = np.where(enough, (own + kinds[group] * before) / np.maximum(total + kinds, 1)[group], before)
        out = np.where(whole & kept[group], np.log10(before), out)
    return known.astype(np.int64), out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two small numbers as one."""
    return a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b


def _below_words(found: DataFrame, floor: float, alpha: float, gain: float) -> DataFrame:
    """Per row of the texts: base scores, known ones, and what contexts of words add, over the words of `found`, whose
    occurrences stand together. A task holds those of one word, or of BLOCK occurrences, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told(rows: list[np.ndarray]) -> pa.RecordBatch:
            item, row, train, contexts, follow, logp = rows
            known, better = word_states(item, train, contexts.view(np.uint64), follow, logp, gain)
            each, at = np.unique(row, return_inverse=True)
            sums = [np.bincount(at, x, len(each)) for x in (np.log10(known + alpha) - floor, known > 0, better - logp)]
            return pa.RecordBatch.from_arrays([pa.array(each), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], names=["_row", "_more", "_seen", "_gained"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            held.append(rows)
            size += batch.num_rows
            # Only where the word changes may the rows be cut.
            if size >= BLOCK and rows[0][-1] != held[0][0][0]:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1
                yield told([x[:cut] for x in rows])
                held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if size:
            yield told([np.concatenate(x) for x in zip(*held, strict=True)])

    return found.mapInArrow(run, "_row long, _more double, _seen long, _gained double")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", alpha: float = 0.1, common: float = 1e-6, gain: float = 8.0, **options) -> DataFrame:
    """Base and tree scores of every document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words with a share of `common` of the training tokens or more, 1/common at most, are broadcast with their counts.
    All other words bring the tree's contexts of up to three words: their occurrences meet, one word's in one task (by
    the share at most `common` of all tokens), where they are counted and the texts scored; what a retained context says
    of the next token replaces what the bytes say of it. So the number of contexts grows with the texts, and nothing of
    them passes the driver. A null text is the end token alone. Repeated rows count as often as they occur; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    words_table, windows_table = _count_tables(docs, text, key)
    tree = fit(windows_table, gain=gain, **options)
    sums = words_table.agg(F.sum("n"), F.count("*")).head()
    train, distinct = int(sums[0] or 0), int(sums[1])
    frequent = words_table.where(F.col("n") >= max(1.0, common * train)).toArrow()
    order = np.argsort(frequent["item"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((tree, frequent["item"].to_numpy().view(np.uint64)[order], frequent["n"].to_numpy()[order]))
    end = words_table.where(F.col("item") == int(END_TOKEN)).select("n").head()
    end_count = int(end[0]) if end else 0
    floor = float(np.log10(train + alpha * (distinct + 1)))
    kind, arrow = docs.select(key).dtypes[0][1], docs.select(key).limit(0).toArrow().schema.field(0).type
    names = ["_key", "held_out", "n_tokens", "_known", "_base", "_bytes", "_rare", "_before", "_follow", "_logp"]
    lists = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.float32())]
    schema = pa.schema(list(zip(names, [arrow, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *lists], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, number = shared.value
        for batch, data, offsets in steps(batches, "_text", 2 << 20):
            words = Words(data, offsets)
            hashes = range_hash(prefix_hash(fold(data)), words.start, words.end)
            c = np.zeros(len(hashes))
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                c = np.where(known[at] == hashes, number[at], 0)
            seen = c > 0
            base = np.bincount(words.row[seen], np.log10(c[seen] + alpha) - floor, words.rows) + (np.log10(end_count + alpha) - floor)
            n_known = np.bincount(words.row[seen], minlength=words.rows) + (end_count > 0)
            syms, bounds = symbols(data, offsets, words)
            logs = tree.logs(syms, bounds)
            summed = np.concatenate(([0.0], np.cumsum(logs, dtype=np.float64)))
            rare = np.flatnonzero(~seen)
            row = words.row[rare]
            # Tokens are words, and an END after the last one of each text: token k + row is word k.
            token_end = np.empty(len(hashes) + words.rows, np.int64)
            is_word = np.ones(len(token_end), bool)
            is_word[words.first[1:] + np.arange(words.rows)] = False
            token_end[is_word] = np.cumsum(words.end - words.start + 1) + words.row
            token_end[~is_word] = bounds[1:]
            token = np.full(len(token_end), END_TOKEN, np.uint64)
            token[is_word] = hashes
            at = rare + row
            follow = token[at + 1]
            logp = (summed[token_end[at + 1]] - summed[token_end[at]]).astype(np.float32)
            place = rare - words.first[row]
            one = np.where(place > 0, hashes[rare - 1], 0) if len(rare) else np.zeros(0, np.uint64)
            two = np.where(place > 1, hashes[rare - 2], 0) if len(rare) else np.zeros(0, np.uint64)
            halves = [np.where(x > 0, np.maximum(x >> np.uint64(32), np.uint64(1)), np.uint64(0)) for x in (one, two)]
            before = (halves[0] << np.uint64(32)) | halves[1]
            cuts = pa.array(np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32))
            told = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (hashes[rare].view(np.int64), before.view(np.int64), follow.view(np.int64), logp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words.count + 1), pa.array(n_known), pa.array(base), pa.array(summed[bounds[1:]] - summed[bounds[:-1]]), *told], schema=schema)

    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"), _held_out(key).alias("held_out"))
    ddl = f"_key {kind}, held_out boolean, n_tokens long, _known long, _base double, _bytes double, _rare array<long>, _before array<long>, _follow array<long>, _logp array<float>"
    # The number of a row is fixed as it is written.
    scored = materialize(rows.mapInArrow(run, ddl).withColumn("_row", F.monotonically_increasing_id()))
    each = scored.select("_row", (~F.col("held_out")).alias("train"), F.explode(F.arrays_zip("_rare", "_before", "_follow", "_logp")).alias("r"))
    found = each.select(F.col("r._rare").alias("item"), "_row", "train", "r._before", "r._follow", "r._logp").repartition("item").sortWithinPartitions("item")
    sums = _below_words(found, floor, alpha, gain).groupBy("_row").agg(F.sum("_more").alias("_more"), F.sum("_seen").alias("_seen"), F.sum("_gained").alias("_gained"))
    out = scored.drop("_rare", "_before", "_follow", "_logp").join(sums, "_row", "left")
    return out.select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("_known") + F.coalesce("_seen", F.lit(0))).cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), (F.col("_bytes") + F.coalesce("_gained", F.lit(0.0))).alias("score"),
    )


def _count_tables(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Counts of words and of windows, each in a table of its own."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    count(docs, text, key).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    read = spark.read.schema("item long, n long, kind int").parquet(path)
    return tuple(read.where(F.col("kind") == k).select("item", "n") for k in (0, 1))
