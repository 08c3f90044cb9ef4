"""Quality rules: statistics of texts, hard limits, and an isolation forest calibrated on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, materialize, prefix_hash, range_hash, steps

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on: rates, so that long and short documents compare.
FEATURES = ("log_words", "mean_word", "symbols_per_word", "dup_line_rate", "repeat_rate", "lines_per_word", "distinct_rate", "digit_rate", "upper_rate")
#: Features with a range that holds for any text, and the range. A sample may hold one value alone; what is far from it is
#: rare all the same, so the forest also grows on a few rows with values from the whole range.
RANGES = {"dup_line_rate": (0.0, 1.0), "repeat_rate": (0.0, 0.5), "lines_per_word": (0.0, 1.0), "digit_rate": (0.0, 1.0), "upper_rate": (0.0, 1.0)}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of each text. Everything is counted over the whole text."""
    words = Words(data, offsets)
    n, sums = len(offsets) - 1, prefix_hash(data)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    chars = per_row(~blank & ((data & 0xC0) != 0x80))
    symbols = per_row(_SYMBOL[data])
    # Lines: between line feeds and the ends of texts; one counts if it holds a word and an earlier line equals it.
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    row = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1))
    row = row[np.argsort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")]
    filled = np.concatenate(([0], np.cumsum(~blank)))
    full = filled[ends] > filled[starts]
    row, line = row[full], range_hash(sums, starts[full], ends[full])
    order = np.lexsort((line, row))
    row, line = row[order], line[order]
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
    dup_lines = np.bincount(row[again], minlength=n)
    lines = np.bincount(row, minlength=n)
    # Words in 3-word windows that the text holds at least twice.
    word = range_hash(sums, words.start, words.end)
    window = grams(word, 3)
    inside = words.row[2:] == words.row[:-2] if len(word) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order = at[np.lexsort((window[at], words.row[at]))]
    same = (words.row[order][1:] == words.row[order][:-1]) & (window[order][1:] == window[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[order[twice] + k] = True
    repeats = np.bincount(words.row[covered], minlength=n)
    keyed = np.lexsort((word, words.row))
    new = np.ones(len(word), bool)
    new[1:] = (words.row[keyed][1:] != words.row[keyed][:-1]) | (word[keyed][1:] != word[keyed][:-1])
    distinct = np.bincount(words.row[keyed][new], minlength=n)
    counts = np.stack([words.count, chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    size, letters = np.maximum(words.count, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            np.log1p(words.count),
            chars / size,
            symbols / size,
            dup_lines / np.maximum(lines, 1),
            repeats / size,
            lines / size,
            # Distinct words grow with length as a power; the ratio of the logarithms doesn't fall with it.
            np.log1p(distinct) / np.log1p(size),
            per_row((data >= 48) & (data <= 57)) / letters,
            per_row((data >= 65) & (data <= 90)) / letters,
        ],
        1,
    )
    return counts, features


@dataclass
class Forest:
    """An isolation forest: per tree and node the feature (-1: leaf), threshold, children, and path length of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    length: np.ndarray
    depth: int
    norm: float
    limit: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path length / expected path length)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = self.feature[t][node]
                right = x[rows, np.maximum(feature, 0)] >= self.threshold[t][node]
                node = np.where(feature >= 0, self.child[t][node] + right, node)
            total += self.length[t][node]
        return np.exp2(-total / len(self.feature) / self.norm)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def fit_forest(x: np.ndarray, trees: int = 300, points: int = 128, seed: int = 7, weight: np.ndarray | None = None) -> Forest:
    """Trees over random splits of random subsamples, on features drawn by `weight` (none: evenly); an empty sample gives
    a forest that calls nothing an anomaly."""
    rng, points = np.random.default_rng(seed), min(points, len(x))
    depth = max(1, int(np.ceil(np.log2(max(points, 2)))))
    nodes = 2 ** (depth + 1)
    feature, threshold = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    child, length = np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))
    for t in range(trees):
        todo, used = [(0, 0, rng.choice(len(x), points, replace=False))] if points else [], 1
        while todo:
            node, level, rows = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            free = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(free):
                length[t, node] = level + _expected(len(rows))
                continue
            f = rng.choice(free, p=None if weight is None else weight[free] / weight[free].sum())
            cut = rng.uniform(low[f], high[f])
            right = x[rows, f] >= cut
            feature[t, node], threshold[t, node], child[t, node] = f, cut, used
            todo += [(used, level + 1, rows[~right]), (used + 1, level + 1, rows[right])]
            used += 2
    return Forest(feature, threshold, child, length, depth, float(max(_expected(points), 1e-9)))


def _weights(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How often each feature is split on: by how well it alone tells bad rows from good ones (the share of pairs in
    order, from 0.5 on either side), never under a fifth of the best one's. Rows are given as counts by feature and bin;
    those in one bin count as equal."""
    if not good.sum() or not bad.sum():
        return np.ones(len(FEATURES))
    below = np.cumsum(good, 1) - good
    told = np.abs((bad * (2 * below + good)).sum(1) / bad.sum(1) / good.sum(1) - 1)
    return np.maximum(told, max(told.max(), 1e-9) / 5)


def _features(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, len(FEATURES))


def _bin_counts(table: DataFrame, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad rows by feature and bin: a bin for each edge and one between any two. All rows are counted."""
    width = 2 * max(len(e) for e in edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(FEATURES) * width), np.int64)
        for batch in batches:
            x, bad = _features(batch), batch.column(0).to_numpy() == 0
            for k, edge in enumerate(edges):
                at = k * width + np.searchsorted(edge, x[:, k]) + np.searchsorted(edge, x[:, k], "right")
                for kind, rows in enumerate((~bad, bad)):
                    total[kind] += np.bincount(at[rows], minlength=total.shape[1])
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["at", "good", "bad"])

    labelled = table.where("_quality in (0, 1)").select("_quality", "features")
    found = labelled.mapInArrow(run, "at long, good long, bad long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    out = np.zeros((2, len(FEATURES) * width), np.int64)
    for kind, name in enumerate(("good", "bad")):
        out[kind, found["at"].to_numpy()] = found[name].to_numpy()
    return tuple(out.reshape(2, len(FEATURES), width))


def quantile(scores: DataFrame, q: float) -> float:
    """The quantile of all rows of the column `score` (0 to 1), linear between two of them: counts by bin, then the values
    of the bins that hold these two."""
    binned = scores.select("score", F.least(F.floor(F.col("score") * 65536), F.lit(65535)).cast("int").alias("bin"))
    count = binned.groupBy("bin").agg(F.count("*").alias("n")).toArrow().sort_by("bin")
    ends, bins = np.cumsum(count["n"].to_numpy()), count["bin"].to_numpy()
    place = (ends[-1] - 1) * q
    low = int(place)
    high = min(low + 1, int(ends[-1]) - 1)
    first, last = (int(np.searchsorted(ends, r, "right")) for r in (low, high))
    held = binned.where(F.col("bin").between(int(bins[first]), int(bins[last]))).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by("score")
    upto = np.cumsum(held["n"].to_numpy()) + (int(ends[first - 1]) if first else 0)
    a, b = (float(held["score"][int(np.searchsorted(upto, r, "right"))].as_py()) for r in (low, high))
    return a + (b - a) * (place - low)


def _spread(x: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Copies of the share of rows for each of RANGES, with a value of that range in place of their own."""
    rng, out = np.random.default_rng(seed), []
    for name, (low, high) in RANGES.items():
        rows = x[rng.integers(0, len(x), int(share * len(x)) + 1)].copy() if len(x) else x[:0].copy()
        rows[:, FEATURES.index(name)] = rng.uniform(low, high, len(rows))
        out.append(rows)
    return np.concatenate(out)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _arrow_statistics(text: str, keep: list[str], forest: Forest | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, text):
            counts, features = statistics(data, offsets)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            if forest is None:
                columns.append(pa.array(list(features), pa.list_(pa.float64())))
            else:
                failed = base_failed(counts)
                score = forest.score(features)
                columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.limit))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _passed(docs: DataFrame, labels: DataFrame | None, text: str, key: str, seed: int) -> DataFrame:
    """Labelled documents (without labels: all) that pass the hard limits, one row of each key: _quality, features, and
    _draw, a seeded number from 0 to 1. Texts aren't shuffled."""
    rows = docs.select(F.col(key).alias("_key"), text)
    kind, arrow = rows.dtypes[0][1], rows.select("_key").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("_key", arrow), *((c, pa.int64()) for c in COUNTS), ("features", pa.list_(pa.float64()))])
    ddl = f"_key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    found = rows.where("_key is not null").mapInArrow(_arrow_statistics(text, ["_key"], None, schema), ddl)
    if labels is None:
        found = found.withColumn("_quality", F.lit(None).cast("long"))
    else:
        marks = labels.groupBy(F.col(key).alias("_label")).agg(F.min(F.col("quality").cast("long")).alias("_quality"))
        found = found.join(marks, F.col("_key") == F.col("_label")).drop("_label")
    # One row of each key, however often it occurs.
    each = found.groupBy("_key").agg(F.min(F.struct("_quality", *COUNTS, "features")).alias("r")).select("_key", "r.*")
    each = each.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_key"), 11) / F.lit(2.0**53)
    return materialize(each.select("_quality", "features", draw.alias("_draw")))


def fit(docs: DataFrame, labels: DataFrame | None, text: str = "text", key: str = "doc_id", good_kept: float = 0.999, bad_share: float = 0.03, seed: int = 7, trees: int = 300, points: int = 128) -> Forest:
    """Fits the forest and its limit on all labelled documents, without labels on all documents.

    Weights of features and the limit are of all rows. Each tree grows on `points` rows, as the method has it: they are
    drawn from trees * points rows (a tenth more, so that there are enough), in which every row has the same chance
    by a seeded hash of its key; where there are fewer rows, from all. The rows are those that pass the hard limits; those
    labelled bad (quality 0) are thinned to `bad_share` of the others, as a forest isolates what is rare, and half that
    share of rows with values from the whole range for each of RANGES is added. The limit on the score lies above that of the share `good_kept` of the rows labelled good
    (without any, of all rows), by a margin that is wider where labels are few, or a third of the way to most bad rows.
    """
    table = _passed(docs, labels, text, key, seed)
    is_good, is_bad = F.col("_quality") == 1, F.col("_quality") == 0
    number = table.agg(F.count("*"), F.count(F.when(is_good, 1)), F.count(F.when(is_bad, 1))).head()
    n, n_good, n_bad = (int(x) for x in number)
    if not n:
        return fit_forest(np.zeros((0, len(FEATURES))), trees, points, seed)
    most = 1.1 * trees * points
    chance = F.when(is_bad, F.lit(most / max(n_bad, 1))).otherwise(F.lit(most / max(n - n_bad, 1)))
    drawn = table.where(F.col("_draw") < chance).select("_quality", "features").toArrow()
    x = drawn["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    quality_ = drawn["_quality"].to_pandas().to_numpy(float, na_value=np.nan)
    others, bad = x[quality_ != 0], x[quality_ == 0]
    bad = bad[np.lexsort(bad.T)]
    few = bad[np.random.default_rng(seed).permutation(len(bad))[: int(bad_share * len(others)) + 1]]
    grown = np.concatenate((others, few))
    grown = grown[np.lexsort(grown.T)]
    # Edges only set how fine the counts are.
    good = x[quality_ == 1]
    edges = [np.unique(np.quantile(good[:, k], np.linspace(0, 1, 4097), method="nearest") if len(good) > 4096 else good[:, k]) for k in range(len(FEATURES))]
    weight = _weights(*_bin_counts(table, edges)) if n_good and n_bad else np.ones(len(FEATURES))
    forest = fit_forest(np.concatenate((grown, _spread(grown, bad_share / 2, seed))), trees, points, seed, weight)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(_features(batch)))], names=["_quality", "score"])

    scores = materialize(table.select("_quality", "features").mapInArrow(scored, "_quality long, score double"))
    top = quantile(scores.where(is_good) if n_good else scores, good_kept)
    limit = top + (0.01 if n_good >= 200 else 0.04)
    forest.limit = max(limit, (2 * top + quantile(scores.where(is_bad), 0.1)) / 3) if n_bad else limit
    return forest


def apply_rules(docs: DataFrame, forest: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Statistics and verdict of every document: key, COUNTS, base_failed, anomaly_score, kept.

    A null or empty text has no words and fails the base rule. Repeated rows give repeated results, null keys stay null.
    One pass over the documents in steps of a few MB of text; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[key]
    arrow = docs.select(key).limit(0).toArrow().schema.field(0).type
    schema = pa.schema(
        [(key, arrow), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("anomaly_score", pa.float64()), ("kept", pa.bool_())]
    )
    ddl = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly_score double, kept boolean"
    return docs.select(key, text).mapInArrow(_arrow_statistics(text, [key], forest, schema), ddl)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns."""
    kept = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, text):
            counts, features = statistics(data, offsets)
            mask = ~base_failed(counts) & (forest.score(features) <= forest.limit)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in batch.columns], names=kept)

    return docs.mapInArrow(run, docs.schema)
