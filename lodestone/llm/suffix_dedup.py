"""Suffix-array dedup: every byte of a long string that also starts elsewhere, exactly, from a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_hash, range_hash, runs, steps, tasks_for, text_of

#: Bytes at an anchor that must recur before its suffixes are looked at.
LEAD = 32
_RUN = "rid long, low int, high int, anchor int, lead long, body long"


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The strings of `length` bytes of each text, dealt to anchors: row, first and last start, anchor (in the text),
    hash of the LEAD bytes at the anchor, and hash of all bytes of the run's strings.

    A string's anchor is the place in it where LEAD bytes have the smallest hash (the leftmost of equal ones). It depends
    on the string's bytes alone, so equal strings have anchors with equal leads at equal places, and only suffixes
    around one anchor in about length/2 bytes need to be sorted.
    """
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    sums = prefix_hash(data)
    at = np.arange(n - LEAD + 1)
    place = np.uint64((1 << 27) - 1)
    value = (range_hash(sums, at, at + LEAD) & ~place) | at.astype(np.uint64)
    span, width = length - LEAD + 1, 1
    while width * 2 <= span:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if width < span:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    anchor = (value & place).astype(np.int64)  # of the string at each start
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[1:][row]
    start = np.flatnonzero(valid)
    if not len(start):
        return none
    new = np.concatenate(([True], (np.diff(start) > 1) | (anchor[start][1:] != anchor[start][:-1]) | (row[start][1:] != row[start][:-1])))
    low, high = start[new], np.append(start[np.flatnonzero(new)[1:] - 1], start[-1])
    a, row = anchor[low], row[low]
    base = offsets[row]
    return row, low - base, high - base, a - base, range_hash(sums, a, a + LEAD), range_hash(sums, low, high + length)


def _find_runs(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, "_text"):
            row, low, high, anchor, lead, body = anchor_runs(data, offsets, length)
            rid = batch.column(batch.schema.get_field_index("rid")).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([rid, *(pa.array(x.astype(np.int32)) for x in (low, high, anchor)), *(pa.array(x.view(np.int64)) for x in (lead, body))], names=["rid", "low", "high", "anchor", "lead", "body"])

    return rows.select("rid", "_text").mapInArrow(run, _RUN)


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs: body, own (a copy exists), shift (of the anchor), lead (bytes at it), bytes."""
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("low", "high", "anchor", "body", "own", "classes")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, "_text"):
            asked, raw = batch.column(1), data.tobytes()
            row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            parts = asked.flatten()
            low, high, anchor = (parts.field(k).to_numpy() + offsets[row] for k in range(3))
            bodies = [raw[a : b + length] for a, b in zip(low, high, strict=True)]
            leads = [raw[a : a + LEAD] for a in anchor]
            yield pa.RecordBatch.from_arrays([parts.field(3), parts.field(4), parts.field(5), pa.array((anchor - low).astype(np.int32)), pa.array(leads, pa.binary()), pa.array(bodies, pa.binary())], names=["body", "own", "classes", "shift", "lead", "bytes"])

    return rows.select("rid", "_text").join(asked, "rid").select("_text", "asked").mapInArrow(run, "body long, own boolean, classes long, shift int, lead binary, bytes binary")


def sort_bucket(lead: np.ndarray, shift: np.ndarray, own: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Suffixes of a bucket's strings, sorted by multikey quicksort with 8 bytes as a character: at each step equal ranges
    are split by the next 8 bytes, and ranges of one suffix are dropped. Those left after `length` bytes are repeats.

    Returns per suffix: record, place in it, whether it repeats, whether it is the first of its class.
    """
    size = np.diff(starts) - length + 1
    record = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(record)) - np.repeat(np.cumsum(size) - size, size)
    at = starts[record] + place
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    # Suffixes with different leads, or with the anchor at different places, differ.
    group = lead[record] * (1 << 20) + (shift[record] - place)
    order = np.argsort(group, kind="stable")
    group = group[order]
    done, first = np.zeros(len(record), bool), np.ones(len(record), bool)

    def split(order: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(fresh) - 1
        keep = np.bincount(number)[number] > 1
        return order[keep], number[keep]

    if len(order):
        order, group = split(order, np.concatenate(([True], group[1:] != group[:-1])))
    for step in range(0, length, 8):
        if not len(order):
            break
        w = word[at[order] + min(step, length - 8)]
        by = np.lexsort((w, group))
        order, w, group = order[by], w[by], group[by]
        order, group = split(order, np.concatenate(([True], (group[1:] != group[:-1]) | (w[1:] != w[:-1]))))
    done[order] = True
    if len(order):
        heads = np.zeros(len(order), bool)
        heads[runs(group)] = True
        first[order] = heads
    return record, place, done | own[record], first


def _sort(contents: DataFrame, length: int) -> DataFrame:
    """Repeats among the fetched strings. Ranges of leads come from Spark's sampled splitters; each is sorted on its
    own. A lead with more classes than its range holds goes on in the next range: its distinct suffixes are also
    returned as hashes (kind 1), to be compared across ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.combine_chunks()
        body, own, shift, classes = (table[c].to_numpy() for c in ("body", "own", "shift", "classes"))
        leads = np.frombuffer(b"".join(table["lead"].to_pylist()), np.dtype((np.void, LEAD)))
        lead = np.concatenate(([0], np.cumsum(leads[1:] != leads[:-1])))
        strings = table["bytes"].to_pylist()
        starts = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        data = np.frombuffer(b"".join(strings), np.uint8)
        record, place, done, first = sort_bucket(lead, shift.astype(np.int64), own.astype(bool), starts, data, length)
        edges = np.flatnonzero(done[1:] != done[:-1]) + 1 if len(done) else np.zeros(0, np.int64)
        cut = np.unique(np.concatenate(([0], edges, runs(record))))
        cut = cut[cut < len(done)]
        last = np.append(cut[1:], len(done)) - 1
        hit = done[cut]
        zero = np.zeros(int(hit.sum()), np.int64)
        yield _rows(0, body[record[cut[hit]]], place[cut[hit]], place[last[hit]], zero)
        edge = np.bincount(lead)[lead] < classes
        at = np.flatnonzero(edge[record] & first)
        hashes = range_hash(prefix_hash(data), starts[record[at]] + place[at], starts[record[at]] + place[at] + length)
        yield _rows(1, body[record[at]], place[at], place[at], hashes.view(np.int64))

    return contents.mapInArrow(run, "kind int, body long, first int, last int, hash long")


def _rows(kind: int, body: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(body), kind, np.int32)), pa.array(body), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(hashes)],
        names=["kind", "body", "first", "last", "hash"],
    )


def repeats(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id", bucket_bytes: int = 8 << 20, split_classes: int = 20000) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` as (key, rid, _text), and per rid the byte ranges that repeated strings cover (array of structs)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key), text_of(text).alias("_text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).alias("rid"))
    found = materialize(_find_runs(rows, length))
    # Leads that occur once end here, at the price of one long each.
    twice = found.groupBy("lead").agg(F.count("*").alias("_n")).where("_n > 1").select("lead")
    candidates = materialize(found.join(twice, "lead"))
    # Runs of equal bytes are one class, however many documents hold it.
    classes = candidates.groupBy("lead", "body").agg(F.count("*").alias("_n"), F.min(F.struct("rid", "low", "high", "anchor")).alias("one"))
    classes = materialize(classes)
    several = classes.groupBy("lead").agg(F.count("*").alias("classes")).where("classes > 1")
    whole = classes.where("_n > 1").select("body", F.lit(0).alias("first"), (F.col("one.high") - F.col("one.low")).alias("last"))
    wanted = classes.join(several, "lead").select("one.*", "body", (F.col("_n") > 1).alias("own"), "classes")
    contents = materialize(_fetch(rows, wanted, length))
    size = contents.agg(F.sum(F.octet_length("bytes"))).head()[0] or 0
    # Only leads of more than split_classes classes may be split between ranges; all others are whole in one.
    within = F.when(F.col("classes") > split_classes, F.col("bytes"))
    ranged = contents.repartitionByRange(tasks_for(spark, size, bucket_bytes), F.col("lead"), within).sortWithinPartitions("lead", "bytes")
    sorted_ = materialize(_sort(ranged, length))
    across = sorted_.where("kind = 1")
    shared = across.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash")
    parts = sorted_.where("kind = 0").select("body", "first", "last").unionByName(across.join(shared, "hash").select("body", "first", "last")).unionByName(whole)
    per_body = parts.groupBy("body").agg(F.collect_set(F.struct("first", "last")).alias("parts"))
    spans = candidates.join(per_body, "body").select("rid", F.explode(F.transform("parts", lambda p: F.struct((F.col("low") + p["first"]).alias("a"), (F.col("low") + p["last"] + length).alias("b")))).alias("s"))
    return rows, spans.groupBy("rid").agg(F.collect_set("s").alias("spans"))


def dedup(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id", keep_text: bool = False, **options) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also starts anywhere else, in the same or another
    text. Returns key, n_bytes, n_removed, n_spans, kept_sha256; keep_text adds what is left (`kept`, binary).

    Texts are UTF-8 bytes; a null text is empty; strings are judged on the input and never cross texts. Repeated rows are
    texts of their own, so they remove each other where long enough. Leads and classes are told apart by 64-bit hashes;
    within a range the sort compares bytes. Empty tables give empty results; other columns are not returned.

    Scale: only anchors move (one in about length/2 bytes), then only leads that recur; equal runs are one class before
    their bytes are fetched, so a passage that a third of all documents share is sorted once.
    """
    rows, spans = repeats(docs, length, text, key, **options)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches, "_text"):
            raw, spans, out = data.tobytes(), batch.column(2).to_pylist(), []
            for row, found in enumerate(spans):
                own = raw[offsets[row] : offsets[row + 1]]
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, last = [], 0
                for a, b in merged:
                    left.append(own[last:a])
                    last = b
                kept = b"".join(left) + own[last:]
                out.append((len(own), len(own) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays][: 5 + keep_text], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    ddl = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.join(spans, "rid", "left").select(key, "_text", "spans").mapInArrow(run, ddl)
