"""Packing: token counts, shortest-pack-first over the histogram of lengths, and places for every piece by its rank."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, steps

#: Pieces of one length are ranked in so many groups, whose sizes then give each group its first rank.
GROUPS = 1024
_tokenizers: dict = {}


def encoder(vocabulary: str, ranks: str):
    """A function from texts to lists of ids, equal to those of the `tokenizers` file `vocabulary`.

    The byte-level file and the rank file hold the same vocabulary; the rank library gives the same ids about three
    times as fast. Texts that hold the special token's string go through the `tokenizers` library itself.
    """
    if vocabulary not in _tokenizers:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        exact = Tokenizer.from_file(vocabulary)

        def encode(text: str) -> list[int]:
            if "<|endoftext|>" in text:
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _tokenizers[vocabulary] = encode
    return _tokenizers[vocabulary]


def pieces(docs: DataFrame, limit: int, end_id: int, text: str, key: str, vocabulary: str, ranks: str) -> DataFrame:
    """Pieces of each document: whole ones of `limit` ids, and the rest. Ids themselves never leave the worker."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch, data, offsets in steps(batches, text, 1 << 20):
            rows, out = [], []
            for row in range(len(offsets) - 1):
                ids = encode(bytes(data[offsets[row] : offsets[row + 1]]).decode("utf-8", "replace"))
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                for start in range(0, len(ids), limit):
                    part = raw[4 * start : 4 * (start + limit)]
                    rows.append(row)
                    out.append((start, len(part) // 4, zlib.crc32(part), len(ids)))
            keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(rows))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True))], names=[key, *(n for n, _ in schema)])

    ddl = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(key, text).mapInArrow(run, ddl)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths) for a histogram of lengths.

    Lengths go longest first, each into the pack with most room; where none has room they open packs. Patterns with
    the same room are one stack, of which a part may be taken, so each length splits one pattern at most: there are at
    most twice as many patterns as lengths, however many documents there are.
    """
    heap: list[tuple[int, int, int, tuple[int, ...]]] = []  # -room, age, count, lengths
    age = 0
    for length in sorted(histogram, reverse=True):
        left, later = histogram[length], []
        while left:
            if heap and -heap[0][0] >= length:
                room, _, count, lengths = heapq.heappop(heap)
                used = min(count, left)
                if used < count:
                    later.append((room, age, count - used, lengths))
                    age += 1
                entry = (room + length, age, used, (*lengths, length))
            else:
                used, entry = left, (length - limit, age, left, (length,))
            age += 1
            left -= used
            # Packs that have just taken a piece still compete for the next one.
            heapq.heappush(heap, entry)
            while later:
                heapq.heappush(heap, later.pop())
    return [(count, lengths) for _, _, count, lengths in sorted(heap, key=lambda x: x[1])]


def pack(
    docs: DataFrame,
    limit: int = 2048,
    end_id: int = 1,
    text: str = "text",
    key: str = "doc_id",
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Packs documents, cut at multiples of `limit` ids, into sequences of at most `limit` ids.

    Returns per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the end
    id alone. Repeated rows are packed as often as they occur; rows equal in all respects share their places in an
    arbitrary order. Sequence ids count from 0 without gaps; an empty table gives an empty result.

    Scale: one pass of Python over the texts; then only narrow rows move. The histogram has at most `limit` rows, and
    the patterns at most twice as many, whatever the input: these alone go through the driver and are broadcast.
    Ranks within a length are taken in GROUPS groups each, so copies of one length don't meet in one task.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = materialize(pieces(docs, limit, end_id, text, key, vocabulary, ranks)).withColumn(
        "_group", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(GROUPS))
    )
    sizes = table.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, limit)
    # Per length, the ranks that each pattern takes: rank -> copy of the pattern and place in it.
    places, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            per = lengths.count(length)
            places.append((length, used[length], used[length] + count * per, per, sequence, offset))
            used[length] += count * per
            offset += per * length
        sequence += count
    slots = spark.createDataFrame(places, "_length long, _from long, _to long, _per long, _sequence long, _offset long")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_group").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = table.withColumn("_place", F.row_number().over(order)).join(firsts, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    within = F.col("_rank") - F.col("_from")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    ).select(
        key, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(within / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (within % F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )
