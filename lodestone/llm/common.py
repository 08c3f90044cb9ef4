"""Shared plumbing of the training-data operators: work tables, row keys, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word: a run without blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one NumPy step works on (a single longer document makes a longer step).
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where the session names none (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write a frame to the shared folder and reread it: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def tasks_for(spark: SparkSession, nbytes: int, each: int) -> int:
    """A number of partitions that follows the data, never under what the session asks for."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // each)))


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches, with the bytes of their texts and the offsets of each row in these (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


#: Bits of a sieve: SIEVE_EACH a key, and SIEVE_MOST (32 MB) in all; with very many keys it holds back less.
SIEVE_EACH, SIEVE_MOST = 16, 1 << 28


class Sieve:
    """A Bloom filter over 64-bit hashes: passes all hashes that it was made of, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        hashes = hashes.view(np.uint64)
        return np.stack([mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(size - 1) for k in range(4)]).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, 8 * len(self.bits))
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0) if len(hashes) else np.zeros(0, bool)


def sieve(hashes: DataFrame):
    """A broadcast Sieve of a column of longs. Tasks set bits in blocks of 4 KB, which Spark unites; the driver sees the
    bits alone, SIEVE_MOST at most. What passes is to be joined exactly."""
    spark = hashes.sparkSession
    size = 1 << 15
    while size < min(SIEVE_MOST, SIEVE_EACH * hashes.count()):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Sieve.places(batch.column(0).to_numpy(), size).ravel())], names=["at"])

    block, place = F.shiftright("at", 15), F.col("at").bitwiseAND(F.lit((1 << 15) - 1))
    found = hashes.mapInArrow(run, "at long").groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for at, part in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        bits[at << 12 : (at + 1) << 12] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(Sieve(bits))


class Words:
    """Words of several texts at once: start and end in the bytes, and the row they belong to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.rows = len(offsets) - 1
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        inside = ~blank
        first = inside.copy()
        first[1:] &= blank[:-1]
        heads = offsets[:-1]
        heads = heads[heads < len(data)]
        first[heads] |= inside[heads]
        last = inside.copy()
        last[:-1] &= blank[1:]
        tails = offsets[1:] - 1
        tails = tails[tails >= 0]
        last[tails] |= inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        #: Number of words, and index of the first word, of each row.
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * STEP_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z."""
    return _FOLD[data]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any range of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from the words' hashes (fewer than n words: none)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + size]
    return mix(out)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
