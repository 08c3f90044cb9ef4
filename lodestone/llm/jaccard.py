"""N-gram Jaccard join: an exact cut by signatures, Voronoi regions of pivots with triangle-inequality windows, recursion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, fold, grams, materialize, mix, prefix_hash, range_hash, runs, sieve, steps
from .components import components


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as 64-bit hashes, sorted, and the offsets of each text in them.

    A-Z are lower-cased. A text with fewer than n words has its whole sequence as the only one; without words, none.
    """
    data = fold(data)
    words, rows = Words(data, offsets), len(offsets) - 1
    word = range_hash(prefix_hash(data), words.start, words.end)
    full = words.row[n - 1 :] == words.row[: max(0, len(word) - n + 1)]
    value, row = grams(word, n)[full], words.row[: len(full)][full]
    for size in range(1, n):
        at = np.flatnonzero(words.count == size)
        if len(at):
            short = np.full(len(at), size, np.uint64)
            for k in range(size):
                short = short * np.uint64(0xD1342543DE82EF95) + word[words.first[at] + k]
            value, row = np.concatenate((value, mix(short))), np.concatenate((row, at))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(rows + 1))


def farthest(size: np.ndarray, percent: int) -> np.ndarray:
    """The most elements by which a set of `size` can differ from a linked one (the symmetric difference)."""
    both = size + (100 * size) // percent
    return ((100 - percent) * both) // (100 + percent)


#: Members of a region that are compared all with all in one step; larger regions are cut by pivots.
CELL = 2048
#: First parts of a set, whole, that tell in which of its regions a pair is looked at.
HEAD = 8
#: Members of a region in one task, and shingles of these; larger regions are dealt into pairs of blocks.
BLOCK, BLOCK_SHINGLES = 8192, 1 << 22
#: Nodes that a task remembers, to send a set that it has met before once only.
REMEMBERED = 1 << 20
#: Members of an exact region that are compared one by one, without pivots.
LEAF = 32


def level_of(size: np.ndarray) -> np.ndarray:
    """Sizes 1, 2, 3-4, 5-8, ... are levels 0, 1, 2, 3, ..."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def parts_of(level: np.ndarray, percent: int) -> np.ndarray:
    """Number of parts on a level: a quarter more than the most differences of a set on it, so that few stay empty."""
    return (5 * farthest(np.left_shift(1, level), percent)) // 4 + 4


def sketches(value: np.ndarray, starts: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sketches of sets, and the signatures among them of which two linked sets always share one.

    Sets of like size split the universe of shingles into the same parts, by hash; a sketch holds a hash of each part
    (0: empty). Two linked sets differ in at most d = farthest() elements, hence in d parts at most, so among the first
    d + 1 filled parts of a set one is equal in both: these are its signatures. A whole part must be equal, so a passage
    or a shingle that many documents share makes no group by itself. Sizes are levelled by powers of 2; a set whose
    partners may lie on the next level has a sketch for that level too. Sets with fewer than d + 1 filled parts have one
    more signature, "sparse", of part -1.

    Yields per level rule: rows, their levels, offsets into the sketches, the sketches, and signatures' row and part.
    """
    size = np.diff(starts)
    rows = len(size)
    level = level_of(size)
    for extra in (0, 1):
        chosen = size > 0 if not extra else (size > 0) & ((100 * size) // percent > np.left_shift(1, level))
        if not chosen.any():
            continue
        who = np.flatnonzero(chosen)
        at = level + extra
        parts = np.where(chosen, parts_of(at, percent), 0)
        bounds = np.concatenate(([0], np.cumsum(parts)))
        row = np.repeat(np.arange(rows), size)
        keep = chosen[row]
        row, v = row[keep], value[keep]
        salt = mix(at[row].astype(np.uint64) + np.uint64(1000))
        part = (((mix(v ^ salt) >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        place = bounds[row] + part
        order = np.argsort(place, kind="stable")
        place, v = place[order], v[order]
        first = runs(place)
        total = mix(np.add.reduceat(mix(v), first))
        sketch = np.zeros(bounds[-1], np.uint64)
        sketch[place[first]] = total | np.uint64(1)
        owner = np.searchsorted(bounds, place[first], "right") - 1
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        need = farthest(size, percent) + 1
        used = rank < need[owner]
        sparse = np.flatnonzero(chosen & (np.bincount(owner, minlength=rows) < need))
        sig_row = np.concatenate((owner[used], sparse))
        sig_part = np.concatenate((place[first][used] - bounds[owner[used]], np.full(len(sparse), -1)))
        yield who, at, bounds, sketch, sig_row, sig_part


def classes_of(level: np.ndarray) -> np.ndarray:
    """Number of classes on a level: two for each element of its largest set."""
    return np.maximum(64, np.left_shift(2, level))


def parities(value: np.ndarray, starts: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each class of a set's level holds an odd number of its elements, as bits in bytes; and the sets' offsets
    in these. The number of classes in which two sets differ is a metric, and no more than their symmetric difference,
    of which it is most where that is small."""
    count = classes_of(level)
    bounds = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(level)), np.diff(starts))
    class_ = (((mix(value + np.uint64(0x51ED270B)) >> np.uint64(32)) * count[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    return np.packbits((np.bincount(bounds[row] + class_, minlength=bounds[-1]) & 1).astype(bool)), bounds // 8


def _fresh(names: list[int | None], met: set[int | None]) -> np.ndarray:
    """Rows whose set the task meets for the first time."""
    out = []
    for row, name in enumerate(names):
        if name not in met:
            out.append(row)
            if len(met) < REMEMBERED:
                met.add(name)
    return np.array(out, np.int64)


def _signatures(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Signatures of each set: node, level, signature. A set that a task meets again is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int | None] = {None}
        for _, data, offsets in steps(batches, text, 2 << 20):
            value, starts = shingles(data, offsets, n)
            names = _nodes(value, starts)
            fresh, size = _fresh(names, met), np.diff(starts)
            if not len(fresh):
                continue
            node = np.array([names[k] for k in fresh], np.int64)
            value, starts = value[_ranges_of(starts[fresh], size[fresh])], np.concatenate(([0], np.cumsum(size[fresh])))
            for _, at, bounds, cells, row, part in sketches(value, starts, percent):
                cell = cells[np.maximum(bounds[row] + part, 0)]
                cell[part < 0] = 0
                signature = mix(cell + mix((part + 1).astype(np.uint64) * np.uint64(64) + at[row].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(at[row].astype(np.int32)), pa.array(signature.view(np.int64))], names=["node", "level", "signature"])

    return docs.select(text).mapInArrow(run, "node long, level int, signature long")


def _lines(docs: DataFrame, text: str, key: str, n: int, percent: int, held) -> DataFrame:
    """A line of each row (`row` true): key, node (null without shingles), size of the set; and one on each level of a set
    that the sieve `held` passes and that the task meets for the first time: node, n, level, sketch (the first HEAD parts,
    and the parities of the classes)."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = [key, "node", "n", "row", "level", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int | None] = {None}
        for batch, data, offsets in steps(batches, text, 2 << 20):
            value, starts = shingles(data, offsets, n)
            listed, size, keys = _nodes(value, starts), np.diff(starts), batch.column(batch.schema.get_field_index(key))
            node = pa.array(listed, pa.int64())
            yield pa.RecordBatch.from_arrays([keys, node, pa.array(size), pa.array(np.ones(len(size), bool)), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names=names)
            passed = np.flatnonzero(held.value.holds(node.fill_null(0).to_numpy()))
            fresh = passed[_fresh([listed[k] for k in passed], met)] if len(passed) else passed
            if not len(fresh):
                continue
            value, starts = value[_ranges_of(starts[fresh], size[fresh])], np.concatenate(([0], np.cumsum(size[fresh])))
            for who, at, bounds, cells, _, _ in sketches(value, starts, percent):
                bits, places = parities(value, starts, np.where(np.isin(np.arange(len(fresh)), who), at, 0))
                out = []
                for k in who.tolist():
                    head = np.zeros(HEAD, np.uint64)
                    own = cells[bounds[k] : bounds[k + 1]][:HEAD]
                    head[: len(own)] = own
                    out.append(head.tobytes() + bits[places[k] : places[k + 1]].tobytes())
                rows = pa.array(fresh[who])
                columns = [pa.nulls(len(who), keys.type), node.take(rows), pa.array(size[fresh[who]]), pa.array(np.zeros(len(who), bool)), pa.array(at[who].astype(np.int32)), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, node long, n long, row boolean, level int, sketch binary")


def _ranges_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start..start + size of several ranges, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _nodes(value: np.ndarray, starts: np.ndarray) -> list[int | None]:
    """A 64-bit hash of each whole set; none for an empty one."""
    raw = value.tobytes()
    return [int.from_bytes(hashlib.md5(raw[8 * a : 8 * b]).digest()[:8], "big", signed=True) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _texts(docs: DataFrame, text: str, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """One packed text of each wanted node (key, node): node, packed. Only texts whose key passes a sieve of the wanted
    ones move, packed."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    wanted = materialize(wanted.withColumn("_hash", F.xxhash64("_key")))
    held = sieve(wanted.select("_hash"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            chosen = whole.filter(pa.array(held.value.holds(whole.column(2).to_numpy())))
            for batch, data, offsets in steps(iter([chosen]), text):
                raw, value_starts = data.tobytes(), shingles(data, offsets, n)
                packed = [packer.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nodes(*value_starts), pa.int64()), pa.array(packed, pa.binary())], names=["_key", "_node", "packed"])

    rows = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(key)).alias("_hash"))
    packed = rows.mapInArrow(pack, f"_key {kind}, _node long, packed binary")
    # A key may have other texts than the wanted node's.
    found = packed.join(wanted.select("node"), F.col("_node") == F.col("node"), "left_semi")
    return found.groupBy(F.col("_node").alias("node")).agg(F.min("packed").alias("packed"))


def near(bits: np.ndarray, size: np.ndarray, percent: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, differing bits) of members that may link, by their parities (rows of bytes), with i < j; each pair
    once at least.

    The number of differing bits is a metric, and no more than the symmetric difference of the sets. A region of more
    than CELL members is cut by pivots: each member goes to the cell of its nearest pivot, and to all cells whose pivot
    is at most 2 d farther (d: the most that linked sets differ by), so that both ends of a pair meet in the nearest cell
    of either. Cells join in the same way; one that does not shrink is compared in blocks.
    """
    words, count = np.ascontiguousarray(bits).view(np.uint64), len(bits)
    most = int(farthest(size, percent).max(initial=0))
    if count > CELL and depth < 8:
        pivots = np.linspace(0, count - 1, max(2, count // CELL * 2)).astype(int)
        away = np.stack([np.bitwise_count(words ^ words[p]).sum(1, dtype=np.int32) for p in pivots], 1)
        inside = away <= away.min(1, keepdims=True) + 2 * most
        if inside.sum() < 1.5 * count:
            for k in range(len(pivots)):
                cell = np.flatnonzero(inside[:, k])
                for i, j, h in near(bits[cell], size[cell], percent, depth + 1):
                    yield cell[i], cell[j], h
            return
    step = max(1, (16 << 20) // max(1, count * words.shape[1] * 8))
    for a in range(0, count, step):
        own, n = words[a : a + step], size[a : a + step, None]
        fits = (100 * np.minimum(n, size[None, :]) >= percent * np.maximum(n, size[None, :])) & (np.arange(count)[None, :] > np.arange(a, min(a + step, count))[:, None])
        differ = np.bitwise_count(own[:, None, :] ^ words[None, :, :]).sum(2, dtype=np.int32)
        i, j = np.nonzero(fits & (differ <= ((100 - percent) * (n + size[None, :])) // (100 + percent)))
        yield i + a, j, differ[i, j]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other; those of a cell stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        heads = np.append(runs(cells), len(cells))
        if held and held[0].column(0)[0].as_py() != cells[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(cells):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _place(members: DataFrame, sketches_: DataFrame) -> DataFrame:
    """Members of regions with their sketches, a region to a cell; regions of more than a block's members are dealt into
    cells of two blocks each, so no task holds more than two blocks of one region."""
    block = F.greatest(F.lit(min(BLOCK, 64)), F.least(F.lit(BLOCK), F.expr(f"shiftright({BLOCK_SHINGLES}, level)")))
    counted = members.groupBy("region").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    side = F.pmod(F.col("node"), blocks).cast("int")
    mates = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64("region", F.least(k, side), F.greatest(k, side)))
    dealt = members.join(counted, "region").select("node", "level", side.alias("side"), F.explode(mates).alias("cell"))
    joined = dealt.join(sketches_, ["node", "level"])
    return joined.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "n", "side", "sketch")


def _near_members(placed: DataFrame, percent: int) -> DataFrame:
    """Members (cell, node, side) with a near partner, by sketches, from cells whose members stand together.

    A pair may share many regions. It is looked at in that of the first part which both share (linked sets use that part
    both: of the first d + 1 parts that either fills, one is equal); pairs that share none of the first HEAD parts, in all
    of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            count = table.num_rows
            if count < 2:
                continue
            size, side = table["n"].to_numpy(), table["side"].to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(count, -1)
            head = np.ascontiguousarray(sketch[:, : 8 * HEAD]).view(np.uint64)
            common = ((head == head[0]) & (head[0] != 0)).all(0)
            own = int(common.argmax()) if common.any() else HEAD
            split = side.min() != side.max()
            hit = np.zeros(count, bool)
            for i, j, _ in near(sketch[:, 8 * HEAD :], size, percent):
                same = (head[i, :own] == head[j, :own]) & (head[i, :own] != 0)
                # In a cell of two blocks, pairs within a block belong to the block's own cell.
                kept = ~same.any(1) & ((side[i] != side[j]) | (not split))
                hit[i[kept]] = True
                hit[j[kept]] = True
            if hit.any():
                yield from table.select(["cell", "node", "side"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return placed.mapInArrow(run, "cell long, node long, side int")


class Region:
    """Sets of one cell, and the links among them that are found so far."""

    def __init__(self, value: np.ndarray, starts: np.ndarray, side: np.ndarray, percent: int):
        self.flat = np.unique(value, return_inverse=True)[1].astype(np.int32)
        self.starts, self.size, self.side, self.percent = starts, np.diff(starts), side, percent
        self.mark = np.zeros(int(self.flat.max(initial=-1)) + 1, bool)
        self.root = np.arange(len(self.size))
        self.split = side.min() != side.max()
        self.links: list[tuple[int, int]] = []

    def measure(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances of the others from the pivot; those that link are joined with it."""
        own = self.flat[self.starts[pivot] : self.starts[pivot + 1]]
        self.mark[own] = True
        held = self.mark[self.flat[_ranges_of(self.starts[others], self.size[others])]]
        shared = np.add.reduceat(held, np.cumsum(self.size[others]) - self.size[others], dtype=np.int64)
        self.mark[own] = False
        either = self.size[others] + self.size[pivot] - shared
        for k in others[100 * shared >= self.percent * either].tolist():
            if self.root[k] != self.root[pivot]:
                self.links.append((pivot, k))
                self.root[self.root == self.root[k]] = self.root[pivot]
        return 1 - shared / either

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Finds links until all linked members have one root.

        Each member belongs to the region of its nearest pivot (a Voronoi region), and to those whose pivot is at most
        2 t farther (t: the largest distance of linked sets). Linked sets are t apart at most, so both ends of a link
        stand in the nearest region of either. Regions join in the same way. Where windows are as wide as the whole
        region, its members become pivots one by one, each measured against those that the triangle inequality leaves."""
        if len(members) < 2 or (self.root[members] == self.root[members[0]]).all():
            return
        most = 1 - self.percent / 100 + 1e-9
        away = np.zeros((len(members), 0))
        if len(members) > LEAF and depth < 8:
            pivots = members[np.linspace(0, len(members) - 1, min(16, len(members) // LEAF + 1)).astype(int)]
            away = np.stack([self.measure(int(p), members) for p in pivots], 1)
            inside = away <= away.min(1, keepdims=True) + 2 * most
            if inside.sum() < 1.5 * len(members):
                for k in range(len(pivots)):
                    self.join(members[inside[:, k]], depth + 1)
                return
        for k in range(len(members) - 1):
            one, rest = int(members[k]), members[k + 1 :]
            small, large = np.minimum(self.size[rest], self.size[one]), np.maximum(self.size[rest], self.size[one])
            open_ = (self.root[rest] != self.root[one]) & (100 * small >= self.percent * large)
            if self.split:
                open_ &= self.side[rest] != self.side[one]
            open_ &= (np.abs(away[k + 1 :] - away[k]) <= most).all(1)
            if open_.any():
                self.measure(one, rest[open_])


def _join_cells(placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes, from cells whose members stand together with their packed texts: as many as join all linked
    members, fewer than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for table in _cells(batches):
            if table.num_rows < 2:
                continue
            node, values, sizes = table["node"].to_numpy(), [], []
            for k in range(0, table.num_rows, 200):
                texts = [unpacker.decompress(x) for x in table["packed"].slice(k, 200).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
                value, starts = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets, n)
                values.append(value)
                sizes.append(np.diff(starts))
            region = Region(np.concatenate(values), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), table["side"].to_numpy(), percent)
            region.join(np.arange(table.num_rows))
            if region.links:
                a, b = np.array(region.links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of `percent` or more.

    Returns key, n_shingles, component_id (the smallest key that links reach; the own one without links).

    1. Documents with equal sets become one node; nodes are 64-bit hashes of sets of 64-bit shingle hashes.
    2. Nodes that share a signature form a region; equal regions are one. Linked nodes meet in a region, as sketches()
       loses none. Jaccard distances of documents are 1 almost everywhere, so this exact cut comes before any pivot.
    3. Sketches live in a metric space in which linked nodes are near; near() tells which members of a region may have a
       partner there. Only the texts of these move.
    4. Each region joins recursively around pivots, on whole sets (Region), and returns links that join all its linked
       members, fewer than these; the links of all regions give the components.

    Null and empty texts link with nothing. Null keys never name a component unless all of its keys are null. Repeated
    rows and further columns are harmless.
    """
    group = Window.partitionBy("signature")
    lowest, highest = F.min("node").over(group), F.max("node").over(group)
    region = F.xxhash64("level", F.bit_xor("node").over(group), F.sum(F.pmod("node", F.lit((1 << 31) - 1))).over(group), F.count("*").over(group), lowest, highest)
    grouped = _signatures(docs, text, n, percent).select("node", "level", region.alias("region"), lowest.alias("_low"), highest.alias("_high")).where("_low <> _high")
    members = materialize(grouped.select("region", "node", "level").distinct())
    held = sieve(members.select("node").distinct())
    table = materialize(_lines(docs, text, key, n, percent, held)).withColumnRenamed(key, "_key")
    rows = table.where("row")
    filled = rows.where("node is not null")
    sketched = table.where("not row").groupBy("node", "level").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    near_ = materialize(_near_members(_place(members, sketched), percent))
    keys = filled.groupBy("node").agg(F.min("_key").alias("_key"))
    texts = _texts(docs, text, key, near_.select("node").distinct().join(keys, "node"), n)
    whole = near_.join(texts, "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "side", "packed")
    roots = materialize(components(materialize(_join_cells(whole, n, percent))))
    named = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("_key").alias("component_id"))
    classes = materialize(named.join(smallest, "root").select("node", "component_id"))
    linked = filled.select("_key", "n", "node").join(classes, "node").select("_key", "n", "component_id")
    alone = rows.where("node is null").select("_key", "n", F.col("_key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each component, the row with the smallest key (null last) and, of rows
    with that key, the one whose text hashes lowest, once. Rows without shingles stay, but repeated ones once.

    Texts move only if their row passes a sieve of those that may go."""
    row_key = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("text"))
    groups = join(docs.select(F.col(text), row_key.alias("_id")), text, "_id", n, percent)
    counted = groups.groupBy("_id").agg(F.min("component_id").alias("_first"), F.count("*").alias("_rows"))
    doomed = materialize(counted.where((F.col("_id") != F.col("_first")) | (F.col("_rows") > 1)))
    held = sieve(doomed.select(F.xxhash64("_id")))
    passes = F.pandas_udf(lambda h: pd.Series(held.value.holds(h.to_numpy())), "boolean")
    rows = docs.select(F.struct("*").alias("_row"), row_key.alias("_id")).withColumn("_caught", passes(F.xxhash64("_id")))
    sure = rows.where(~F.col("_caught")).select("_row.*")
    caught = rows.where("_caught").join(doomed.withColumnRenamed("_id", "_other"), F.col("_id") == F.col("_other"), "left")
    # Of rows with equal keys and texts, any one stays.
    left = caught.where(F.col("_other").isNull() | (F.col("_id") == F.col("_first")))
    return sure.unionByName(left.groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*"))
