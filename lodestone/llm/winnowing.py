"""Document fingerprints by winnowing, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: A fingerprint is one long: HASH_BITS of the gram's hash, then the place counted from the end of PLACE_BITS, so that
#: the smallest long of a window is the smallest hash, and of equal ones the rightmost.
HASH_BITS, PLACE_BITS = 36, 27
_HASH, _PLACE = (1 << HASH_BITS) - 1, (1 << PLACE_BITS) - 1
_BLANKS = " \t\n\x0b\x0c\r"
#: Rows that a window task takes, and the most ranges of keys.
RANGE_ROWS, MAX_RANGES = 4096, 1000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column, gram: int = 3, window: int = 6) -> Column:
    """Fingerprints of a text as array<long>, in the order of their places, without repeats.

    Grams are `gram` words in a row (a shorter text: all its words); of each `window` grams in a row the one with the
    smallest hash is kept, the rightmost of equal ones. Two texts with window + gram - 1 words in common in a row share
    a fingerprint. A text without words has none.
    """
    trimmed = F.trim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def from_(count: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(count, F.lit(0)))

    def grams(h: Column) -> Column:
        def packed(i: Column) -> Column:
            value = F.xxhash64(F.slice(h, i + 1, F.lit(gram))).bitwiseAND(F.lit(_HASH))
            return F.shiftleft(value, PLACE_BITS).bitwiseOR(F.lit(_PLACE) - i)

        return F.transform(from_(F.size(h) - gram), packed)

    def chosen(p: Column) -> Column:
        return F.array_distinct(F.transform(from_(F.size(p) - window), lambda i: F.array_min(F.slice(p, i + 1, F.lit(window)))))

    none = F.array().cast("array<bigint>")
    return _let(hashes, lambda h: F.when(F.size(h) == 0, none).otherwise(_let(grams(h), chosen)))


def spelled(prints: Column) -> Column:
    """Fingerprints as a string: hash in hexadecimal and place (index of the gram's first word), blanks between."""
    return F.array_join(
        F.transform(prints, lambda p: F.concat_ws(":", F.hex(F.shiftright(p, PLACE_BITS)), F.lit(_PLACE) - p.bitwiseAND(F.lit(_PLACE)))), " "
    )


def hashes_of(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: F.shiftright(p, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared.cast("double") / either)


def with_next(rows: DataFrame, key: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns of the next row in ascending order of an integer key (nulls first, ties by `tie`), the last row's next
    being the first. `columns` maps new names to columns of `rows`.

    Rows are dealt into ranges of the key between approximate percentiles; the first rows of each range are also dealt
    to the range before, so a range's last row finds its next there, and the ranges run on their own. Only the ranges'
    bounds (MAX_RANGES at most) pass the driver.
    """
    spark = rows.sparkSession
    count = rows.count()
    ranges = max(1, min(MAX_RANGES, count // RANGE_ROWS))
    points = [k / ranges for k in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(key, F.array(*map(F.lit, points)), 10 * ranges).alias("b")).head()["b"] if points else []
    literal = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<bigint>")
    dealt = rows.withColumn("_range", F.coalesce(F.size(F.filter(literal, lambda b: b <= F.col(key))), F.lit(0)))
    heads = dealt.groupBy("_range").agg(F.min(key).alias("first"), F.max(F.col(key).isNull()).alias("none")).orderBy("_range").collect()
    before = [(h["_range"], heads[k - 1]["_range"], None if h["none"] else h["first"]) for k, h in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "_head_range int, _before int, _first long"))
    marked = dealt.join(table, F.col("_range") == F.col("_head_range"))
    copies = F.when(
        F.col(key).eqNullSafe(F.col("_first")),
        F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("x"))),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x"))))
    spread = marked.withColumn("_to", F.explode(copies))
    order = Window.partitionBy("_to.r").orderBy("_to.x", F.col(key).asc_nulls_first(), tie)
    out = spread.select("*", *[F.lead(source).over(order).alias(name) for name, source in columns.items()])
    return out.where("_to.x = 0").drop("_range", "_head_range", "_before", "_first", "_to")


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = 3, window: int = 6) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness.

    The edited text is the document with its last floor(n/2) code points replaced by the first as many (or all) of the
    next document's. A null text is empty; repeated rows and equal keys follow each other in the order of their texts'
    hashes; a single document is its own next; an empty table gives an empty result. Other columns are not returned.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).withColumns(
        {"n_chars": F.length("text").cast("long"), "_tie": F.xxhash64("text")}
    )
    rows = rows.select("*", winnow(F.col("text"), gram, window).alias("_prints"))
    paired = with_next(rows, "doc_id", "_tie", {"_next_text": "text", "_next_prints": "_prints"})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("_next_text", half))
    paired = paired.select("doc_id", "n_chars", "_prints", "_next_prints", edited.alias("_edited"))
    done = paired.select("doc_id", "n_chars", "_prints", "_next_prints", F.sha2("_edited", 256).alias("edited_sha256"), winnow(F.col("_edited"), gram, window).alias("_edited_prints"))
    own = hashes_of(F.col("_prints"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("_prints")).alias("fingerprint"),
        spelled(F.col("_edited_prints")).alias("edited_fingerprint"),
        likeness(own, hashes_of(F.col("_edited_prints"))).alias("near_edited"),
        likeness(own, hashes_of(F.col("_next_prints"))).alias("near_next"),
    )
