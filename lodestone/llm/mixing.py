"""Mixing sources to target weights: capped water-filling, and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of



def water_fill(sizes: DataFrame, total: Column | float, max_epochs: float) -> DataFrame:
    """Targets of sources: shares of `total` by weight, clamped at `max_epochs` times the size, the excess reshared.

    `sizes` has a row per source: source_size, weight. The reshare ends at a water level: sources whose cap/weight lies
    below it are clamped, all others get level * weight. Sorted by cap/weight, the clamped ones are a prefix, so running
    sums find the level in one pass instead of a loop. The window spans the sources, not the documents.
    """
    order = Window.orderBy("_ratio", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = (
        sizes.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("_level", (total - F.col("_before")) / F.col("_rest"))
    )
    # The first source, in the order of cap/weight, that its level doesn't clamp sets the level of all that follow.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_tie", "_level"))).over(everything)
    return (
        capped.withColumn("_found", level["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_found") * F.col("weight")), F.col("_cap")))
        .drop("_cap", "_ratio", "_before", "_rest", "_level", "_found")
    )


def mix(
    docs: DataFrame,
    size: str | None = None,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    into: str = "mix",
) -> DataFrame:
    """How many words of each document a mix takes. Returns all columns of `docs` (but one named `into`) and, as the
    struct `into`, size, source_size, target and taken. `size` names a column of word counts; without it words are counted in `text`.

    Sources in code-point order, null last, get the weights in turn. A source's target is met by whole repetitions of
    all its documents and one fractional one: documents in the order of a seeded hash until the rest of the target is
    used up, the document at the cut in part (so each source takes its target, rounded to a word). Reruns agree, as
    the order depends on seed, key and size only; rows equal in these share their places in an arbitrary but
    equivalent order.

    A null text or size counts 0; a source without words has target 0; an empty table gives an empty result. Other
    columns of any name pass through.

    Scale: two aggregates with map-side combine (source; source x hash range), joins of the documents with these small
    tables, and one window over a single hash range of each source. No step gathers a source in one task.
    """
    docs = docs.drop(into)
    counted = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else words(text)
    narrow = docs.select(
        F.struct("*").alias("_row"),
        F.col(source).cast("string").alias("_source"),
        counted.cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_hash"),
        F.col(key).alias("_key"),
    )
    sizes = narrow.select("_source", "_size", "_hash")
    # A row per source; written, so that the planner knows its size when it picks the join.
    cuts = materialize(_cuts(sizes if size else materialize(sizes), weights, share, max_epochs))
    out = narrow.withColumn("_bucket", _bucket()).join(cuts, F.col("_source").eqNullSafe(F.col("_cut_source")))
    # Documents before the cut are taken once more, the one at the cut in part: a window over the cut's hash range.
    at_cut = F.col("_bucket") == F.col("_cut_bucket")
    below = out.where(~at_cut).withColumn("_extra", F.when(F.col("_bucket") < F.col("_cut_bucket"), F.col("_size")).otherwise(F.lit(0)))
    run = Window.partitionBy("_cut_source").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = out.where(at_cut).withColumn(
        "_extra",
        F.greatest(F.lit(0), F.least("_size", F.col("_left") - F.coalesce(F.sum("_size").over(run), F.lit(0)))).cast("long"),
    )
    taken = (F.col("_whole") * F.col("_size") + F.col("_extra")).cast("long")
    return below.unionByName(inside).select(
        "_row.*", F.struct(F.col("_size").alias("size"), "source_size", "target", taken.alias("taken")).alias(into)
    )


def words(text: str) -> Column:
    """Number of words of a text (null: 0)."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _bucket() -> Column:
    """Leading 16 bits of the hash."""
    return F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")


def _cuts(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """A row per source: its target, whole repetitions, and the hash range and words at which the last one is cut."""
    by_range = sizes.groupBy("_source", _bucket().alias("_bucket")).agg(F.sum("_size").alias("_words"))
    sources = by_range.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weighted = sources.withColumn("_tie", turn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_tie") % len(weights) + 1).cast("int"))
    )
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    filled = water_fill(weighted.withColumn("_total", total), F.col("_total"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("_whole", whole).withColumn(
        "_rest", (F.round("target") - F.col("_whole") * F.col("source_size")).cast("long")
    )
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = by_range.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    joined = filled.join(
        running.withColumnRenamed("_source", "_range_source"), F.col("_source").eqNullSafe(F.col("_range_source")), "left"
    )
    # The cut lies in the last range that begins before the rest is used up; with no rest, before the first.
    cut = F.max(F.when(F.col("_before") < F.col("_rest"), F.struct("_bucket", "_before")))
    return (
        joined.groupBy("_source", "source_size", "target", "_whole", "_rest")
        .agg(cut.alias("_cut"))
        .select(
            F.col("_source").alias("_cut_source"),
            "source_size",
            "target",
            "_whole",
            F.coalesce("_cut._bucket", F.lit(-1)).alias("_cut_bucket"),
            (F.col("_rest") - F.coalesce("_cut._before", F.lit(0))).alias("_left"),
        )
    )
