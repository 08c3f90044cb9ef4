"""Connected components of links between longs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(both: DataFrame, small: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them: its larger ones (large star), or its smaller and itself."""
    kept = both.where("b < a") if small else both
    least = kept.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "_a")
    joined = kept.where("b < a" if small else "b > a").join(least, F.col("a") == F.col("_a"))
    links = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        links = links.unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return links.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Nodes of `links` (columns a, b: long) with the least node that links reach: node, root.

    Each step replaces links by links to lesser nodes, never adds any, and groups with map-side combine; the number of
    steps grows with the logarithm of a component's diameter. Links and components stay in tables; the driver sees a
    count and a checksum. Self-links and repeated links are harmless; no links give no rows.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_star(both, small=False))
        edges = materialize(_star(large, small=True))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())
        if now == seen:
            break
        seen = now
    # Now every link leads from a node to its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
