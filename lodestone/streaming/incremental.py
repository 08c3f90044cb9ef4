"""Extension: a label distribution kept up to date over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import or_missing
from lodestone.operators.stats import q


def label_counts(stream: DataFrame, label: str, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by label, and by window of time where a time column is given (rows later than `late` are dropped)."""
    name = or_missing(F.col(q(label))).alias("label")
    if time is None:
        return stream.groupBy(name).agg(F.count("*").alias("count"))
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("window"), name).agg(F.count("*").alias("count"))
