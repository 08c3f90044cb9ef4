"""Plans that several checks share: long forms, summaries, fences, purity and overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.exprs import finite, to_number


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def basic_dtype(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def number(df: DataFrame, column: str):
    """A column as double: numeric ones cast, strings parsed, others null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return finite(F.col(q(column)).cast("double"))
    if isinstance(kind, T.StringType):
        return to_number(F.col(q(column)))
    return F.lit(None).cast("double")


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence = ()) -> DataFrame:
    """A row per cell: kept columns, column_name, x."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), number(df, c).alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*_names(df, keep), "_p.column_name", "_p.x")


def long_strings(df: DataFrame, columns: Sequence[str], keep: Sequence = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(q(c)).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*_names(df, keep), "_p.column_name", "_p.value")


def _names(df: DataFrame, keep: Sequence) -> list[str]:
    return df.select(*keep).columns if keep else []


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null and missing counts and distinct values of all columns in one aggregate: a row per column."""
    columns = list(columns or df.columns)
    counts = []
    for k, c in enumerate(columns):
        value = finite(F.col(q(c))) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(q(c))
        if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):
            value = F.to_json(value)
        counts += [F.count(value).alias(f"n{k}"), F.count_distinct(value).alias(f"u{k}")]
    one = df.agg(F.count("*").alias("total"), *counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(basic_dtype(df.schema[c].dataType)).alias("basic_dtype"), F.col(f"n{k}").alias("non_null_count"), F.col(f"u{k}").alias("unique_count")) for k, c in enumerate(columns)])
    out = one.select("total", F.explode(rows).alias("r")).select("r.*", "total")
    missing = F.col("total") - F.col("non_null_count")
    return out.select("column_name", "basic_dtype", "non_null_count", missing.alias("missing_count"), F.coalesce(F.try_divide(missing.cast("double"), F.col("total")), F.lit(0.0)).alias("missing_rate"), "unique_count", "total")


#: Ranks of an approximate percentile lie within this share of the exact one; groups of SMALL values are kept whole.
SHARE, SMALL = 1 / 2000, 20000


def quantiles(cells: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact percentiles (between two values in proportion) of the column x per group, and its values: by, n, _q.

    A first pass finds bounds around each percentile by a sketch of bounded size. A second one counts the values between
    bounds one by one, and all between two such ranges as one; so a small share of the distinct values of a group meets
    in one task. A percentile that isn't between its bounds is an error, never a near value."""
    cells = cells.where("x is not null").select(*by, "x")
    around = [F.lit(min(1.0, max(0.0, p + side * 4 * SHARE))) for p in points for side in (-1, 1)]
    bounds = cells.groupBy(*by).agg(F.count("x").alias("_n"), F.percentile_approx("x", F.array(*around), int(1 / SHARE)).alias("_b"))
    low, high = ([F.col("_b")[2 * k + side] for k in range(len(points))] for side in (0, 1))
    within = F.col("_n") <= SMALL
    for a, b in zip(low, high, strict=True):
        within = within | F.col("x").between(a, b)
    below = F.coalesce(F.greatest(*[F.when(F.col("x") > b, b) for b in high], F.lit(None)), F.lit(float("-inf")))
    few = F.broadcast(bounds) if list(by) == ["column_name"] else bounds
    found = cells.join(few, list(by)).select(*by, "_n", within.alias("_own"), F.when(within, F.col("x")).otherwise(below).alias("x"))
    counts = found.groupBy(*by, "_n", "_own", "x").agg(F.count("*").alias("_c"))
    ordered = Window.partitionBy(*by).orderBy("x", F.desc("_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_end", F.sum("_c").over(ordered))
    value = F.when(F.col("_own"), F.col("x")).otherwise(F.raise_error(F.lit("a percentile is not between its bounds")).cast("double"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), value))

    places = [(F.col("_n") - 1) * F.lit(float(p)) for p in points]
    ends = [at(side(p).cast("long")) for p in places for side in (F.floor, F.ceil)]
    one = ranked.groupBy(*by, F.col("_n").alias("n")).agg(*[e.alias(f"_{k}") for k, e in enumerate(ends)])
    own = [(F.col("n") - 1) * F.lit(float(p)) for p in points]
    values = [
        F.when(F.col(f"_{2 * k}") == F.col(f"_{2 * k + 1}"), F.col(f"_{2 * k}")).otherwise((F.ceil(p) - p) * F.col(f"_{2 * k}") + (p - F.floor(p)) * F.col(f"_{2 * k + 1}"))
        for k, p in enumerate(own)
    ]
    return one.select(*by, "n", F.array(*values).alias("_q"))


def summaries(df: DataFrame, columns: Sequence[str], coverage: float) -> DataFrame:
    """Count, mean, std, quartiles of the columns that read as numbers in a share of `coverage` of all rows."""
    long_ = long_numeric(df, columns)
    out = long_.groupBy("column_name").agg(F.count("*").alias("_rows"), F.count("x").alias("count"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.where((F.col("count") > 0) & (F.col("count") >= coverage * F.col("_rows"))).join(F.broadcast(quantiles(long_, ["column_name"], (0.25, 0.5, 0.75))), "column_name")
    return out.select("column_name", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "max")


def purity(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per key: rows, rows of its dominant label (least of equals) and that label."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), label)))
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.max("_n").alias("dominant_rows"), F.count("*").alias("labels"), F.max(F.when(F.col("_rank") == 1, F.col(label))).alias("dominant_label"))


def entity_overlap(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities, those in more than one split, and their share."""
    per = df.where(F.col(q(entity)).isNotNull() & F.col(q(split)).isNotNull()).groupBy(F.col(q(entity)).alias("_e")).agg(F.count_distinct(F.col(q(split))).alias("_n"))
    return per.agg(F.count("*").alias("entity_count"), F.count_if(F.col("_n") > 1).alias("overlapping_entities"), F.avg((F.col("_n") > 1).cast("double")).alias("overlap_rate")).select(F.lit(entity).alias("entity_column"), F.lit(split).alias("split_column"), "entity_count", "overlapping_entities", "overlap_rate")
