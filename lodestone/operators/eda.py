"""Exploratory analyses: missingness, labels, label noise, scaling, outliers, chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, TEXT_HINTS, Thresholds
from lodestone.functions.exprs import MISSING, or_missing

from .stats import column_stats, long_numeric, purity, quantiles, q, summaries


def primary_column(stats: dict[str, int], names: Sequence[str], most: int = 50) -> str | None:
    """The first candidate with at most `most` distinct values, else the first."""
    return next((c for c in names if stats[c] <= most), names[0] if names else None)


def text_columns(df: DataFrame, excluded: Sequence[str] = (), least: float = 40) -> DataFrame:
    """String columns that hold texts, by name or mean length."""
    strings = [c for c, kind in df.dtypes if kind == "string" and c not in excluded]
    one = df.agg(*[F.avg(F.length(F.col(q(c)))).alias(f"a{k}") for k, c in enumerate(strings)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(any(h in c.lower() for h in TEXT_HINTS)).alias("name_hint"), F.col(f"a{k}").alias("avg_length")) for k, c in enumerate(strings)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where(F.col("name_hint") | (F.col("avg_length") >= least))


def missingness(df: DataFrame) -> DataFrame:
    return column_stats(df).select("column_name", "missing_count", "missing_rate")


def co_missingness(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Pairs of columns that tend to be missing together. Work falls on rows with nulls only."""
    nulls = F.filter(F.array(*[F.when(F.col(q(c)).isNull(), F.lit(c)) for c in df.columns]), lambda c: c.isNotNull())
    rows = df.select(nulls.alias("m")).where(F.size("m") > 0).groupBy("m").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    single = rows.select(F.explode("m").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("k"))
    pair = rows.select(F.explode("m").alias("a"), "m", "n").select("a", F.explode("m").alias("b"), "n").where("a <> b")
    order = {c: k for k, c in enumerate(df.columns)}
    place = F.create_map(*[x for c, k in order.items() for x in (F.lit(c), F.lit(k))])
    pair = pair.where(place[F.col("a")] < place[F.col("b")]).groupBy("a", "b").agg(F.sum("n").alias("co"))
    joined = pair.join(single.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a").join(single.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b").crossJoin(F.broadcast(total))
    jaccard = F.col("co") / (F.col("ka") + F.col("kb") - F.col("co"))
    return joined.select(F.col("a").alias("col_a"), F.col("b").alias("col_b"), F.col("co").alias("co_missing_count"), (F.col("co") / F.col("total")).alias("co_missing_rate"), jaccard.alias("jaccard")).where(F.col("jaccard") >= t.co_missing)


def missingness_by_label(df: DataFrame, label: str) -> DataFrame:
    others = [c for c in df.columns if c != label]
    rates = df.groupBy(or_missing(F.col(q(label)), "<MISSING_LABEL>").alias("label")).agg(F.count("*").alias("count"), *[F.avg(F.col(q(c)).isNull().cast("double")).alias(f"r{k}") for k, c in enumerate(others)])
    return rates.select("label", "count", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{k}").alias("missing_rate")) for k, c in enumerate(others)])).alias("r")).select("label", "count", "r.*")


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and shares of labels with the missing one, and the imbalance max/min over the others."""
    counts = df.groupBy(or_missing(F.col(q(label))).alias("label")).agg(F.count("*").alias("count"))
    everything = Window.partitionBy()
    real = F.when(F.col("label") != MISSING, F.col("count"))
    imbalance = F.when(F.count(real).over(everything) >= 2, F.max(real).over(everything) / F.min(real).over(everything))
    return counts.select("label", "count", (F.col("count") / F.sum("count").over(everything)).alias("proportion"), imbalance.alias("imbalance_ratio"))


def rare_classes(df: DataFrame, label: str, t: Thresholds = DEFAULTS) -> DataFrame:
    counts = df.where(F.col(q(label)).isNotNull()).groupBy(F.col(q(label)).cast("string").alias("label")).agg(F.count("*").alias("count"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", share.alias("proportion")).where((F.col("count") < t.rare_count) | (F.col("proportion") < t.rare_proportion))


def conflicting_labels(df: DataFrame, path: str, label: str) -> DataFrame:
    """Paths with more than one label."""
    named = df.where(F.col(q(path)).isNotNull() & F.col(q(label)).isNotNull())
    return named.groupBy(F.col(q(path)).alias("path")).agg(F.count_distinct(F.col(q(label))).alias("label_count"), F.array_join(F.array_sort(F.collect_set(F.col(q(label)).cast("string"))), ",").alias("labels")).where("label_count > 1")


def label_inconsistency(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with several labels, and rows outside their group's dominant one."""
    named = df.where(F.col(q(group)).isNotNull() & F.col(q(label)).isNotNull()).select(F.col(q(group)).alias("_g"), F.col(q(label)).cast("string").alias("_l"))
    per = purity(named, ["_g"], "_l")
    mixed = F.col("labels") > 1
    noise = F.sum(F.when(mixed, F.col("rows") - F.col("dominant_rows")).otherwise(0))
    return per.agg(F.count("*").alias("total_group_count"), F.count_if(mixed).alias("mixed_group_count"), F.avg(mixed.cast("double")).alias("mixed_group_rate"), noise.alias("noise_candidate_count"), (noise / F.sum("rows")).alias("noise_candidate_rate")).select(F.lit(group).alias("group_column"), "*")


def class_outliers(df: DataFrame, label: str, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Cells beyond their class's fences, by column; classes of fewer than noise_min_class values are left out."""
    cells = long_numeric(df.where(F.col(q(label)).isNotNull()), columns, [F.col(q(label)).cast("string").alias("label")]).where("x is not null")
    fences = quantiles(cells, ["column_name", "label"], (0.25, 0.75))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    fences = fences.where((F.col("n") >= t.noise_min_class) & (iqr > 0)).select("column_name", "label", (F.col("_q")[0] - t.mild * iqr).alias("low"), (F.col("_q")[1] + t.mild * iqr).alias("high"))
    joined = cells.join(fences, ["column_name", "label"])
    out = F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")))
    return joined.groupBy("column_name").agg(out.alias("candidate_count"), F.count("*").alias("value_count")).select("column_name", "candidate_count", (F.col("candidate_count") / F.col("value_count")).alias("candidate_rate"))


def numeric_summaries(df: DataFrame, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    return summaries(df, columns, t.eda_coverage)


def feature_scaling(df: DataFrame, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Range, spread and skew of each column, with flags from its neighbours' ranges."""
    one = long_numeric(df, columns).where("x is not null").groupBy("column_name").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.skewness("x").alias("_g1"))
    one = one.withColumn("range", F.col("max") - F.col("min")).where("range > 0")
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") >= 3) & (F.col("std") > 0), F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    everything = Window.partitionBy()
    mid = F.percentile("range", 0.5).over(everything)
    out = one.withColumn("skewness", skew).withColumn("log10_range", F.round(F.log10("range"), 3)).withColumn("_mid", mid)
    normal = (F.col("min") >= 0) & (F.col("max") <= 1)
    many = F.count("*").over(everything) > 1
    flags = {"already_normalized": normal, "high_skew": F.abs("skewness") > t.high_skew, "log_transform_candidate": (F.col("min") >= 0) & ~normal & (F.col("skewness") > t.log_skew), "dominant_scale": many & (F.col("range") >= t.dominant_ratio * F.col("_mid")), "small_scale": many & (F.col("range") <= F.col("_mid") / t.dominant_ratio)}
    spread = F.max("log10_range").over(everything) - F.min("log10_range").over(everything)
    return out.select("column_name", "min", "max", "range", "std", "mean", "skewness", "log10_range", *[c.alias(k) for k, c in flags.items()], (F.max("range").over(everything) / F.min("range").over(everything)).alias("max_range_ratio"), (spread >= t.spread_orders).alias("mixed_scale_detected"))


def fences(df: DataFrame, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Quartiles, median, spread of deviations and mild and extreme fences of columns fit for outlier tests."""
    cells = long_numeric(df, columns).where("x is not null")
    quart = quantiles(cells, ["column_name"], (0.25, 0.5, 0.75)).select("column_name", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("med"), F.col("_q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fit = (F.col("n") >= t.outlier_min_samples) & (iqr > 0) & (iqr / F.greatest(F.abs("q1"), F.abs("q3"), F.lit(1e-9)) >= t.near_constant)
    quart = quart.withColumn("iqr", iqr).where(fit)
    apart = cells.join(F.broadcast(quart.select("column_name", "med")), "column_name").select("column_name", F.abs(F.col("x") - F.col("med")).alias("x"))
    mad = quantiles(apart, ["column_name"], (0.5,)).select("column_name", F.col("_q")[0].alias("mad"))
    bounds = {f"{side}_{name}": (F.col("q1") - k * F.col("iqr")) if side == "low" else (F.col("q3") + k * F.col("iqr")) for name, k in (("mild", t.mild), ("extreme", t.extreme)) for side in ("low", "high")}
    return quart.join(F.broadcast(mad), "column_name").select("*", *[c.alias(k) for k, c in bounds.items()])


def _marked(df: DataFrame, columns: Sequence[str], keep: Sequence, t: Thresholds) -> DataFrame:
    """Cells with their fences; a row per column, so the fences are broadcast by a bound on columns."""
    cells = long_numeric(df, columns, keep).where("x is not null").join(F.broadcast(fences(df, columns, t)), "column_name")
    z = F.abs(0.6745 * (F.col("x") - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0)))
    beyond = F.greatest(F.col("low_mild") - F.col("x"), F.col("x") - F.col("high_mild"), F.lit(0.0))
    return cells.select("*", F.coalesce(z > t.mad_z, F.lit(False)).alias("is_mad"), beyond.alias("distance"), ((F.col("x") < F.col("low_mild")) | (F.col("x") > F.col("high_mild"))).alias("is_mild"), ((F.col("x") < F.col("low_extreme")) | (F.col("x") > F.col("high_extreme"))).alias("is_extreme"))


def outliers(df: DataFrame, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    marked = _marked(df, columns, [], t)
    one = marked.groupBy("column_name", "low_mild", "high_mild", "low_extreme", "high_extreme", "iqr").agg(F.count_if("is_mild").alias("iqr_mild_count"), F.count_if("is_extreme").alias("iqr_extreme_count"), F.count_if(F.col("x") < F.col("low_mild")).alias("count_low"), F.count_if(F.col("x") > F.col("high_mild")).alias("count_high"), F.count_if("is_mad").alias("mad_count"), F.max("distance").alias("_worst"))
    return one.crossJoin(F.broadcast(total)).select("column_name", "iqr_mild_count", "iqr_extreme_count", "count_low", "count_high", "mad_count", (F.col("iqr_mild_count") / F.col("total")).alias("outlier_rate"), F.round(F.col("_worst") / F.col("iqr"), 2).alias("severity_iqr_multiples"), "low_mild", "high_mild", "low_extreme", "high_extreme")


def outlier_examples(df: DataFrame, columns: Sequence[str], row_id: str, top: int = 5, t: Thresholds = DEFAULTS) -> DataFrame:
    marked = _marked(df, columns, [F.col(q(row_id)).alias("row_id")], t).where("is_mild or is_mad")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("distance"), "row_id")).cast("long")
    return marked.select("column_name", "row_id", "x", "distance", rank.alias("rank")).where(F.col("rank") <= top)


def grouped_label_distribution(df: DataFrame, group: str, label: str) -> DataFrame:
    counts = df.groupBy(or_missing(F.col(q(group)), "<MISSING_GROUP>").alias("group"), or_missing(F.col(q(label)), "<MISSING_LABEL>").alias("label")).agg(F.count("*").alias("count"))
    return counts.select("group", "label", "count", (F.col("count") / F.sum("count").over(Window.partitionBy("group"))).alias("proportion"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts in equal-width bins; constant columns have none."""
    cells = long_numeric(df, columns).where("x is not null")
    ends = cells.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    return cells.join(F.broadcast(ends), "column_name").groupBy("column_name", bin_.alias("bin")).agg(F.count("*").alias("count"))


def sample_rows(df: DataFrame, row_id: str, rows: int, seed: int = 42) -> DataFrame:
    """A sample that reruns repeat: the rows with the smallest seeded hashes."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(q(row_id)).cast("string"))), row_id).limit(rows)
