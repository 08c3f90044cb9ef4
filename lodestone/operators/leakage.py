"""Leakage and evaluation-risk checks. Each returns a DataFrame of findings with a severity where one is defined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Thresholds
from lodestone.functions.exprs import or_missing, path_tokens, risk_level, season, split_rank

from .profile import duplicate_summary
from .stats import column_stats, entity_overlap, is_numeric, long_numeric, long_strings, purity, q


def duplicates(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 3.0) -> DataFrame:
    out = duplicate_summary(df, columns)
    return out.select("row_count", "duplicate_rows", "duplicate_rate", F.round(F.least(F.lit(1.0), F.col("duplicate_rate") * factor), 3).alias("severity_score"), risk_level(F.least(F.lit(1.0), F.col("duplicate_rate") * factor)).alias("risk_level"))


def split_overlap(df: DataFrame, entity: str, split: str, factor: float = 2.5) -> DataFrame:
    severity = F.least(F.lit(1.0), F.coalesce(F.col("overlap_rate"), F.lit(0.0)) * factor)
    return entity_overlap(df, entity, split).select("*", F.round(severity, 3).alias("severity_score"), risk_level(severity).alias("risk_level"))


def label_by_split(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(or_missing(F.col(q(split))).alias("split"), or_missing(F.col(q(label))).alias("label")).agg(F.count("*").alias("count"))


def path_label_shortcuts(df: DataFrame, path: str, label: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Path tokens that give the label away: by purity, or by standing in a label's name."""
    rows = df.where(F.col(q(path)).isNotNull()).select(F.array_distinct(path_tokens(F.col(q(path)))).alias("_t"), or_missing(F.col(q(label))).alias("_l"))
    per = purity(rows.select(F.explode("_t").alias("token"), "_l").where("token <> ''"), ["token"], "_l").where(F.col("rows") >= t.token_min_count)
    clean = F.regexp_replace(F.lower("_l"), "[^a-z0-9]+", "")
    names = rows.select(clean.alias("_n")).where("_n <> ''").distinct().agg(F.collect_set("_n").alias("_names"))
    token = F.regexp_replace("token", "[^a-z0-9]+", "")
    matched = per.crossJoin(F.broadcast(names)).withColumn("matched_label", (token != "") & F.exists("_names", lambda n: n.contains(token)))
    share = F.col("dominant_rows") / F.col("rows")
    risk = F.least(F.lit(1.0), share + F.when(F.col("matched_label"), t.token_bonus).otherwise(0.0))
    return matched.select("token", F.col("rows").alias("count"), F.col("dominant_label"), share.alias("purity"), "matched_label", risk.alias("risk")).where((F.col("purity") >= t.token_purity) | F.col("matched_label"))


def categorical_proxies(df: DataFrame, columns: Sequence[str], label: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Columns whose values predict the label: share of rows that the dominant label of their value gets right."""
    stats = {r.column_name: r.unique_count for r in column_stats(df, columns).collect()}
    fit = [c for c in columns if stats[c] > 1 and (not is_numeric(df, c) or stats[c] <= t.proxy_unique)]
    if not fit:
        return df.sparkSession.createDataFrame([], "column_name string, unique_count long, purity double, risk_level string")
    cells = long_strings(df.where(F.col(q(label)).isNotNull()), fit, [F.col(q(label)).cast("string").alias("_l")]).withColumn("value", or_missing(F.col("value")))
    return _proxy(purity(cells, ["column_name", "value"], "_l"), t.proxy_purity)


def _proxy(per: DataFrame, least: float) -> DataFrame:
    out = per.groupBy("column_name").agg(F.count("*").alias("unique_count"), (F.sum("dominant_rows") / F.sum("rows")).alias("purity"))
    return out.where(F.col("purity") >= least).select("*", risk_level(F.col("purity")).alias("risk_level"))


def deciles(df: DataFrame, columns: Sequence[str], row_id: str, keep: Sequence = (), t: Thresholds = DEFAULTS) -> DataFrame:
    """Decile of each value by its rank (ties by row_id); ranks are per column, so columns run side by side."""
    cells = long_numeric(df, columns, [*keep, F.col(q(row_id)).alias("_id")])
    by = Window.partitionBy("column_name")
    rank = F.row_number().over(by.orderBy(F.col("x").asc_nulls_last(), "_id"))
    count = F.count("x").over(by)
    bucket = F.greatest(F.lit(1), F.floor(((rank - 1) * t.deciles + count - 2) / F.greatest(count - 1, F.lit(1)))).cast("long")
    return cells.withColumn("bucket", F.when(F.col("x").isNotNull(), bucket).otherwise(0))


def numeric_proxies(df: DataFrame, columns: Sequence[str], label: str, row_id: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Numeric columns of more than proxy_unique values whose deciles predict the label."""
    stats = {r.column_name: r for r in column_stats(df, columns).collect()}
    fit = [c for c in columns if stats[c].unique_count > t.proxy_unique and stats[c].non_null_count >= t.eda_coverage * stats[c].total]
    if not fit:
        return df.sparkSession.createDataFrame([], "column_name string, unique_count long, purity double, risk_level string")
    cells = deciles(df.where(F.col(q(label)).isNotNull()), fit, row_id, [F.col(q(label)).cast("string").alias("_l")], t)
    return _proxy(purity(cells, ["column_name", "bucket"], "_l"), t.numeric_proxy_purity)


def interval_overlap(df: DataFrame, split: str, start: str, end: str, factor: float = 1.5) -> DataFrame:
    """Overlap of the splits' ranges, relative to their union, for each pair of splits."""
    named = df.where(F.col(q(split)).isNotNull())
    span = named.groupBy(F.col(q(split)).cast("string").alias("s")).agg(F.min(_number(df, start)).alias("lo"), F.max(_number(df, end)).alias("hi")).where("lo is not null and hi is not null")
    a, b = span.alias("a"), span.alias("b")
    inner = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    union = F.greatest("a.hi", "b.hi") - F.least("a.lo", "b.lo")
    joined = a.join(b, (F.col("a.s") < F.col("b.s")) & (inner > 0))
    ratio = F.try_divide(inner, union)
    return joined.select(F.col("a.s").alias("split_a"), F.col("b.s").alias("split_b"), inner.alias("overlap"), ratio.alias("overlap_ratio"), F.round(F.least(F.lit(1.0), ratio * factor), 3).alias("severity_score"))


def _number(df: DataFrame, column: str):
    c = F.col(q(column))
    kind = df.schema[column].dataType.simpleString()
    return (F.unix_micros(c.cast("timestamp")) / 1e6 if kind.startswith("timestamp") or kind == "date" else c).cast("double")


def normalization_leak(df: DataFrame, columns: Sequence[str], split: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Columns that look normalised over all rows although the splits differ."""
    cells = long_numeric(df, columns, [F.col(q(split)).alias("_s")]).where("x is not null")
    one = cells.groupBy("column_name").agg(F.count("*").alias("n"), F.count_distinct("x").alias("u"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    one = one.where((F.col("n") >= 20) & (F.col("u") > 10) & (F.abs("mean") < t.norm_tolerance) & (F.abs(F.col("std") - 1) < t.norm_tolerance))
    drift = cells.where("_s is not null").groupBy("column_name", "_s").agg(F.avg("x").alias("m")).groupBy("column_name").agg(F.max(F.abs("m")).alias("max_split_mean"), F.count("*").alias("splits"))
    return one.join(drift.where("splits >= 2"), "column_name").where(F.col("max_split_mean") >= t.split_drift).select("column_name", F.col("mean").alias("global_mean"), F.col("std").alias("global_std"), "max_split_mean")


def split_interleaving(df: DataFrame, time: str, split: str, row_id: str, ranges: int = 64, severity: float = 0.8) -> DataFrame:
    """Runs of splits in the order of time, against the number of splits.

    Rows are dealt into ranges of time, runs counted within each, and the ranges' first and last splits compared in a
    window over the ranges alone, so no task orders all rows.
    """
    rows = df.where(F.col(q(time)).isNotNull() & F.col(q(split)).isNotNull()).select(_number(df, time).alias("t"), F.col(q(split)).cast("string").alias("s"), F.col(q(row_id)).alias("i"))
    marks = rows.agg(F.percentile_approx("t", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10000).alias("b")).head()["b"] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(marks))]).cast("array<double>")
    dealt = rows.withColumn("r", F.size(F.filter(edges, lambda b: b <= F.col("t"))))
    order = Window.partitionBy("r").orderBy("t", "i")
    change = (F.lag("s").over(order) != F.col("s")).cast("long")
    per = dealt.select("r", "t", "i", "s", change.alias("c")).groupBy("r").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("n"), F.min_by("s", F.struct("t", "i")).alias("first"), F.max_by("s", F.struct("t", "i")).alias("last"), F.collect_set("s").alias("ss"))
    seam = (F.lag("last").over(Window.orderBy("r")) != F.col("first")).cast("long")
    out = per.select("*", F.coalesce(seam, F.lit(0)).alias("x")).agg(F.sum("n").alias("row_count"), (F.sum(F.col("c") + F.col("x")) + 1).alias("run_count"), F.size(F.array_distinct(F.flatten(F.collect_list("ss")))).cast("long").alias("split_count"))
    found = F.col("run_count") > F.col("split_count")
    return out.where("row_count >= 10 and split_count >= 2").select("*", found.alias("interleaved"), F.when(found, severity).otherwise(0.0).alias("severity_score"))


def boundary_gaps(df: DataFrame, time: str, split: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Gap between each split and the next in time, in the median steps within splits."""
    rows = df.where(F.col(q(time)).isNotNull() & F.col(q(split)).isNotNull()).select(_number(df, time).alias("t"), F.col(q(split)).cast("string").alias("s"))
    steps = rows.distinct().withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("s").orderBy("t"))).where("d > 0")
    mid = steps.agg(F.percentile("d", 0.5).alias("step"))
    ends = rows.groupBy("s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    order = Window.orderBy(split_rank(F.col("s")), "lo", "s")
    pairs = ends.select("*", F.lead("s").over(order).alias("n"), F.lead("lo").over(order).alias("nlo")).where("n is not null").crossJoin(F.broadcast(mid))
    gap = F.col("nlo") - F.col("hi")
    size = F.try_divide(gap, F.col("step"))
    score = F.when(F.col("step").isNull(), F.when(gap <= 0, 0.7).otherwise(0.0)).when(size < t.gap_steps, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - size))).otherwise(0.0)
    return pairs.select(F.col("s").alias("split_a"), F.col("n").alias("split_b"), gap.alias("gap"), size.alias("gap_steps"), F.round(score, 3).alias("severity_score"))


def seasonal_shift(df: DataFrame, date: str, split: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of each split's seasons from the first split's. Rows without date or split drop."""
    rows = df.select(F.col(q(split)).cast("string").alias("s"), season(F.col(q(date))).alias("e")).where("s is not null and e is not null")
    counts = rows.groupBy("s", "e").agg(F.count("*").alias("n"))
    grid = counts.select("s").distinct().crossJoin(df.sparkSession.createDataFrame([(x,) for x in ("winter", "spring", "summer", "autumn")], "e string"))
    share = grid.join(counts, ["s", "e"], "left").select("s", "e", (F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("s"))).alias("p"))
    first = share.select("s").distinct().orderBy(split_rank(F.col("s")), "s").limit(1).withColumnRenamed("s", "_f")
    base = share.join(F.broadcast(first), F.col("s") == F.col("_f")).select("e", F.col("p").alias("q"), F.col("s").alias("reference_split"))
    both = share.join(F.broadcast(base), "e").where("s <> reference_split")
    m = (F.col("p") + F.col("q")) / 2
    term = F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / m)).otherwise(0.0) + F.when(F.col("q") > 0, F.col("q") * F.ln(F.col("q") / m)).otherwise(0.0)
    js = both.groupBy("reference_split", F.col("s").alias("split")).agg((F.sum(term) / 2 / F.ln(F.lit(2.0))).alias("js_divergence"), F.max_by("e", F.struct("p", "e")).alias("dominant_season"))
    return js.select("*", (F.col("js_divergence") >= t.seasonal_js).alias("shifted"))


def missing_group_keys(df: DataFrame, columns: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    return column_stats(df, columns).where(F.col("missing_rate") >= t.missing_group).select("column_name", "missing_count", "missing_rate", risk_level(F.col("missing_rate")).alias("risk_level"))


def overall_risk(scores: DataFrame, score: str = "severity_score") -> DataFrame:
    top, mean = F.coalesce(F.max(score), F.lit(0.0)), F.avg(score)
    value = F.when(top == 0, top).otherwise(F.greatest(top, F.least(mean + 0.1, F.lit(1.0))))
    return scores.agg(value.alias("overall_severity_score")).select("*", risk_level(F.col("overall_severity_score")).alias("overall_risk_level"))


def build_report(df: DataFrame, path: str | None = None, label: str | None = None, split: str | None = None, entities: Sequence[str] = (), time: str | None = None, date: str | None = None, row_id: str | None = None, t: Thresholds = DEFAULTS, sequences: Sequence[str] = ()) -> dict:
    """All checks in a fixed order as a JSON tree; those without their columns are not assessable and score 0.

    A check's severity is the largest over all its findings; the 100 riskiest are listed."""
    checks: list[dict] = []

    def add(kind: str, *found: DataFrame | None, score: str = "severity_score") -> None:
        parts = [f for f in found if f is not None]
        tops = [f.agg(F.max(F.col(score).cast("double"))).head()[0] for f in parts]
        value = max((x for x in tops if x is not None), default=0.0)
        # Ties go by all columns, so that runs list the same findings.
        details = [r.asDict() for f in parts for r in f.orderBy(F.col(score).desc_nulls_last(), *[F.col(q(c)) for c in f.columns]).limit(100).collect()]
        details = sorted(details, key=lambda d: -(d[score] or 0))[:100]
        level = "high" if value >= t.risk_high else "medium" if value >= t.risk_medium else "low"
        checks.append({"risk_type": kind, "severity_score": round(value, 3), "risk_level": level, "details": details, "notes": [] if parts else ["not assessable"]})

    add("duplicates", duplicates(df))
    add("split_entity_overlap", *[split_overlap(df, e, split) for e in entities if split])
    add("path_label_shortcuts", path_label_shortcuts(df, path, label, t) if path and label else None, score="risk")
    others = [c for c in df.columns if c not in {path, label, split, row_id, *entities}]
    numbers = [c for c in others if is_numeric(df, c)]
    proxies = [categorical_proxies(df, others, label, t)] if label and others else []
    if label and numbers:
        # Without a row_id ties go by a hash of the row: rows that it can't tell apart have equal labels.
        hashed = F.xxhash64(*[F.to_json(F.struct(q(c))) for c in df.columns])
        proxies.append(numeric_proxies(df if row_id else df.withColumn("_row", hashed), numbers, label, row_id or "_row", t))
    add("proxy_features", *proxies, score="purity")
    shared = [split_overlap(df, c, split, 1.5) for c in sequences if split]
    add("temporal_overlap", interval_overlap(df, split, time, time) if split and time else None, *shared)
    add("missing_group_keys", missing_group_keys(df, list(entities), t) if entities else None, score="missing_rate")
    add("ts_normalization_leakage", normalization_leak(df, numbers, split, t) if split and numbers else None, score="max_split_mean")
    order = [split_interleaving(df if row_id else df.withColumn("_row", F.col(q(split)).cast("string")), time, split, row_id or "_row"), boundary_gaps(df, time, split, t)] if split and time else []
    add("ts_window_boundary_leakage", *order)
    add("ts_seasonal_distribution_shift", seasonal_shift(df, date, split, t) if split and date else None, score="js_divergence")
    scores = [c["severity_score"] for c in checks]
    top, mean = max(scores), sum(scores) / len(scores)
    overall = 0.0 if top == 0 else max(top, min(mean + 0.1, 1.0))
    return {"checks": checks, "summary": {"overall_severity_score": round(overall, 3), "overall_risk_level": "high" if overall >= t.risk_high else "medium" if overall >= t.risk_medium else "low", "scores_by_check": {c["risk_type"]: c["severity_score"] for c in checks}}}
