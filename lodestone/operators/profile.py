"""Profiling: columns, roles, paths, hierarchies, schema flags, modality, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import exprs as X

from .stats import column_stats, long_strings, numeric_columns, q, summaries

ROLES = ("identifier", "path/reference", "label/target", "grouping variable", "temporal field", "numeric measurement", "categorical metadata", "derived feature", "unknown")
# What a hint in a column's name is worth to its role.
_HINTS = (("path/reference", C.PATH_HINTS, 0.7), ("label/target", C.LABEL_HINTS, 0.7), ("grouping variable", C.GROUP_HINTS, 0.7), ("temporal field", C.TEMPORAL_HINTS, 0.6), ("identifier", C.ID_HINTS, 0.6))


def name_hints(names: DataFrame, column: str = "column_name") -> DataFrame:
    """Scores that a column's name gives to roles: a hint fires on the whole name or on one of its parts."""
    n = X.normalize_name(F.col(column))
    fired = [F.when(F.arrays_overlap(F.array_append(F.split(n, "_"), n), F.array(*map(F.lit, hints))), F.lit(score)).otherwise(0.0).alias(role.split("/")[0].split(" ")[0] + "_score") for role, hints, score in _HINTS]
    return names.select(column, n.alias("normalized_name"), *fired)


def _path_like(c: F.Column) -> F.Column:
    suffixes = "|".join(x[1:] for x in C.FILE_SUFFIXES)
    return c.startswith("~") | F.contains(c, F.lit("/")) | F.contains(c, F.lit("\\")) | F.lower(c).rlike(rf"\.({suffixes})$")


def score_roles(df: DataFrame, stats: list | None = None, order: str | None = None, t: C.Thresholds = C.DEFAULTS) -> list[dict]:
    """Role and confidence of each column, from one aggregate over all columns."""
    stats = stats or column_stats(df).collect()
    strings = [r.column_name for r in stats if r.basic_dtype == "string"]
    numbers, paths = {}, {}
    if strings:
        cells = [F.col(q(c)).cast("string") for c in strings]
        one = df.agg(*[F.count(X.to_number(c)).alias(f"n{k}") for k, c in enumerate(cells)], *[F.count_if(_path_like(c)).alias(f"p{k}") for k, c in enumerate(cells)]).head()
        numbers, paths = dict(zip(strings, one[: len(strings)], strict=True)), dict(zip(strings, one[len(strings) :], strict=True))
    out = []
    for r in stats:
        name = "_".join(p for p in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in r.column_name.strip().lower()).split())
        parts, score, why = {name, *name.split("_")}, dict.fromkeys(ROLES, 0.0), []

        def add(role: str, points: float, reason: str, score=score, why=why) -> None:
            score[role] += points
            why.append(reason)

        # The points and bounds below decide roles.
        score["unknown"] = 0.1
        for role, hints, points in _HINTS:
            if parts & set(hints):
                add(role, points, f"name suggests {role}")
        if r.basic_dtype == "numeric":
            add("numeric measurement", 0.5, "numeric type")
        elif r.basic_dtype == "datetime":
            add("temporal field", 0.5, "date or time type")
        elif r.unique_count <= 20:
            add("categorical metadata", 0.4, "few distinct values")
        elif r.total and r.unique_count / r.total > 0.8:
            add("identifier", 0.3, "mostly distinct values")
        if r.basic_dtype == "string":
            if r.non_null_count and paths[r.column_name] >= 0.5 * r.non_null_count:
                add("path/reference", 0.8, "values look like paths")
            if r.total and numbers[r.column_name] / r.total > 0.95:
                add("numeric measurement", 0.4, "values read as numbers")
            if name.endswith(("_mean", "_std", "_min", "_max", "_score", "_ratio")):
                add("derived feature", 0.6, "name of a derived measure")
        role = max(ROLES, key=lambda k: score[k])  # the first of equals
        out.append({"column_name": r.column_name, "role": role, "confidence": min(score[role], 1.0), "reasons": why[:6]})
    return out


def roles(df: DataFrame, **options) -> DataFrame:
    return df.sparkSession.createDataFrame(score_roles(df, **options), "column_name string, role string, confidence double, reasons array<string>")


def candidates(scored: list[dict]) -> dict[str, list[str]]:
    """Candidate columns by role."""
    short = {"path/reference": "path", "label/target": "label", "grouping variable": "grouping", "temporal field": "temporal", "identifier": "identifier"}
    return {v: [r["column_name"] for r in scored if r["role"] == k] for k, v in short.items()}


def categorical_summary(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent values of each column, ties by value."""
    counts = long_strings(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "value")).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def path_profile(df: DataFrame, path: str, top: int = 20) -> DataFrame:
    """Suffixes of a path column with counts, beside its non-null and duplicate counts."""
    p = F.col(q(path))
    one = df.agg(F.count(p).alias("non_null_count"), (F.count(p) - F.count_distinct(p)).alias("duplicate_count"))
    kinds = df.where(p.isNotNull()).groupBy(F.coalesce(X.extension(p), F.lit("<none>")).alias("extension")).agg(F.count("*").alias("count"))
    return kinds.orderBy(F.desc("count"), "extension").limit(top).crossJoin(F.broadcast(one))


def segment_pattern(df: DataFrame, path: str, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Whether stems read <prefix>_<number> with prefixes that recur: one row if at least half do and two prefixes recur."""
    prefix = X.segment_prefix(F.col(q(path)))
    counts = df.where(F.col(q(path)).isNotNull()).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    named = F.when(F.col("prefix").isNotNull(), F.col("n"))
    best = F.max(F.when(F.col("prefix").isNotNull(), F.col("n")))
    out = counts.agg(F.sum("n").alias("_all"), F.coalesce(F.sum(named), F.lit(0)).alias("_hit"), F.count("prefix").alias("unique_prefixes"), F.count_if((F.col("n") > 1) & F.col("prefix").isNotNull()).alias("repeated_prefixes"), best.alias("most_common_count"))
    return out.withColumn("match_rate", F.try_divide(F.col("_hit").cast("double"), F.col("_all"))).where("match_rate >= 0.5 and repeated_prefixes >= 2").select("match_rate", "unique_prefixes", "repeated_prefixes", "most_common_count")


def nesting_purity(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Share of child values with a single parent; 0 below ten distinct pairs' rows."""
    pairs = df.where(F.col(q(child)).isNotNull() & F.col(q(parent)).isNotNull())
    per = pairs.groupBy(F.col(q(child)).alias("_c")).agg(F.count_distinct(F.col(q(parent))).alias("_p"), F.count("*").alias("_n"))
    value = F.when(F.sum("_n") >= 10, F.avg((F.col("_p") == 1).cast("double"))).otherwise(0.0)
    return per.agg(F.coalesce(value, F.lit(0.0)).alias("nesting_purity")).select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), "nesting_purity")


def hierarchy(df: DataFrame, columns: Sequence[str], t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Pairs parent, child among columns, by distinct counts and purity."""
    stats = {r.column_name: r for r in column_stats(df, columns).collect()}
    fit = [c for c in columns if 2 <= stats[c].unique_count <= 0.9 * stats[c].total]
    out = None
    for k, a in enumerate(fit):
        for b in fit[k + 1 :]:
            ua, ub = stats[a].unique_count, stats[b].unique_count
            if ua == ub:
                continue
            parent, child = (a, b) if ua < ub else (b, a)
            few, many = min(ua, ub), max(ua, ub)
            row = nesting_purity(df, child, parent).select("parent", "child", F.lit(few).cast("long").alias("parent_unique_count"), F.lit(many).cast("long").alias("child_unique_count"), F.lit(many / few).alias("avg_children_per_parent"), "nesting_purity")
            out = row if out is None else out.unionByName(row)
    empty = df.sparkSession.createDataFrame([], "parent string, child string, parent_unique_count long, child_unique_count long, avg_children_per_parent double, nesting_purity double")
    return (out or empty).where(F.col("nesting_purity") >= t.nesting)


def hierarchy_chain(pairs: DataFrame) -> DataFrame:
    """Longest chain from a root to a leaf in the (few) nesting pairs."""
    edges: dict[str, list[str]] = {}
    for r in pairs.collect():
        edges.setdefault(r.parent, []).append(r.child)

    def longest(node: str, seen: tuple[str, ...]) -> tuple[str, ...]:
        tails = [longest(c, (*seen, c)) for c in sorted(edges.get(node, ())) if c not in seen]
        return max(tails, key=lambda x: (len(x), [*map(str, x)]), default=seen)

    chains = [longest(r, (r,)) for r in sorted(edges)]
    best = max(chains, key=len, default=())
    return pairs.sparkSession.createDataFrame([(list(best), len(best))], "chain array<string>, depth int")


def directory_hierarchy(df: DataFrame, path: str) -> DataFrame:
    """Distinct directory names at each depth of a path column."""
    parts = F.split(F.regexp_replace(F.col(q(path)), "^/+", ""), "/")
    levels = df.select(F.posexplode(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("depth", "part")).where("part <> ''")
    return levels.groupBy((F.col("depth") + 1).cast("long").alias("depth")).agg(F.count_distinct("part").alias("unique_directories"), F.count("*").alias("count"))


def schema_flags(df: DataFrame, scored: list[dict] | None = None, t: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Columns whose type, contents or role are inconsistent: column_name, issue, severity."""
    stats = column_stats(df).collect()
    by_name = {r["column_name"]: r for r in scored or score_roles(df, stats, t=t)}
    checked = [c for c, kind in df.dtypes if kind == "string"]
    one, out = {}, []
    if checked:
        row = df.agg(*[F.count(X.to_number(F.col(q(c)))).alias(f"n{k}") for k, c in enumerate(checked)]).head()
        one = dict(zip(checked, row, strict=True))
    for r in stats:
        c = r.column_name
        if r.total and one.get(c, 0) / r.total > 0.95:
            out.append((c, "numeric_stored_as_string", "medium"))
        if by_name[c]["role"] == "path/reference":
            kinds = [x["count"] for x in path_profile(df, c).where("extension <> '<none>'").collect()]
            if len(kinds) > 1 and max(kinds) / sum(kinds) < t.dominant_extension:
                out.append((c, "mixed_file_extensions", "medium"))
        if by_name[c]["confidence"] < t.ambiguous_role:
            out.append((c, "ambiguous_role", "low"))
        if by_name[c]["role"] == "identifier" and r.non_null_count and r.unique_count / r.non_null_count < t.identifier_unique:
            out.append((c, "non_unique_identifier", "high"))
        if r.total and not r.non_null_count:
            out.append((c, "fully_missing", "high"))
        elif r.total and r.unique_count == 1 and not r.missing_count:
            out.append((c, "constant_column", "low"))
    return df.sparkSession.createDataFrame(out, "column_name string, issue string, severity string")


def modality(names: Sequence[str], extensions: Sequence[str] = (), temporal: Sequence[str] = ()) -> tuple[str, float, dict[str, int]]:
    """Modality with most points from column names and file suffixes, its confidence, and all points."""
    points: dict[str, int] = {}
    for name in names:
        parts = set(name.lower().split("_"))
        for kind, tokens, worth in (("skeleton/motion", C.SKELETON_TOKENS, 2), ("audio", C.AUDIO_TOKENS, 1)):
            if parts & set(tokens):
                points[kind] = points.get(kind, 0) + worth
    for e in extensions:
        for kind, known in (("video", C.VIDEO_SUFFIXES), ("image", C.IMAGE_SUFFIXES), ("audio", C.AUDIO_SUFFIXES)):
            if e in known:
                points[kind] = points.get(kind, 0) + 2
    if any(set(n.lower().split("_")) & set(C.TEMPORAL_TOKENS) for n in temporal):
        points["temporal/sequential"] = 1
    if not points:
        return "unknown", 0.0, points
    best = max(sorted(points), key=lambda k: points[k])
    return best, min(points[best] / sum(points.values()) + 0.2, 1.0), points


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, fully missing and constant columns, and the mean missing rate."""
    stats = column_stats(df)
    kinds = F.col("unique_count") + (F.col("missing_count") > 0).cast("long")
    return stats.agg(F.max("total").alias("row_count"), F.count("*").alias("column_count"), F.count_if(F.expr("non_null_count = 0")).alias("fully_missing_columns"), F.count_if(kinds <= 1).alias("constant_columns"), F.avg("missing_rate").alias("overall_missing_rate"))


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls are equal."""
    groups = df.groupBy(*[F.col(q(c)) for c in columns or df.columns]).agg(F.count("*").alias("_n"))
    total = F.sum("_n")
    return groups.agg(total.alias("row_count"), (total - F.count("*")).alias("duplicate_rows"), F.coalesce(F.try_divide((total - F.count("*")).cast("double"), total), F.lit(0.0)).alias("duplicate_rate"))


def build_profile(df: DataFrame, source: str = "", order: str | None = None, t: C.Thresholds = C.DEFAULTS) -> dict:
    """The whole profile as a JSON tree, from a few small results."""
    stats = column_stats(df).collect()
    scored = score_roles(df, stats, order, t)
    found = candidates(scored)
    numbers = {r["column_name"]: r.asDict() for r in summaries(df, df.columns, t.profile_coverage).collect()}
    strings = [c for c in df.columns if c not in numeric_columns(df)]
    tops: dict[str, list] = {}
    if strings:
        for r in categorical_summary(df, strings).orderBy("column_name", "rank").collect():
            tops.setdefault(r.column_name, []).append({"value": r.value, "count": r["count"]})
    paths = {p: [r.asDict() for r in path_profile(df, p).collect()] for p in found["path"]}
    groups = [c for c in dict.fromkeys(found["identifier"] + found["grouping"])]
    kind, confidence, points = modality(df.columns, [r["extension"] for p in paths.values() for r in p], found["temporal"])
    return {
        "source": source,
        "columns": [{**r.asDict(), **{k: v for k, v in s.items() if k != "column_name"}, "numeric_summary": numbers.get(r.column_name), "top_values": tops.get(r.column_name), "path_profile": paths.get(r.column_name)} for r, s in zip(stats, scored, strict=True)],
        "candidates": found,
        "modality": {"modality": kind, "confidence": confidence, "points": points},
        "hierarchy": [r.asDict() for r in hierarchy(df, groups, t).collect()] if len(groups) > 1 else [],
        "schema_flags": [r.asDict() for r in schema_flags(df, scored, t).collect()],
        "summary": dataset_summary(df).head().asDict(),
        "duplicates": duplicate_summary(df).head().asDict(),
    }


