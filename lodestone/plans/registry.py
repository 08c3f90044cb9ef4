"""Queries of the audit operators over the test tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import exprs as X
from lodestone.functions import text as TX
from lodestone.operators import eda, leakage, media, profile, skeleton, stats
from lodestone.sources import readers

from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = V.table


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = V.sql(sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers as long, so that results compare across engines."""
    out = [F.round(F.col(stats.q(c)), digits).alias(c) if kind in ("double", "float") else F.col(stats.q(c)).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(stats.q(c)) for c, kind in df.dtypes]
    return df.select(*out)


def _r(text: str) -> str:
    """SQL with r6(x) for a rounded double."""
    out, at = "", 0
    while (k := text.find("r6(", at)) >= 0:
        depth, e = 1, k + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[e], 0)
            e += 1
        out += text[at:k] + f"round(CAST({_r(text[k + 3 : e - 1])} AS DOUBLE), 6)"
        at = e
    return out + text[at:]


# --- sources and sinks ------------------------------------------------------------------------------------------

add("io01_manifest_scan", lambda s, d: T(s, d, "customer"), "SELECT * FROM customer")
add(
    "io03_sql_builder",
    lambda s, d: readers.build_query(s, T(s, d, "customer"), [{"table": T(s, d, "nation"), "on": "c_nationkey = n_nationkey", "type": "LEFT"}, {"table": T(s, d, "region"), "on": "n_regionkey = r_regionkey", "type": "inner"}], ["c_custkey", "n_name", "r_name"], "c_acctbal > 0"),
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0",
)
add(
    "io04_dsn_redaction",
    lambda s, d: T(s, d, "nation").select("n_nationkey", F.udf(lambda u: readers.redact(u))(F.concat(F.lit("postgresql://user:"), "n_name", F.lit("@host/db"))).alias("dsn")),
    r"SELECT n_nationkey, regexp_replace('postgresql://user:' || n_name || '@host/db', '(://[^:/@]+:)[^@]*(@)', '\1***\2') AS dsn FROM nation",
)


def _tables(s: SparkSession, d: str) -> DataFrame:
    for n in ("region", "nation"):
        T(s, d, n).createOrReplaceTempView(n)
    return s.createDataFrame([(n,) for n in readers.list_tables(s) if n in ("region", "nation")], "table_name string")


add("io05_table_listing", _tables, "SELECT * FROM (VALUES ('region'), ('nation')) t(table_name)")


def _sql_source(s: SparkSession, d: str) -> DataFrame:
    for n in ("region", "nation"):
        T(s, d, n).createOrReplaceTempView(n)
    return readers.build_query(s, "nation", [{"table": "region", "on": "n_regionkey = r_regionkey", "type": "inner"}], ["n_name", "r_name"], "r_regionkey > 1")


add("io02_sql_source", _sql_source, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1")


def _json_round_trip(s: SparkSession, d: str) -> DataFrame:
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "a", "counts.json")
    readers.write_json({r.n_name: r.n_nationkey for r in T(s, d, "nation").collect()}, path)
    return s.createDataFrame(list(readers.read_json(path).items()), "n_name string, n_nationkey long")


add("io06_json_round_trip", _json_round_trip, "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
add(
    "io09_path_existence",
    lambda s, d: readers.existing_paths(s.createDataFrame([("nation.parquet",), ("./region.parquet",), ("sub/part.parquet",), ("gone.parquet",)], "path string"), "path", d),
    "SELECT * FROM (VALUES ('nation.parquet', true), ('./region.parquet', true), ('sub/part.parquet', true), ('gone.parquet', false)) t(path, path_exists)",
)
add(
    "io07_json_safe",
    lambda s, d: rounded(T(s, d, "events").select("event_id", X.finite(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))).alias("value"))),
    _r("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN r6(value) END AS value FROM events"),
)
add(
    "io08_union_assets",
    lambda s, d: readers.union_assets(T(s, d, "documents").select(F.lit("text").alias("source_type"), F.col("doc_id").alias("row_index"), "n_chars"), T(s, d, "pages").select(F.lit("html").alias("source_type"), F.col("page_id").alias("row_index"), "url")),
    "SELECT 'text' AS source_type, doc_id AS row_index, n_chars, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'html', page_id, NULL, url FROM pages",
)
add("io11_json_text", lambda s, d: readers.json_text(T(s, d, "events").select("event_id", F.concat(F.lit('{"a": "x", "b": '), "props", F.lit("}")).alias("j")), "j").select("event_id", "text"), "SELECT event_id, 'x' AS text FROM events")
add("io12_jsonl_text", lambda s, d: readers.json_text(T(s, d, "nation").select("n_nationkey", F.concat(F.lit('{"t": "'), "n_name", F.lit('"}\nplain')).alias("j")), "j", lines=True).select("n_nationkey", "text"), r"SELECT n_nationkey, n_name || chr(10) || 'plain' AS text FROM nation")
add(
    "io16_scene_manifest",
    lambda s, d: readers.scene_manifest(T(s, d, "nation").select(F.concat(F.lit('[{"<class vipy.FallScene>": {"_filename": "/a/b/'), "n_name", F.lit('.mp4", "attributes": {"blurred_faces": 3}}}]')).alias("value"))),
    "SELECT 'Fall' AS category, '3' AS blurred_face, 'Fall/' || n_name || '.mp4' AS filename FROM nation",
)
add(
    "io18_chart_data",
    lambda s, d: eda.histogram(T(s, d, "events"), ["value"]).unionByName(eda.histogram(T(s, d, "documents"), ["n_chars"])),
    """WITH c AS (SELECT 'value' AS column_name, value AS x FROM events UNION ALL SELECT 'n_chars', CAST(n_chars AS DOUBLE) FROM documents),
       e AS (SELECT column_name, min(x) AS lo, max(x) AS hi FROM c GROUP BY 1 HAVING max(x) > min(x))
       SELECT c.column_name, CAST(least(29, floor((x - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS count FROM c JOIN e ON c.column_name = e.column_name GROUP BY 1, 2""",
)

# --- scalar functions -------------------------------------------------------------------------------------------

add("sc01_normalize_name", lambda s, d: T(s, d, "part").select("p_partkey", X.normalize_name(F.concat(F.lit(" #"), "p_type", F.lit(" ("), "p_brand", F.lit(") "))).alias("name")), "SELECT p_partkey, trim(regexp_replace(lower(trim(' #' || p_type || ' (' || p_brand || ') ')), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
add("sc02_sanitize_filename", lambda s, d: T(s, d, "pages").select("page_id", X.sanitize_filename(F.col("url")).alias("name")), r"SELECT page_id, substr(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 120) AS name FROM pages")
add("sc03_extension", lambda s, d: V.m_docs(s, d).select("doc_id", X.extension(F.col("path")).alias("extension")).unionByName(T(s, d, "pages").select(F.col("page_id").alias("doc_id"), X.extension(F.col("url")).alias("extension"))), r"SELECT doc_id, nullif(lower(regexp_extract(path, '[^/.](\.[^./]+)$', 1)), '') AS extension FROM m_docs UNION ALL SELECT page_id, nullif(lower(regexp_extract(url, '[^/.](\.[^./]+)$', 1)), '') FROM pages")
add("sc04_path_stem", lambda s, d: V.m_convs(s, d).select("path", X.stem(F.col("path")).alias("stem")), r"SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]+$', '\1') AS stem FROM m_convs")
add("sc05_looks_like_path", lambda s, d: V.m_docs(s, d).select(F.col("path").alias("v")).union(T(s, d, "nation").select("n_name")).select("v", X.looks_like_path(F.col("v")).alias("is_path")), "SELECT v, (contains(v, '/') OR regexp_matches(lower(v), '\\.(txt|json|csv)$')) AS is_path FROM (SELECT path AS v FROM m_docs UNION ALL SELECT n_name FROM nation)")
_KIND = "CASE WHEN column_type = 'BOOLEAN' THEN 'boolean' WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') THEN 'numeric' WHEN column_type = 'DATE' OR column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END AS basic_dtype"
add("sc06_basic_dtype", lambda s, d: s.createDataFrame([(t, f.name, stats.basic_dtype(f.dataType)) for t in ("events", "documents", "embeddings", "orders") for f in T(s, d, t).schema.fields], "table_name string, column_name string, basic_dtype string"), " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_KIND} FROM (DESCRIBE {t})" for t in ("events", "documents", "embeddings", "orders")))
_MIXED = "CASE WHEN c_custkey % 4 = 0 THEN ' 12 ' WHEN c_custkey % 4 = 1 THEN '1d' WHEN c_custkey % 4 = 2 THEN c_name ELSE '-3.5' END"
add("sc07_maybe_numeric", lambda s, d: rounded(T(s, d, "customer").select(F.expr(_MIXED).alias("v")).agg(F.count(X.to_number(F.col("v"))).alias("parsed"), F.sum(X.to_number(F.col("v"))).alias("total"), (F.count(X.to_number(F.col("v"))) / F.count("*")).alias("coverage"))), _r(f"WITH v AS (SELECT {_MIXED} AS v FROM customer), n AS (SELECT CASE WHEN NOT regexp_matches(trim(v), '[dDfF]$') THEN TRY_CAST(trim(v) AS DOUBLE) END AS x FROM v) SELECT count(x) AS parsed, r6(sum(x)) AS total, r6(count(x) / count(*)) AS coverage FROM n"))
add("sc08_sample_values", lambda s, d: V.m_nulls(s, d).where("event_type is not null").orderBy("event_id").limit(5).select("event_id", "event_type"), "SELECT event_id, event_type FROM m_nulls WHERE event_type IS NOT NULL ORDER BY event_id LIMIT 5")
add("sc09_tokenize_path", lambda s, d: V.m_docs(s, d).select("doc_id", F.array_join(X.path_tokens(F.col("path")), " ").alias("tokens")), r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(path), '[\\/._\-\s]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\d+')), ' ') AS tokens FROM m_docs")
add("sc10_segment_prefix", lambda s, d: V.m_convs(s, d).select("path", X.segment_prefix(F.col("path")).alias("path_prefix")), r"SELECT path, nullif(regexp_extract(regexp_replace(path, '(.)\.[^.]+$', '\1'), '^(.+)_\d+$', 1), '') AS path_prefix FROM m_convs")
add("sc11_split_rank", lambda s, d: V.m_docs(s, d).select("doc_id", X.split_rank(F.col("split")).alias("rank")), "SELECT doc_id, CAST(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 99 END AS BIGINT) AS rank FROM m_docs")
add("sc12_season", lambda s, d: T(s, d, "orders").groupBy(X.season(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("count")), "SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season, count(*) AS count FROM orders GROUP BY 1")
add("sc13_datetime_search", lambda s, d: rounded(T(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")).agg(F.avg(X.to_datetime(F.col("v")).isNotNull().cast("double")).alias("coverage"), F.min(F.date_format(X.to_datetime(F.col("v")), "yyyy-MM-dd")).alias("first"))), _r("SELECT r6(1.0) AS coverage, min(strftime(o_orderdate, '%Y-%m-%d')) AS first FROM orders"))
add("sc14_normalize_whitespace", lambda s, d: T(s, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("text")), r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
_SENT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: x <> '')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
add("sc15_sentences", lambda s, d: T(s, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"), F.get(X.sentences(F.col("text")), F.lit(0)).alias("first")), f"SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, s[1] AS first FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
add("sc16_words", lambda s, d: T(s, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"), F.try_element_at(X.words(F.col("text")), F.lit(-1)).alias("last")), f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, w[-1] AS last FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
_SYL = "CASE WHEN l = '' THEN 0 ELSE greatest(CASE WHEN l LIKE '%e' AND g > 1 THEN g - 1 ELSE g END, 1) END"
add("sc17_syllables", lambda s, d: T(s, d, "documents").select(F.explode(X.words(F.col("text"))).alias("w")).distinct().select("w", X.syllables(F.col("w")).alias("syllables")), f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM documents), l AS (SELECT w, regexp_replace(w, '[^a-z]', '', 'g') AS l FROM w), g AS (SELECT w, l, len(regexp_extract_all(l, '[aeiouy]+')) AS g FROM l) SELECT w, CAST({_SYL} AS BIGINT) AS syllables FROM g")
add("sc18_relative_duration", lambda s, d: rounded(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.relative_duration(F.lit(2.0), F.col("l_quantity"), F.col("l_linenumber") - 1).alias("relative_duration"))), _r("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, r6((l_quantity - 2.0) / nullif(l_linenumber - 1, 0)) AS relative_duration FROM lineitem"))
add("sc19_length_bucket", lambda s, d: T(s, d, "documents").groupBy(X.length_bucket(F.size(X.words(F.col("text")))).alias("bucket")).agg(F.count("*").alias("count")), f"SELECT CASE WHEN n <= 50 THEN 'very_short' WHEN n <= 200 THEN 'short' WHEN n <= 1000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS count FROM (SELECT len({_WORDS}) AS n FROM documents) GROUP BY 1")
add("sc20_risk_level", lambda s, d: T(s, d, "lineitem").groupBy(X.risk_level(F.col("l_discount") * 10).alias("level")).agg(F.count("*").alias("count")), "SELECT CASE WHEN l_discount * 10 >= 0.85 THEN 'high' WHEN l_discount * 10 >= 0.55 THEN 'medium' ELSE 'low' END AS level, count(*) AS count FROM lineitem GROUP BY 1")

# --- profile ----------------------------------------------------------------------------------------------------

_NULL_COLS = ("event_id", "user_id", "event_type", "value", "props")


def _per_column(cols: tuple[str, ...], view: str, item: str) -> str:
    return " UNION ALL ".join(item.replace("{c}", c).replace("{v}", view) for c in cols)


add("pr01_column_profile", lambda s, d: rounded(stats.column_stats(V.m_nulls(s, d)).select("column_name", "non_null_count", "missing_count", "missing_rate", "unique_count")), _r(_per_column(_NULL_COLS, "m_nulls", "SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, r6((count(*) - count({c})) / count(*)) AS missing_rate, count(DISTINCT {c}) AS unique_count FROM {v}")))
_NAMES = [(n,) for n in ("frame_idx", "Subject ID", "label", "user_id", "created", "start time", "video_path", "fold", "y", "audio")]
add(
    "pr02_name_hints",
    lambda s, d: profile.name_hints(s.createDataFrame(_NAMES, "column_name string")),
    "SELECT * FROM (VALUES ('frame_idx', 'frame_idx', 0.7, 0.0, 0.0, 0.6, 0.0), ('Subject ID', 'subject_id', 0.0, 0.0, 0.7, 0.0, 0.6), ('label', 'label', 0.0, 0.7, 0.0, 0.0, 0.0), ('user_id', 'user_id', 0.0, 0.0, 0.0, 0.0, 0.6), ('created', 'created', 0.0, 0.0, 0.0, 0.0, 0.0), ('start time', 'start_time', 0.0, 0.0, 0.0, 0.6, 0.0), ('video_path', 'video_path', 0.7, 0.0, 0.0, 0.0, 0.0), ('fold', 'fold', 0.0, 0.0, 0.7, 0.0, 0.0), ('y', 'y', 0.0, 0.7, 0.0, 0.0, 0.0), ('audio', 'audio', 0.7, 0.0, 0.0, 0.0, 0.0)) t(column_name, normalized_name, path_score, label_score, grouping_score, temporal_score, identifier_score)".replace("0.7", "CAST(0.7 AS DOUBLE)").replace("0.6", "CAST(0.6 AS DOUBLE)").replace(" 0.0", " CAST(0.0 AS DOUBLE)"),
)
add("pr02_roles", lambda s, d: profile.roles(T(s, d, "events")).select("column_name", "role", "confidence"), "SELECT * FROM (VALUES ('event_id', 'label/target', CAST(0.7 AS DOUBLE)), ('ts', 'temporal field', CAST(0.5 AS DOUBLE)), ('user_id', 'identifier', CAST(0.6 AS DOUBLE)), ('event_type', 'label/target', CAST(0.7 AS DOUBLE)), ('value', 'numeric measurement', CAST(0.5 AS DOUBLE)), ('props', 'unknown', CAST(0.1 AS DOUBLE))) t(column_name, role, confidence)")
_SUMMARY = "SELECT '{c}' AS column_name, count({c}) AS count, r6(avg({c})) AS mean, r6(coalesce(stddev_samp({c}), 0)) AS std, r6(min({c})) AS min, r6(quantile_cont({c}, 0.25)) AS p25, r6(quantile_cont({c}, 0.5)) AS median, r6(quantile_cont({c}, 0.75)) AS p75, r6(max({c})) AS max FROM {v}"
_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
add("pr03_numeric_summary", lambda s, d: rounded(stats.summaries(T(s, d, "lineitem"), _LINE, 0.5)), _r(_per_column(_LINE, "lineitem", _SUMMARY)))
add("pr04_categorical_summary", lambda s, d: profile.categorical_summary(T(s, d, "part"), ["p_brand", "p_type"]), "WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), n AS (SELECT column_name, value, count(*) AS count FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank FROM n) SELECT * FROM r WHERE rank <= 10")
add("pr05_path_profile", lambda s, d: profile.path_profile(T(s, d, "pages"), "url"), r"WITH o AS (SELECT count(url) AS non_null_count, count(url) - count(DISTINCT url) AS duplicate_count FROM pages), e AS (SELECT coalesce(nullif(lower(regexp_extract(url, '[^/.](\.[^./]+)$', 1)), ''), '<none>') AS extension, count(*) AS count FROM pages GROUP BY 1 ORDER BY count DESC, extension LIMIT 20) SELECT * FROM e, o")
add("pr06_segment_pattern", lambda s, d: rounded(profile.segment_pattern(V.m_convs(s, d), "path")), _r(r"WITH p AS (SELECT nullif(regexp_extract(regexp_replace(path, '(.)\.[^.]+$', '\1'), '^(.+)_\d+$', 1), '') AS p FROM m_convs), c AS (SELECT p, count(*) AS n FROM p GROUP BY 1) SELECT r6(sum(CASE WHEN p IS NOT NULL THEN n END) / sum(n)) AS match_rate, count(p) AS unique_prefixes, CAST(count_if(n > 1 AND p IS NOT NULL) AS BIGINT) AS repeated_prefixes, max(CASE WHEN p IS NOT NULL THEN n END) AS most_common_count FROM c"))
add("pr07_nesting_purity", lambda s, d: rounded(profile.nesting_purity(V.m_geo(s, d), "c_nationkey", "n_regionkey")), _r("WITH c AS (SELECT c_nationkey, count(DISTINCT n_regionkey) AS p FROM m_geo GROUP BY 1) SELECT 'n_regionkey' AS parent, 'c_nationkey' AS child, r6(avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END)) AS nesting_purity FROM c"))
add("pr08_hierarchy", lambda s, d: rounded(profile.hierarchy(V.m_geo(s, d), ["n_regionkey", "c_nationkey"])), _r("WITH c AS (SELECT c_nationkey, count(DISTINCT n_regionkey) AS p FROM m_geo GROUP BY 1), u AS (SELECT count(DISTINCT n_regionkey) AS a, count(DISTINCT c_nationkey) AS b FROM m_geo) SELECT 'n_regionkey' AS parent, 'c_nationkey' AS child, a AS parent_unique_count, b AS child_unique_count, r6(b / a) AS avg_children_per_parent, r6((SELECT avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) FROM c)) AS nesting_purity FROM u"))
add("pr09_hierarchy_chain", lambda s, d: profile.hierarchy_chain(profile.hierarchy(V.m_geo(s, d), ["n_regionkey", "c_nationkey"])).select(F.array_join("chain", ">").alias("chain"), F.col("depth").cast("long").alias("depth")), "SELECT 'n_regionkey>c_nationkey' AS chain, CAST(2 AS BIGINT) AS depth")
add("pr10_directory_hierarchy", lambda s, d: profile.directory_hierarchy(V.m_docs(s, d), "path"), "WITH p AS (SELECT string_split(path, '/') AS p FROM m_docs), e AS (SELECT unnest(range(1, len(p))) AS depth, p FROM p) SELECT CAST(depth AS BIGINT) AS depth, count(DISTINCT p[depth]) AS unique_directories, count(*) AS count FROM e GROUP BY 1")
add("pr11_schema_flags", lambda s, d: profile.schema_flags(V.m_docs(s, d).select("doc_id", F.lit("x").alias("constant"), F.col("n_chars").cast("string").alias("size_text"), F.lit(None).cast("string").alias("gone"))), "SELECT * FROM (VALUES ('constant', 'constant_column', 'low'), ('size_text', 'numeric_stored_as_string', 'medium'), ('gone', 'fully_missing', 'high')) t(column_name, issue, severity)")
add("pr12_modality", lambda s, d: rounded(s.createDataFrame([profile.modality(["keypoints_path", "fps", "label"], [".mp4"], ["fps"])[:2]], "modality string, confidence double")), _r("SELECT 'skeleton/motion' AS modality, r6(4.0 / 7.0 + 0.2) AS confidence"))
add("pr13_dataset_summary", lambda s, d: rounded(profile.dataset_summary(V.m_nulls(s, d))), _r("WITH r AS (" + _per_column(_NULL_COLS, "m_nulls", "SELECT count(*) AS total, count({c}) AS n, count(DISTINCT {c}) AS u FROM {v}") + ") SELECT max(total) AS row_count, count(*) AS column_count, CAST(count_if(n = 0) AS BIGINT) AS fully_missing_columns, CAST(count_if(u + CAST(n < total AS INTEGER) <= 1) AS BIGINT) AS constant_columns, r6(avg((total - n) / total)) AS overall_missing_rate FROM r"))
add("pr14_duplicate_summary", lambda s, d: rounded(profile.duplicate_summary(T(s, d, "documents"), ["text"])), _r("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, r6((sum(n) - count(*)) / sum(n)) AS duplicate_rate FROM g"))


def _profile_tree(s: SparkSession, d: str) -> DataFrame:
    import json

    tree = profile.build_profile(V.m_nulls(s, d), "events", "event_id")
    return s.createDataFrame([(k, json.dumps(readers.json_safe(v), sort_keys=True)) for k, v in tree.items()], "section string, content string")


add("pr15_build_profile", _profile_tree)

# --- exploratory analyses ---------------------------------------------------------------------------------------

add("ed02_primary_column", lambda s, d: s.createDataFrame([(eda.primary_column({r.column_name: r.unique_count for r in stats.column_stats(T(s, d, "events"), ["event_id", "event_type"]).collect()}, ["event_id", "event_type"]),)], "column_name string"), "SELECT 'event_type' AS column_name")
add("ed03_text_columns", lambda s, d: rounded(eda.text_columns(V.m_docs(s, d), ("path",))), _r("SELECT 'text' AS column_name, true AS name_hint, r6(avg(length(text))) AS avg_length FROM m_docs"))
add("ed04_missingness", lambda s, d: rounded(eda.missingness(V.m_nulls(s, d))), _r(_per_column(_NULL_COLS, "m_nulls", "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, r6((count(*) - count({c})) / count(*)) AS missing_rate FROM {v}")))
add("ed05_co_missingness", lambda s, d: rounded(eda.co_missingness(V.m_nulls(s, d))), _r("SELECT 'value' AS col_a, 'props' AS col_b, CAST(count_if(value IS NULL AND props IS NULL) AS BIGINT) AS co_missing_count, r6(count_if(value IS NULL AND props IS NULL) / count(*)) AS co_missing_rate, r6(count_if(value IS NULL AND props IS NULL) / count_if(value IS NULL OR props IS NULL)) AS jaccard FROM m_nulls"))
_OTHER = ("event_id", "user_id", "value", "props")
add("ed06_missingness_by_label", lambda s, d: rounded(eda.missingness_by_label(V.m_nulls(s, d), "event_type")), _r(_per_column(_OTHER, "m_nulls", "SELECT coalesce(event_type, '<MISSING_LABEL>') AS label, count(*) AS count, '{c}' AS column_name, r6(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)) AS missing_rate FROM {v} GROUP BY 1")))
_DIST = "WITH c AS (SELECT coalesce(CAST(label AS VARCHAR), '<MISSING>') AS label, count(*) AS count FROM m_docs GROUP BY 1) SELECT label, count, r6(count / sum(count) OVER ()) AS proportion, r6(max(CASE WHEN label <> '<MISSING>' THEN count END) OVER () / min(CASE WHEN label <> '<MISSING>' THEN count END) OVER ()) AS imbalance_ratio FROM c"
add("ed07_label_distribution", lambda s, d: rounded(eda.label_distribution(V.m_docs(s, d), "label")), _r(_DIST))
add("ed08_rare_classes", lambda s, d: rounded(eda.rare_classes(T(s, d, "part"), "p_brand", eda.Thresholds(rare_proportion=0.04))), _r("WITH c AS (SELECT p_brand AS label, count(*) AS count FROM part GROUP BY 1), p AS (SELECT label, count, count / sum(count) OVER () AS p FROM c) SELECT label, count, r6(p) AS proportion FROM p WHERE count < 5 OR p < 0.04"))
add("ed09_conflicting_labels", lambda s, d: eda.conflicting_labels(V.m_events(s, d).withColumn("path", F.concat(F.lit("u/"), F.col("user_id").cast("string"))), "path", "label"), "SELECT 'u/' || CAST(user_id AS VARCHAR) AS path, count(DISTINCT label) AS label_count, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m_events GROUP BY 1 HAVING count(DISTINCT label) > 1")
_MIX = "WITH c AS (SELECT {g} AS g, {l} AS l, count(*) AS n FROM {v} WHERE {g} IS NOT NULL AND {l} IS NOT NULL GROUP BY 1, 2), p AS (SELECT g, sum(n) AS r, max(n) AS m, count(*) AS k FROM c GROUP BY 1) SELECT '{g}' AS group_column, count(*) AS total_group_count, CAST(count_if(k > 1) AS BIGINT) AS mixed_group_count, r6(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END)) AS mixed_group_rate, CAST(sum(CASE WHEN k > 1 THEN r - m ELSE 0 END) AS BIGINT) AS noise_candidate_count, r6(sum(CASE WHEN k > 1 THEN r - m ELSE 0 END) / sum(r)) AS noise_candidate_rate FROM p"
add("ed10_label_inconsistency", lambda s, d: rounded(eda.label_inconsistency(V.m_docs(s, d), "source", "label")), _r(_MIX.format(g="source", l="label", v="m_docs")))
_CLASS = "WITH c AS (SELECT 'value' AS column_name, label, value AS x FROM m_events UNION ALL SELECT 'user_id', label, CAST(user_id AS DOUBLE) FROM m_events), f AS (SELECT column_name, label, count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM c GROUP BY 1, 2 HAVING count(*) >= 10), j AS (SELECT c.column_name, x, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM c JOIN f ON c.column_name = f.column_name AND c.label = f.label WHERE b > a) SELECT column_name, CAST(count_if(x < lo OR x > hi) AS BIGINT) AS candidate_count, r6(count_if(x < lo OR x > hi) / count(*)) AS candidate_rate FROM j GROUP BY 1"
add("ed11_class_outliers", lambda s, d: rounded(eda.class_outliers(V.m_events(s, d), "label", ["value", "user_id"])), _r(_CLASS))


def _noise(s: SparkSession, d: str) -> DataFrame:
    docs, events = V.m_docs(s, d), V.m_events(s, d)
    parts = [("conflicting_labels", eda.conflicting_labels(docs, "path", "label").agg(F.count("*").alias("n"))), ("label_inconsistency", eda.label_inconsistency(docs, "source", "label").select(F.col("noise_candidate_count").alias("n"))), ("class_outliers", eda.class_outliers(events, "label", ["value"]).select(F.col("candidate_count").alias("n")))]
    out = None
    for name, part in parts:
        row = part.select(F.lit(name).alias("check_name"), F.col("n").cast("long").alias("candidates"))
        out = row if out is None else out.unionByName(row)
    return out


_CANDIDATES = {
    "conflicting_labels": "SELECT count(*) AS n FROM (SELECT path FROM m_docs GROUP BY 1 HAVING count(DISTINCT label) > 1)",
    "label_inconsistency": "SELECT noise_candidate_count AS n FROM (" + _MIX.format(g="source", l="label", v="m_docs") + ")",
    "class_outliers": "SELECT candidate_count AS n FROM (" + _CLASS + ") WHERE column_name = 'value'",
}
add("ed12_label_noise", _noise, _r(" UNION ALL ".join(f"SELECT '{k}' AS check_name, CAST(n AS BIGINT) AS candidates FROM ({v})" for k, v in _CANDIDATES.items())))
add("ed13_numeric_summaries", lambda s, d: rounded(eda.numeric_summaries(T(s, d, "orders").select("o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"])), _r(_per_column(("o_totalprice", "o_custkey"), "orders", _SUMMARY)))
_SCALE = "WITH c AS (" + _per_column(_LINE, "lineitem", "SELECT '{c}' AS column_name, {c} AS x FROM {v}") + ") , o AS (SELECT column_name, min(x) AS lo, max(x) AS hi, max(x) - min(x) AS rg, stddev_samp(x) AS sd, avg(x) AS mn, skewness(x) AS sk FROM c GROUP BY 1), m AS (SELECT median(rg) AS mid, max(round(log10(rg), 3)) - min(round(log10(rg), 3)) AS sp, max(rg) / min(rg) AS rr FROM o) SELECT column_name, r6(lo) AS min, r6(hi) AS max, r6(rg) AS range, r6(sd) AS std, r6(mn) AS mean, r6(sk) AS skewness, r6(round(log10(rg), 3)) AS log10_range, lo >= 0 AND hi <= 1 AS already_normalized, abs(sk) > 2 AS high_skew, lo >= 0 AND NOT (lo >= 0 AND hi <= 1) AND sk > 1.5 AS log_transform_candidate, rg >= 10 * mid AS dominant_scale, rg <= mid / 10 AS small_scale, r6(rr) AS max_range_ratio, sp >= 2 AS mixed_scale_detected FROM o, m"
add("ed14_feature_scaling", lambda s, d: rounded(eda.feature_scaling(T(s, d, "lineitem"), _LINE)), _r(_SCALE))
_FENCE = "WITH c AS (SELECT 'value' AS column_name, event_id AS i, value AS x FROM events UNION ALL SELECT 'n_chars', doc_id, CAST(n_chars AS DOUBLE) FROM documents), f AS (SELECT column_name, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b, mad(x) AS md, count(*) AS n FROM c GROUP BY 1), j AS (SELECT c.*, n, b - a AS iqr, a - 1.5 * (b - a) AS lm, b + 1.5 * (b - a) AS hm, a - 3 * (b - a) AS le, b + 3 * (b - a) AS he, coalesce(abs(0.6745 * (x - m) / nullif(md, 0)) > 3.5, false) AS z FROM c JOIN f ON c.column_name = f.column_name)"
_OUT = _FENCE + " SELECT column_name, CAST(count_if(x < lm OR x > hm) AS BIGINT) AS iqr_mild_count, CAST(count_if(x < le OR x > he) AS BIGINT) AS iqr_extreme_count, CAST(count_if(x < lm) AS BIGINT) AS count_low, CAST(count_if(x > hm) AS BIGINT) AS count_high, CAST(count_if(z) AS BIGINT) AS mad_count, r6(count_if(x < lm OR x > hm) / max(n)) AS outlier_rate, r6(round(max(greatest(lm - x, x - hm, 0)) / max(iqr), 2)) AS severity_iqr_multiples, r6(max(lm)) AS low_mild, r6(max(hm)) AS high_mild, r6(max(le)) AS low_extreme, r6(max(he)) AS high_extreme FROM j GROUP BY 1"


def _out(s: SparkSession, d: str) -> DataFrame:
    return rounded(eda.outliers(T(s, d, "events"), ["value"]).unionByName(eda.outliers(T(s, d, "documents"), ["n_chars"])))


add("ed15_iqr_outliers", _out, _r(_OUT))
add("ed16_mad_outliers", lambda s, d: _out(s, d).select("column_name", "mad_count"), _r(f"SELECT column_name, mad_count FROM ({_OUT})"))
add("ed17_outlier_examples", lambda s, d: rounded(eda.outlier_examples(T(s, d, "events"), ["value"], "event_id")), _r(_FENCE + ", k AS (SELECT column_name, i AS row_id, x, greatest(lm - x, x - hm, 0) AS dist, row_number() OVER (ORDER BY greatest(lm - x, x - hm, 0) DESC, i) AS rank FROM j WHERE column_name = 'value' AND (x < lm OR x > hm OR z)) SELECT column_name, row_id, r6(x) AS x, r6(dist) AS distance, rank FROM k WHERE rank <= 5"))
add("ed18_grouped_labels", lambda s, d: rounded(eda.grouped_label_distribution(V.m_docs(s, d), "source", "label")), _r("WITH c AS (SELECT source AS g, coalesce(CAST(label AS VARCHAR), '<MISSING_LABEL>') AS label, count(*) AS count FROM m_docs GROUP BY 1, 2) SELECT g AS \"group\", label, count, r6(count / sum(count) OVER (PARTITION BY g)) AS proportion FROM c"))
add("ed19_histogram", lambda s, d: eda.histogram(T(s, d, "lineitem"), ["l_extendedprice"]), "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT 'l_extendedprice' AS column_name, CAST(least(29, floor((l_extendedprice - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS count FROM lineitem, e GROUP BY 2")
add("ed20_sample", lambda s, d: eda.sample_rows(T(s, d, "documents").select("doc_id", "source"), "doc_id", 50), "SELECT doc_id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
add("ed21_asset_dispatch", lambda s, d: V.m_docs(s, d).select("path").unionByName(V.m_pages(s, d).select("path")).groupBy(_dispatch(F.col("path")).alias("modality")).agg(F.count("*").alias("count")), r"SELECT CASE WHEN regexp_matches(lower(path), '\.(txt|md|log|json|jsonl|csv|tsv)$') THEN 'text' ELSE 'none' END AS modality, count(*) AS count FROM (SELECT path FROM m_docs UNION ALL SELECT path FROM m_pages) GROUP BY 1")
add("ed22_derived_summary", lambda s, d: rounded(stats.summaries(TX.text_metrics(T(s, d, "documents"), "text", keep=("doc_id",)), ["char_count"], 0.8)), _r(_SUMMARY.replace("{c}", "char_count").replace("{v}", "(SELECT CAST(length(text) AS DOUBLE) AS char_count FROM documents)")))


def _dispatch(path):
    from lodestone import config as C

    e = X.extension(path)
    return F.when(e.isin(*C.TEXT_SUFFIXES), "text").when(e.isin(*C.AUDIO_SUFFIXES), "audio").when(e.isin(*C.VIDEO_SUFFIXES), "video").when(e == ".npz", "skeleton").otherwise("none")


def _summary_tree(s: SparkSession, d: str) -> DataFrame:
    docs = V.m_docs(s, d)
    text = readers.markdown("Summary", {"Labels": eda.label_distribution(docs, "label").orderBy("label"), "Missing": eda.missingness(docs)})
    return s.createDataFrame([(k, line) for k, line in enumerate(text.split("\n"))], "line_number long, line string")


add("ed23_summary_markdown", _summary_tree)

# --- texts ------------------------------------------------------------------------------------------------------

_LINES = r"(CASE WHEN text = '' THEN [] ELSE (CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END) END)"
_TEXT = f"t AS (SELECT doc_id, text, {_WORDS} AS w, {_SENT} AS s, {_LINES} AS ln FROM documents)"


def _metrics(names: tuple[str, ...]):
    return lambda s, d: rounded(TX.text_metrics(T(s, d, "documents"), "text", keep=("doc_id",)).select("doc_id", *names))


add("tx1_length", _metrics(tuple(TX.METRICS[:9])), _r(f"WITH {_TEXT} SELECT doc_id, r6(length(text)) AS char_count, r6(length(regexp_replace(text, '\\s+', '', 'g'))) AS char_count_no_space, r6(len(w)) AS word_count, r6(len(s)) AS sentence_count, r6(len(ln)) AS line_count, r6(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda p: regexp_matches(p, '\\S')))) AS paragraph_count, r6(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0)) AS avg_word_length, r6(coalesce(len(w) / nullif(len(s), 0), 0)) AS avg_sentence_length_words, r6(coalesce(list_avg(list_transform(ln, lambda x: length(x))), 0)) AS avg_line_length_chars FROM t"))
_STOP = "[" + ", ".join(f"'{w}'" for w in TX.STOP_WORDS) + "]"
add("tx2_lexical", _metrics(tuple(TX.METRICS[9:13])), _r(f"WITH {_TEXT}, e AS (SELECT doc_id, unnest(w) AS x FROM t), c AS (SELECT doc_id, x, count(*) AS n FROM e GROUP BY 1, 2), a AS (SELECT doc_id, count(*) AS u, count_if(n = 1) AS h, sum(n) AS k, sum(CASE WHEN list_contains({_STOP}, x) THEN n ELSE 0 END) AS st FROM c GROUP BY 1) SELECT t.doc_id, r6(coalesce(u, 0)) AS unique_word_count, r6(coalesce(u / k, 0)) AS type_token_ratio, r6(coalesce(h / k, 0)) AS hapax_ratio, r6(coalesce(st / k, 0)) AS stopword_ratio FROM t LEFT JOIN a ON t.doc_id = a.doc_id"))
add("tx3_repetition", _metrics(tuple(TX.METRICS[13:16])), _r(f"WITH {_TEXT}, l AS (SELECT doc_id, unnest(list_filter(list_transform(ln, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS x FROM t), lc AS (SELECT doc_id, x, count(*) AS n FROM l GROUP BY 1, 2), la AS (SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS r FROM lc GROUP BY 1), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM t WHERE len(w) >= 3), gc AS (SELECT doc_id, x, count(*) AS n FROM g GROUP BY 1, 2), ga AS (SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS r, max(n) AS m FROM gc GROUP BY 1) SELECT t.doc_id, r6(CASE WHEN len(w) >= 3 THEN coalesce(la.r, 0) ELSE 0 END) AS duplicate_line_ratio, r6(coalesce(ga.r, 0)) AS repeated_ngram_ratio, r6(coalesce(m, 0)) AS max_ngram_frequency FROM t LEFT JOIN la ON t.doc_id = la.doc_id LEFT JOIN ga ON t.doc_id = ga.doc_id"))


def _share(p: str) -> str:
    return f"coalesce(len(regexp_extract_all(text, '{p}')) / nullif(length(text), 0), 0)"


add("tx4_noise", _metrics(tuple(TX.METRICS[16:24])), _r("SELECT doc_id, " + ", ".join(f"r6({e}) AS {n}" for n, e in (("whitespace_ratio", _share(r"\s")), ("digit_ratio", _share(r"\p{Nd}")), ("punctuation_ratio", _share(r"[^\p{L}\p{N}_\s]")), ("uppercase_ratio", _share(r"\p{Lu}")), ("url_count", r"len(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+'))"), ("email_count", r"len(regexp_extract_all(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b'))"), ("repeated_punctuation_count", r"len(regexp_extract_all(text, '!{2,}|\?{2,}|\.{2,}|,{2,}|;{2,}|:{2,}'))"), ("non_ascii_ratio", _share(r"[^\x00-\x7F]")))) + " FROM documents"))
add("tx5_entropy", _metrics(("char_entropy",)), _r("WITH e AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, r6(-sum(p * log2(p))) AS char_entropy FROM p GROUP BY 1"))
add("tx6_readability", _metrics(tuple(TX.METRICS[25:28])), _r(f"WITH {_TEXT}, e AS (SELECT doc_id, unnest(w) AS x FROM t), l AS (SELECT doc_id, regexp_replace(x, '[^a-z]', '', 'g') AS l FROM e), g AS (SELECT doc_id, l, len(regexp_extract_all(l, '[aeiouy]+')) AS g FROM l), y AS (SELECT doc_id, {_SYL} AS y FROM g), a AS (SELECT doc_id, sum(y) AS sy, count(*) AS k, count_if(y >= 3) AS cx FROM y GROUP BY 1) SELECT t.doc_id, r6(coalesce(206.835 - 1.015 * (CAST(k AS DOUBLE) / greatest(len(s), 1)) - 84.6 * (CAST(sy AS DOUBLE) / k), 0)) AS flesch_reading_ease, r6(coalesce(0.39 * (CAST(k AS DOUBLE) / greatest(len(s), 1)) + 11.8 * (CAST(sy AS DOUBLE) / k) - 15.59, 0)) AS flesch_kincaid_grade, r6(coalesce(cx / k, 0)) AS complex_word_ratio FROM t LEFT JOIN a ON t.doc_id = a.doc_id"))
add("tx7_label_overlap", lambda s, d: rounded(T(s, d, "conversations").select("conv_id", "turn", TX.label_overlap(F.col("text"), F.concat("role", F.lit(" the"))).alias("overlap"))), _r(r"WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(role || ' the'), '[\p{L}\p{N}_]+')) AS b FROM conversations) SELECT conv_id, turn, r6(len(list_intersect(a, b)) / len(b)) AS overlap FROM t"))
_BUNDLE = "(SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[n]}) {n}" + (" USING (doc_id)" if k else "") for k, n in enumerate(("tx1_length", "tx2_lexical", "tx3_repetition", "tx4_noise", "tx5_entropy", "tx6_readability"))) + ")"
_SHARED = "(SELECT doc_id, r6(CASE WHEN label IS NOT NULL THEN len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), [CAST(label AS VARCHAR)])) END) AS label_keyword_overlap FROM m_docs)"
add("tx8_text_bundle", lambda s, d: rounded(TX.text_metrics(V.m_docs(s, d), "text", "label", ("doc_id",))), _r(f"SELECT b.*, false AS text_missing, o.label_keyword_overlap FROM {_BUNDLE} b JOIN {_SHARED} o ON b.doc_id = o.doc_id"))
# Summaries of rounded metrics, to five digits, and by a billionth off the ties between two such numbers.
_FIVE = ("mean", "std", "min", "p25", "median", "p75", "max")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    # Dealt out once, so that the passes of the summaries share the rows, and texts are measured once.
    rows = rounded(TX.text_metrics(T(s, d, "documents"), "text", keep=("doc_id",))).select(*TX.METRICS).repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    out = stats.summaries(rows, TX.METRICS, 0.5)
    return out.select("column_name", "count", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in _FIVE])


add("tx9_corpus_summary", _corpus, f"WITH b AS {_BUNDLE} SELECT column_name, count, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in _FIVE) + " FROM (" + _per_column(TX.METRICS, "b", _SUMMARY.replace("r6(", "(")) + ")")

# --- skeletons --------------------------------------------------------------------------------------------------

_POSE = eda.Thresholds(joint_confidence=0.1, min_joints=5)
_POSED = lambda s, d: rounded(skeleton.skeleton_metrics(V.m_pose(s, d), ("clip",), _POSE))
_J = "j AS (SELECT clip, f, j, k[f + 1][j + 1].x AS x, k[f + 1][j + 1].y AS y, k[f + 1][j + 1].c AS c FROM m_pose, (SELECT unnest(range(0, 10)) AS f), (SELECT unnest(range(0, 17)) AS j))"
add("sk1_duration", lambda s, d: _POSED(s, d).select("clip", "n_frames", "duration_seconds"), _r("SELECT clip, CAST(10 AS BIGINT) AS n_frames, r6(10 / 25.0) AS duration_seconds FROM m_pose"))
add("sk2_visible_joints", lambda s, d: _POSED(s, d).select("clip", "mean_visible_joints"), _r(f"WITH {_J} SELECT clip, r6(count_if(c >= 0.1) / 10) AS mean_visible_joints FROM j GROUP BY 1"))
add("sk3_trace_length", lambda s, d: _POSED(s, d).select("clip", "trace_length"), f"WITH {_J}, v AS (SELECT clip, f, count_if(c >= 0.1) >= 5 AS ok FROM j GROUP BY 1, 2), g AS (SELECT clip, f - row_number() OVER (PARTITION BY clip ORDER BY f) AS g FROM v WHERE ok), r AS (SELECT clip, g, count(*) AS n FROM g GROUP BY 1, 2), b AS (SELECT clip, max(n) AS n FROM r GROUP BY 1) SELECT m_pose.clip, CAST(coalesce(n, 0) AS BIGINT) AS trace_length FROM m_pose LEFT JOIN b ON m_pose.clip = b.clip")
add("sk45_confidence", lambda s, d: _POSED(s, d).select("clip", "avg_keypoint_confidence", "confidence_variance"), _r(f"WITH {_J} SELECT clip, r6(avg(c)) AS avg_keypoint_confidence, r6(var_pop(c)) AS confidence_variance FROM j GROUP BY 1"))
add("sk6_velocity", lambda s, d: _POSED(s, d).select("clip", "velocity_mean", "velocity_max", "velocity_variance"), _r(f"WITH {_J}, p AS (SELECT clip, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS v, c >= 0.1 AND lag(c) OVER w >= 0.1 AS ok FROM j WINDOW w AS (PARTITION BY clip, j ORDER BY f)) SELECT m_pose.clip, r6(avg(v) FILTER (ok)) AS velocity_mean, r6(max(v) FILTER (ok)) AS velocity_max, r6(var_pop(v) FILTER (ok)) AS velocity_variance FROM m_pose LEFT JOIN p ON m_pose.clip = p.clip GROUP BY 1"))
add("sk7_bbox_area", lambda s, d: _POSED(s, d).select("clip", "mean_bbox_area_ratio"), _r(f"WITH {_J}, b AS (SELECT clip, f, max(x) - min(x) AS w, max(y) - min(y) AS h FROM j WHERE j < 2 GROUP BY 1, 2) SELECT clip, r6(avg(w * h / 8)) AS mean_bbox_area_ratio FROM b GROUP BY 1"))
add("sk8_limb_variance", lambda s, d: _POSED(s, d).select("clip", "left_shoulder_elbow", "right_hip_knee"), _r(f"WITH {_J}, l AS (SELECT a.clip, a.j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS v FROM j a JOIN j b ON a.clip = b.clip AND a.f = b.f AND b.j = a.j + 2 WHERE a.j IN (5, 12) AND a.c >= 0.1 AND b.c >= 0.1) SELECT m_pose.clip, r6(CASE WHEN count(v) FILTER (j = 5) >= 2 THEN var_pop(v) FILTER (j = 5) END) AS left_shoulder_elbow, r6(CASE WHEN count(v) FILTER (j = 12) >= 2 THEN var_pop(v) FILTER (j = 12) END) AS right_hip_knee FROM m_pose LEFT JOIN l ON m_pose.clip = l.clip GROUP BY 1"))

# --- audio and video --------------------------------------------------------------------------------------------



def _waves(s: SparkSession, d: str) -> DataFrame:
    """A second of sound for each vector, as WAV files in memory."""

    def make(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for b in (whole.iloc[k : k + 256] for whole in batches for k in range(0, len(whole), 256)):
            out = []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                raw = io.BytesIO()
                with wave.open(raw, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(8000)
                    w.writeframes((np.resize(np.asarray(v, float), 8000) * 30000).astype("<i2").tobytes())
                out.append((f"{i}.wav", raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return T(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(make, "path string, content binary")


add("au1_audio_info", lambda s, d: rounded(media.audio_files(_waves(s, d)).select("path", "duration_seconds", "sample_rate", "channels", "n_samples")), _r("SELECT CAST(vec_id AS VARCHAR) || '.wav' AS path, r6(1) AS duration_seconds, CAST(8000 AS BIGINT) AS sample_rate, CAST(1 AS BIGINT) AS channels, CAST(8000 AS BIGINT) AS n_samples FROM embeddings"))
add("au7_audio_metrics", lambda s, d: rounded(media.audio_files(_waves(s, d))))
add("vi3_video_info", lambda s, d: media.video_info(_waves(s, d)).select("path", "status"))
add("au6_clipping", lambda s, d: rounded(T(s, d, "embeddings").select("vec_id", media.clipping_ratio(F.transform("embedding", lambda x: x.cast("double") * 5)).alias("clipping_ratio"))), _r("SELECT vec_id, r6(len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE) * 5) >= 0.999)) / len(embedding)) AS clipping_ratio FROM embeddings"))
add("vi1_temporal_snr", lambda s, d: rounded(media.temporal_snr(T(s, d, "events"), "user_id", "value")), _r("SELECT user_id, count(*) AS n_frames, r6(avg(value) / greatest(coalesce(stddev_samp(value), 0), 1e-12)) AS temporal_snr FROM events GROUP BY 1 HAVING count(*) > 0"))
add("vi2_action_window", lambda s, d: rounded(media.action_window(T(s, d, "events"), "user_id", "event_id", "value")), _r("WITH a AS (SELECT user_id, event_id AS f, value AS v, avg(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, r6(max(v)) AS max_amplitude, r6(avg(v)) AS mean_amplitude, greatest(min(f), min(CASE WHEN v >= 0.5 * m THEN f END) - 2) AS start_frame, least(max(f), max(CASE WHEN v >= 0.5 * m THEN f END) + 2) AS end_frame FROM a GROUP BY 1"))

# --- leakage ----------------------------------------------------------------------------------------------------

_RISK = "CASE WHEN {x} >= 0.85 THEN 'high' WHEN {x} >= 0.55 THEN 'medium' ELSE 'low' END"
add("lk01_duplicates", lambda s, d: rounded(leakage.duplicates(T(s, d, "documents"), ["text"])), _r("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT sum(n) AS t, sum(n) - count(*) AS k FROM g), v AS (SELECT *, least(1.0, k / t * 3) AS x FROM r) SELECT CAST(t AS BIGINT) AS row_count, CAST(k AS BIGINT) AS duplicate_rows, r6(k / t) AS duplicate_rate, r6(round(x, 3)) AS severity_score, " + _RISK.format(x="x") + " AS risk_level FROM v"))
_OVER = "WITH e AS (SELECT {e}, count(DISTINCT split) AS n FROM {v} GROUP BY 1), o AS (SELECT count(*) AS t, count_if(n > 1) AS k FROM e), v AS (SELECT *, least(1.0, k / t * 2.5) AS x FROM o) SELECT '{e}' AS entity_column, 'split' AS split_column, t AS entity_count, CAST(k AS BIGINT) AS overlapping_entities, r6(k / t) AS overlap_rate, r6(round(x, 3)) AS severity_score, " + _RISK.format(x="x") + " AS risk_level FROM v"
add("lk02_split_overlap", lambda s, d: rounded(leakage.split_overlap(V.m_events(s, d), "user_id", "split")), _r(_OVER.format(e="user_id", v="m_events")))
add("lk03_label_by_split", lambda s, d: leakage.label_by_split(V.m_docs(s, d), "split", "label"), "SELECT split, coalesce(CAST(label AS VARCHAR), '<MISSING>') AS label, count(*) AS count FROM m_docs GROUP BY 1, 2")
add("lk04_path_label_shortcuts", lambda s, d: rounded(leakage.path_label_shortcuts(V.m_pages(s, d), "path", "label")), _r(r"WITH p AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(path), '[\\/._\-\s]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\d+'))) AS t, coalesce(label, '<MISSING>') AS l FROM m_pages), e AS (SELECT unnest(t) AS token, l FROM p), c AS (SELECT token, l, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, l) AS k FROM c), a AS (SELECT token, sum(n) AS n, max(n) AS m, max(CASE WHEN k = 1 THEN l END) AS dl FROM r GROUP BY 1 HAVING sum(n) >= 3), v AS (SELECT list(DISTINCT regexp_replace(lower(l), '[^a-z0-9]+', '', 'g')) AS names FROM p), m AS (SELECT a.*, m / n AS pu, regexp_replace(token, '[^a-z0-9]+', '', 'g') <> '' AND len(list_filter(names, lambda x: contains(x, regexp_replace(token, '[^a-z0-9]+', '', 'g')))) > 0 AS ml FROM a, v) SELECT token, CAST(n AS BIGINT) AS count, dl AS dominant_label, r6(pu) AS purity, ml AS matched_label, r6(least(1.0, pu + CASE WHEN ml THEN 0.2 ELSE 0 END)) AS risk FROM m WHERE pu >= 0.9 OR ml"))
_PROXY = "WITH c AS ({cells}), n AS (SELECT column_name, value, l, count(*) AS n FROM c GROUP BY 1, 2, 3), v AS (SELECT column_name, value, sum(n) AS r, max(n) AS m FROM n GROUP BY 1, 2), p AS (SELECT column_name, count(*) AS u, sum(m) / sum(r) AS p FROM v GROUP BY 1) SELECT column_name, u AS unique_count, r6(p) AS purity, " + _RISK.format(x="p") + " AS risk_level FROM p WHERE p >= {t}"
add("lk05_categorical_proxies", lambda s, d: rounded(leakage.categorical_proxies(T(s, d, "part").withColumn("maker", F.substring("p_brand", 1, 7)), ["p_brand", "p_type", "p_size"], "maker", eda.Thresholds(proxy_purity=0.1))), _r(_PROXY.format(t=0.1, cells="SELECT 'p_brand' AS column_name, p_brand AS value, substr(p_brand, 1, 7) AS l FROM part UNION ALL SELECT 'p_type', p_type, substr(p_brand, 1, 7) FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), substr(p_brand, 1, 7) FROM part WHERE (SELECT count(DISTINCT p_size) FROM part) <= 30")))
_DEC = "SELECT 'value' AS column_name, greatest(1, ((rn - 1) * 10 + n - 2) // greatest(n - 1, 1)) AS value, l FROM (SELECT label AS l, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM m_events)"
add("lk06_numeric_proxies", lambda s, d: rounded(leakage.numeric_proxies(V.m_events(s, d), ["value"], "label", "event_id", eda.Thresholds(numeric_proxy_purity=0.1))), _r(_PROXY.format(t=0.1, cells=_DEC)))
add("lk07_interval_overlap", lambda s, d: rounded(leakage.interval_overlap(V.m_orders(s, d), "label", "o_orderdate", "o_orderdate")), _r("WITH s AS (SELECT label AS s, min(epoch_us(o_orderdate) / 1e6) AS lo, max(epoch_us(o_orderdate) / 1e6) AS hi FROM m_orders GROUP BY 1), p AS (SELECT a.s AS split_a, b.s AS split_b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS o, greatest(a.hi, b.hi) - least(a.lo, b.lo) AS u FROM s a JOIN s b ON a.s < b.s) SELECT split_a, split_b, r6(o) AS overlap, r6(o / u) AS overlap_ratio, r6(round(least(1.0, o / u * 1.5), 3)) AS severity_score FROM p WHERE o > 0"))
add("lk08_sequence_overlap", lambda s, d: rounded(leakage.split_overlap(V.m_orders(s, d), "o_custkey", "split")), _r(_OVER.format(e="o_custkey", v="m_orders")))
add("lk09_normalization_leak", lambda s, d: rounded(leakage.normalization_leak(V.m_lineitem(s, d), ["z", "l_extendedprice"], "split"), 5), _r("WITH g AS (SELECT avg(z) AS m, stddev_samp(z) AS sd FROM m_lineitem), p AS (SELECT max(abs(a)) AS mx FROM (SELECT split, avg(z) AS a FROM m_lineitem GROUP BY 1)) SELECT 'z' AS column_name, r6(m) AS global_mean, r6(sd) AS global_std, r6(mx) AS max_split_mean FROM g, p WHERE mx >= 0.2").replace(", 6)", ", 5)"))
add("lk10_split_interleaving", lambda s, d: rounded(leakage.split_interleaving(V.m_docs(s, d), "n_chars", "split", "doc_id")), _r("WITH o AS (SELECT split, lag(split) OVER (ORDER BY n_chars, doc_id) AS p FROM m_docs), r AS (SELECT count(*) AS n, count_if(p <> split) + 1 AS k, count(DISTINCT split) AS c FROM o) SELECT n AS row_count, CAST(k AS BIGINT) AS run_count, c AS split_count, k > c AS interleaved, r6(CASE WHEN k > c THEN 0.8 ELSE 0 END) AS severity_score FROM r"))
add("lk11_boundary_gaps", lambda s, d: rounded(leakage.boundary_gaps(V.m_orders(s, d), "o_orderdate", "split")), _r("WITH t AS (SELECT DISTINCT split AS s, epoch_us(o_orderdate) / 1e6 AS t FROM m_orders), d AS (SELECT t - lag(t) OVER (PARTITION BY s ORDER BY t) AS d FROM t), m AS (SELECT quantile_cont(d, 0.5) AS step FROM d WHERE d > 0), e AS (SELECT s, min(t) AS lo, max(t) AS hi, CASE s WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS k FROM t GROUP BY 1), p AS (SELECT s, hi, lead(s) OVER (ORDER BY k) AS n, lead(lo) OVER (ORDER BY k) AS nlo FROM e) SELECT s AS split_a, n AS split_b, r6(nlo - hi) AS gap, r6((nlo - hi) / step) AS gap_steps, r6(CASE WHEN (nlo - hi) / step < 1 THEN round(least(1, greatest(0, 1 - (nlo - hi) / step)), 3) ELSE 0 END) AS severity_score FROM p, m WHERE n IS NOT NULL"))
_SEAS = "WITH r AS (SELECT split AS s, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS e FROM m_orders), c AS (SELECT s, e, count(*) AS n FROM r GROUP BY 1, 2), g AS (SELECT s, e FROM (SELECT DISTINCT s FROM r), (SELECT unnest(['winter', 'spring', 'summer', 'autumn']) AS e)), p AS (SELECT g.s, g.e, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.s) AS p FROM g LEFT JOIN c ON g.s = c.s AND g.e = c.e), j AS (SELECT a.s, a.e, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM p a JOIN p b ON a.e = b.e AND b.s = 'train' WHERE a.s <> 'train'), k AS (SELECT s, sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2 / ln(2) AS js, max_by(e, (p, e)) AS dom FROM j GROUP BY 1) SELECT 'train' AS reference_split, s AS split, r6(js) AS js_divergence, dom AS dominant_season, js >= 0.1 AS shifted FROM k"
add("lk12_seasonal_shift", lambda s, d: rounded(leakage.seasonal_shift(V.m_orders(s, d), "o_orderdate", "split")), _r(_SEAS))
add("lk13_missing_group_keys", lambda s, d: rounded(leakage.missing_group_keys(V.m_docs(s, d), ["label", "source"])), _r("SELECT 'label' AS column_name, count(*) - count(label) AS missing_count, r6((count(*) - count(label)) / count(*)) AS missing_rate, CASE WHEN (count(*) - count(label)) / count(*) >= 0.85 THEN 'high' WHEN (count(*) - count(label)) / count(*) >= 0.55 THEN 'medium' ELSE 'low' END AS risk_level FROM m_docs HAVING (count(*) - count(label)) / count(*) >= 0.2"))
add("lk14_overall_risk", lambda s, d: rounded(leakage.overall_risk(leakage.duplicates(T(s, d, "documents"), ["text"]).select("severity_score").unionByName(leakage.split_overlap(V.m_events(s, d), "user_id", "split").select("severity_score")))), _r("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT round(least(1.0, (sum(n) - count(*)) / sum(n) * 3), 3) AS x FROM g), e AS (SELECT user_id, count(DISTINCT split) AS n FROM m_events GROUP BY 1), b AS (SELECT round(least(1.0, count_if(n > 1) / count(*) * 2.5), 3) AS x FROM e), s AS (SELECT x FROM a UNION ALL SELECT x FROM b), o AS (SELECT CASE WHEN max(x) = 0 THEN 0 ELSE greatest(max(x), least(avg(x) + 0.1, 1.0)) END AS v FROM s) SELECT r6(v) AS overall_severity_score, " + _RISK.format(x="v") + " AS overall_risk_level FROM o"))


def _report(s: SparkSession, d: str) -> DataFrame:
    report = leakage.build_report(V.m_docs(s, d), "path", "label", "split", ["source"], row_id="doc_id")
    return s.createDataFrame([(c["risk_type"], float(c["severity_score"]), c["risk_level"]) for c in report["checks"]], "risk_type string, severity_score double, risk_level string")


add("lk16_report", _report)
