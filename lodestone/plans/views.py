"""Manifest views of the test tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.readers import BOXES, KEYPOINTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def m_docs(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").withColumnRenamed("doc_id", "_id")
    k = F.col("doc_id") % 10
    return (
        table(s, d, "documents").join(labels, F.col("doc_id") == F.col("_id"), "left")
        .select("doc_id", F.concat(F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("quality").alias("label"), F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"), "source", "lang", "n_chars", "text")
    )


def m_convs(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".json"))
    return table(s, d, "conversations").select("conv_id", "turn", path.alias("path"), F.col("role").alias("label"), "text")


def m_events(s: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), "train").when(F.col("ts") < F.lit("2024-01-26").cast("timestamp_ntz"), "val").otherwise("test")
    return table(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("label"), "value", "props", split.alias("split"))


def m_orders(s: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("label"), "o_totalprice", "o_orderdate", "o_orderpriority", F.when(y < 1999, "train").when(y < 2001, "val").otherwise("test").alias("split"))


def m_nulls(s: SparkSession, d: str) -> DataFrame:
    gone = F.col("event_id") % 7 == 0
    return table(s, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.when(~gone, F.col("value")).alias("value"), F.when(~gone, F.col("props")).alias("props"))


def m_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.col("url").alias("path"), F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("")).alias("label"))


def m_geo(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_nationkey", "n_regionkey", "c_acctbal")


def m_lineitem(s: SparkSession, d: str) -> DataFrame:
    """Quantities normalised over all rows, although those of the last split were shifted first."""
    y = F.year("l_shipdate")
    base = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(y < 1999, "train").otherwise("test").alias("split"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    shifted = base.withColumn("_q", F.col("l_quantity") + F.when(F.col("split") == "test", 8.0).otherwise(0.0))
    one = shifted.agg(F.avg("_q").alias("_m"), F.stddev_samp("_q").alias("_s"))
    return shifted.crossJoin(F.broadcast(one)).select("l_orderkey", "l_linenumber", "split", ((F.col("_q") - F.col("_m")) / F.col("_s")).alias("z"), "l_extendedprice")


def m_pose(s: SparkSession, d: str) -> DataFrame:
    clips = table(s, d, "embeddings").groupBy((F.col("vec_id") / 8).cast("long").alias("clip")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda v: v["embedding"])).alias("v"))
    v = F.col("v")
    value = lambda f, j, k: F.coalesce(F.get(v, f * 51 + j * 3 + k).cast("double"), F.lit(0.0))
    keypoints = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct(value(f, j, 0).alias("x"), value(f, j, 1).alias("y"), F.abs(value(f, j, 2)).alias("c"))))
    boxes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda f: F.struct(F.least(value(f, F.lit(0), 0), value(f, F.lit(1), 0)).alias("x1"), F.least(value(f, F.lit(0), 1), value(f, F.lit(1), 1)).alias("y1"), F.greatest(value(f, F.lit(0), 0), value(f, F.lit(1), 0)).alias("x2"), F.greatest(value(f, F.lit(0), 1), value(f, F.lit(1), 1)).alias("y2")))
    return clips.where(F.size("v") >= 510).select("clip", keypoints.cast(KEYPOINTS).alias("keypoints"), boxes.cast(BOXES).alias("boxes"), F.lit(25.0).alias("fps"), F.lit(4).alias("width"), F.lit(2).alias("height"))


SQL = {
    "m_docs": """SELECT d.doc_id, 'corpus/' || source || '/' || lang || '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, l.quality AS label,
        CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, source, lang, n_chars, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "m_convs": "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.json' AS path, role AS label, text FROM conversations",
    "m_events": """SELECT event_id, ts, user_id, event_type AS label, value, props, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'val' ELSE 'test' END AS split FROM events""",
    "m_orders": """SELECT o_orderkey, o_custkey, o_orderstatus AS label, o_totalprice, o_orderdate, o_orderpriority,
        CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) < 2001 THEN 'val' ELSE 'test' END AS split FROM orders""",
    "m_nulls": """SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 7 <> 0 THEN props END AS props FROM events""",
    "m_pages": """SELECT page_id, url AS path, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS label FROM pages""",
    "m_geo": "SELECT c_custkey, c_nationkey, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "m_lineitem": """SELECT l_orderkey, l_linenumber, split, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS z, l_extendedprice FROM (
        SELECT *, l_quantity + CASE WHEN split = 'test' THEN 8.0 ELSE 0.0 END AS q FROM (SELECT *, CASE WHEN year(l_shipdate) < 1999 THEN 'train' ELSE 'test' END AS split FROM lineitem))""",
    "m_pose": """SELECT clip, list_transform(range(0, 10), lambda f: list_transform(range(0, 17), lambda j: {'x': CAST(v[f * 51 + j * 3 + 1] AS DOUBLE), 'y': CAST(v[f * 51 + j * 3 + 2] AS DOUBLE), 'c': abs(CAST(v[f * 51 + j * 3 + 3] AS DOUBLE))})) AS k
        FROM (SELECT vec_id // 8 AS clip, flatten(list(embedding ORDER BY vec_id)) AS v FROM embeddings GROUP BY 1) WHERE len(v) >= 510""",
}


def sql(body: str) -> str:
    """A query with the views that it names before it."""
    used = [n for n in SQL if n in body]
    if not used:
        return body
    lead = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    return f"WITH {lead} {body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {lead}, {body.lstrip()[5:]}"
