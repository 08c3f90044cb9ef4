"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact_windows, jaccard, mixing, packing, quality, secrets, suffix_dedup, suffix_tree, warc, winnowing
from .common import materialize, read_table, text_of


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.words("text").alias("n_words")))
    return mixing.mix(sized, size="n_words").select("doc_id", "mix.*")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secrets.scan(docs, secrets.fit(docs)).drop("text")

    def joined(base_only: bool):
        chosen = F.filter("secret_spans", lambda s: s["kind"] != "crf") if base_only else F.col("secret_spans")
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(read_table(spark, sf_dir, "documents"))


def op7_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    forest = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, forest)


def op10_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_suffix_dedup, op3_pack, op4_jaccard, op5_secrets, op6_fingerprints, op7_near_passages, op8_warc, op9_quality, op10_score)}


ORACLE_SQL = {
    "op1_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
                     1.5 * sum(source_size) OVER () AS total FROM s),
        r AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM w),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM r),
        f AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS found FROM l),
        t AS (SELECT source, source_size, CAST(coalesce(least(cap, found * weight), cap) AS DOUBLE) AS target FROM f),
        c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        x AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, CAST(round(c.target) AS BIGINT) - c.whole * c.source_size AS rest,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
        SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
    """,
    "op4_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
        n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
        e AS (SELECT doc_id, unnest(s) AS x FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT n.doc_id, n.n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON n.doc_id = c.a
    """,
    "op8_warc": r"""
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f
    """,
}
