"""Metrics of the assets that a manifest refers to: inline texts, and files by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import exprs as X
from lodestone.functions.text import METRICS, text_metrics
from lodestone.sources import readers

from .eda import sample_rows
from .media import audio_files, available, video_info
from .skeleton import skeleton_metrics
from .stats import q


def modality_of(path) -> F.Column:
    e = X.extension(path)
    return F.when(e.isin(*C.TEXT_SUFFIXES), "text").when(e.isin(*C.AUDIO_SUFFIXES), "audio").when(e.isin(*C.VIDEO_SUFFIXES), "video").when(e == ".npz", "skeleton").otherwise("none")


def inline_text_metrics(df: DataFrame, text: str, row_id: str, label: str | None = None) -> DataFrame:
    out = text_metrics(df, text, label, (row_id,)).withColumnRenamed(row_id, "row_index")
    return out.select("row_index", F.lit(text).alias("source_column"), F.lit("inline_text").alias("source_type"), *[c for c in out.columns if c != "row_index"])


def file_metrics(df: DataFrame, path: str, row_id: str, root: str, rows: int | None = None) -> DataFrame:
    """A row per manifest row whose file exists below `root` (by relative path): metrics by suffix, errors as columns.

    `rows` bounds the sample (by seeded hash); by default all rows are read. Files meet their rows in a join on the path,
    and only the metrics return from the workers.
    """
    spark, base = df.sparkSession, root.rstrip("/") + "/"
    chosen = sample_rows(df, row_id, rows) if rows else df
    named = chosen.select(F.col(q(row_id)).alias("row_index"), F.lit(path).alias("source_column"), F.regexp_replace(F.col(q(path)), r"^(\./)+", "").alias("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    local = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", r"\."), "")
    files = files.select(local.alias("path"), "content").withColumn("kind", modality_of(F.col("path")))

    def of(kind: str) -> DataFrame:
        return files.where(F.col("kind") == kind)

    plain = of("text").select("path", F.decode("content", "UTF-8").alias("raw"))
    json_ = readers.json_text(plain.where(F.col("path").rlike(r"(?i)\.json$")), "raw")
    lines = readers.json_text(plain.where(F.col("path").rlike(r"(?i)\.jsonl$")), "raw", lines=True)
    other = plain.where(~F.col("path").rlike(r"(?i)\.jsonl?$")).withColumn("text", F.col("raw"))
    texts = text_metrics(json_.unionByName(lines).unionByName(other), "text", keep=("path",)).withColumn("source_type", F.lit("text"))
    poses = readers.read_skeletons(spark, root).withColumn("path", local)
    poses = skeleton_metrics(poses, ("path", "skeleton_error")).withColumn("source_type", F.lit("skeleton"))
    sounds = audio_files(of("audio")).withColumn("source_type", F.lit("audio"))
    videos = video_info(of("video")).withColumn("source_type", F.lit("video"))
    return named.join(readers.union_assets(texts, poses, sounds, videos), "path")


def status(df: DataFrame | None) -> dict:
    """Whether asset metrics were made, and which helpers are there."""
    state = "not_attempted" if df is None else "ok" if not df.isEmpty() else "not_available"
    return {"status": state, **{f"{k}_helpers_available": v for k, v in available().items()}, "derived_columns": [] if df is None else [c for c in df.columns if c not in ("row_index", "path")]}


__all__ = ["METRICS", "file_metrics", "inline_text_metrics", "modality_of", "status"]
