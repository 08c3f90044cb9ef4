"""A corpus from raw documents to packed sequences: quality rules, near-duplicate join, secret scans, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, quality, secrets
from lodestone.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules or the calibrated forest reject."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of documents that share 80 % of their five-word shingles."""
    return jaccard.keep_one(docs, n=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark and recounts n_chars."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them: a row per whole repetition, and one with the first words of a document
    that is taken in part; documents that aren't taken go."""
    into = "mix" + "_" * max((len(c) for c in docs.columns), default=0)  # longer than any column's name
    mixed = mixing.mix(docs, into=into)
    size, taken = F.col(f"{into}.size"), F.col(f"{into}.taken")
    part = F.when(size > 0, taken % size).otherwise(F.lit(0)).cast("int")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn(f"{into}_words", F.explode(copies))
    words = F.col(f"{into}_words")
    # What follows the words that are taken, and the blanks before it, go; the text before stays as it is.
    blank = r"[\x20\x09-\x0D]"
    pieces = F.split("text", f"{blank}+", words + 1 + F.col("text").rlike(f"^{blank}").cast("int"))
    head = F.rtrim(F.substring("text", F.lit(1), F.length("text") - F.length(F.element_at(pieces, -1))), F.lit(" \t\n\x0b\x0c\r"))
    cut = F.when(words > 0, head).otherwise(F.col("text"))
    rows = rows.withColumn("text", cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(words > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("packing", packing_stage),
]

#: The forest, the field and the tokenizer can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
