"""The stages of the corpus pipeline: what each keeps and changes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mix string"
CLASHING = ("_key", "_row", "_kept", "_id", "node", "_text", "_caught", "_pieces", "key")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(80, 160))) for _ in range(30)]
    texts = clean + [clean[0], clean[1].replace(" ", "\n", 2), "short text", "spam " * 90, None, "", clean[2] + " password=abc123def456"]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else 0, "z") for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs.withColumns({c: F.lit(c) for c in CLASHING})
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mix", "packing"]
    columns, kept = docs.columns, docs
    kept = P.quality_stage(spark, docs, tables)
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == columns and not {32, 33, 34, 35} & set(ids) and set(range(30)) <= set(ids) and ids[5] == 2
    single = P.near_duplicate_stage(spark, kept, tables)
    ids = collections.Counter(r.doc_id for r in single.collect())
    assert single.columns == columns and max(ids.values()) == 1 and not {30, 31, 36} & set(ids) and set(range(30)) <= set(ids)
    secret = docs.where("doc_id in (0, 36)")
    red = {r.doc_id: r for r in P.secret_stage(spark, secret, tables).collect()}
    before = {r.doc_id: r for r in secret.collect()}
    assert red[0] == before[0] and "abc123" not in red[36].text and red[36].n_chars == len(red[36].text)
    mixed = P.mix_stage(spark, single, tables)
    assert mixed.columns == columns
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    own, taken = size(single), size(mixed)
    assert abs(sum(taken.values()) - 1.5 * sum(own.values())) <= 3 and all(taken[s] <= 2 * own[s] for s in own)
    packed = P.packing_stage(spark, mixed, tables)
    assert packed.groupBy("doc_id", "start").count().count() > 0 and packed.agg(F.max(F.col("offset") + F.col("length"))).head()[0] <= 2048


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c), (4, a), (None, text()), (None, c), (5, None), (6, "")]
    got = P.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([rows[0], rows[1], rows[3], rows[6], rows[8], rows[9]])


def test_cut_documents_keep_their_blanks(spark):
    rows = [(k, f"  a{k}\tb  c\n\nd {t} e", "s" if k else None, 3) for k, t in enumerate(["x " * 40] * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts = {r[0]: r[1] for r in rows}
    got = P.mix_stage(spark, docs, "").collect()
    cut = [r for r in got if r.text != texts[r.doc_id]]
    assert cut and all(texts[r.doc_id].startswith(r.text) and r.text == r.text.rstrip() and r.n_chars == len(r.text) for r in cut)
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * sum(len(t.split()) for t in texts.values())) <= 2


def test_run_agrees_with_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tables).cache()
    key = ["doc_id", "start", "length", "ids_crc32"]
    count = lambda df: collections.Counter(tuple(r) for r in df.select(*key).collect())
    assert count(P.run(spark, tables)) == count(docs)


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, tables).count() == 0
