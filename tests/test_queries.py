"""Every audit query against its SQL; those without SQL must give rows."""

import pytest
from oracle import same

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_texts_without_words(spark, tmp_path):
    rows = [(0, "two words"), (1, "... !"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.words, r["last"]) for r in registry.QUERIES["sc16_words"](spark, str(tmp_path)).collect()}
    assert found == {0: (2, "words"), 1: (0, None), 2: (0, None), 3: (None, None)}
