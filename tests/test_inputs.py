"""What the catalog stores between the given tables and its queries."""

import pytest
from pyspark.sql import functions as F

from catalog import inputs as I
from tabletrail.operators import bm25, search
from tabletrail.operators.documents import build_documents


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, i * 7 % 100) for i in range(90)] + [(5, 35), (7, None)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    return path


def test_documents_are_stored_without_the_woven_text(spark, sf):
    docs = I.documents(spark, sf)
    folder = docs.inputFiles()[0].rsplit("/", 1)[0]
    assert "embedding_text" not in spark.read.parquet(folder).columns and "=" not in folder.rsplit("/", 1)[1]
    plain = build_documents(I.aliased(spark, sf))
    assert docs.columns == plain.columns
    key = lambda rows: sorted(map(repr, rows.collect()))
    assert key(docs) == key(plain)


def test_index_keeps_the_postings_of_asked_words_and_scores_as_one_of_all(spark, sf):
    index, docs = I.index(spark, sf), I.documents(spark, sf)
    words = search.search_words(I.expanded(spark, sf))
    asked = {r["term"] for r in words.select("term").collect()}
    assert {r["term"] for r in index.postings.select("term").distinct().collect()} <= asked
    shown = lambda i: sorted(bm25.scores(i, words).select("query", "chunk_id", F.round("score", 6)).collect())
    assert shown(index) == shown(bm25.build_index(docs)) != []
