"""From a batch of table names to ranked results over a stored index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.text import clean_query
from tabletrail.operators import search, vectors
from tabletrail.operators.bm25 import Bm25Index
from tabletrail.operators.registry import Registry, expand
from tabletrail.operators.rerank import rank_results
from tabletrail.sources import snapshots
from tabletrail.sources.scratch import written


@dataclass(frozen=True)
class StoredIndex:
    documents: DataFrame
    words: Bm25Index
    vectors: DataFrame
    registry: Registry
    model: vectors.TextModel


def open_index(spark: SparkSession, root: str) -> StoredIndex:
    model = snapshots.read_model(spark, root)
    return StoredIndex(
        snapshots.read_documents(spark, root),
        snapshots.read_index(spark, root),
        snapshots.read_vectors(spark, root, model),
        snapshots.read_registry(spark, root),
        model,
    )


def query_rows(spark: SparkSession, queries: list[str]) -> DataFrame:
    """Distinct cleaned (query) rows of what users typed."""
    typed = spark.createDataFrame([(q,) for q in queries], "query string")
    return typed.select(clean_query(F.col("query")).alias("query")).where("query <> ''").distinct()


def find(
    index: StoredIndex, queries: DataFrame, top_k: int = settings.TOP_K, candidates: int | None = None, **weights: float
) -> DataFrame:
    """Ranked hits with their documents, for every row of queries(query).

    candidates: how many chunks the vector searches give each query, twice `top_k` by default. A chunk beyond them gets no
    vector part in its score.
    """
    wanted = candidates or 2 * top_k
    expanded = expand(queries, index.registry)
    texts = search.semantic_texts(expanded)
    semantic = vectors.nearest(
        index.vectors, vectors.text_vectors(index.model, texts, "text").select("query", "embedding"), wanted
    )
    semantic = written(semantic, "semantic")
    tables = vectors.text_vectors(index.model, expanded.select("query", "canonical").distinct(), "canonical")
    named = written(vectors.with_table(index.vectors, tables, wanted), "named")
    words = search.word_evidence(index.words, search.search_words(expanded), semantic, named, top_k)
    ranked = search.fuse(semantic, named, words, top_k, **weights)
    return search.with_payload(ranked, index.documents, expanded, index.words.buckets)


def trace(
    index: StoredIndex, queries: DataFrame, judgements: DataFrame | None = None, top_k: int = settings.JUDGED_HITS, **options
) -> DataFrame:
    """The results a reader sees: hits judged when judgements are given, in hybrid order otherwise; options as in rank_results."""
    return rank_results(find(index, queries, top_k), judgements, **options)
