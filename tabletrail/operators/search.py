"""Three kinds of evidence, one ranked list per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.joins import lookup_join, top_per_group
from tabletrail.operators import bm25
from tabletrail.sources.scratch import written


def semantic_texts(expanded: DataFrame) -> DataFrame:
    """(query, canonical, text): what is embedded to find chunks that are about the table."""
    return expanded.select("query", "canonical").distinct().withColumn(
        "text", F.concat("query", F.lit(" "), "canonical", F.lit(" table references"))
    )


def search_words(expanded: DataFrame) -> DataFrame:
    """(query, term, times) over the query itself, its table and all names of the table, each taken once."""
    names = expanded.select("query", F.explode(F.array(F.lower("query"), "canonical", "alias")).alias("term"))
    return bm25.query_words(names.distinct())


def word_evidence(
    index: bm25.Bm25Index, words: DataFrame, semantic: DataFrame, named: DataFrame, top_k: int = settings.TOP_K, cut: float = settings.BM25_CUT
) -> DataFrame:
    """(query, chunk_id, score): of the normalised BM25 scores those that can reach a query's first `top_k` hits.

    A chunk of one of the two vector lists can, wherever it ranks by its words: those are looked up. Any other chunk's place is that
    of its words alone, so only the best `top_k` besides the lists' chunks can. Weights must not be below zero; a weight of zero
    for the words lets chunks found by words alone in as they rank by words.
    """
    listed = written(semantic.select("query", "chunk_id").union(named.select("query", "chunk_id")).distinct(), "listed")
    most = listed.groupBy("query").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    asked = bm25.ask(index, words)
    best = written(bm25.top_scores(index, words, top_k + most, asked=asked), "best_words")
    first = best.where("rank = 1").select("query", F.col("score").alias("_best"))
    looked_up = bm25.scores_of(index, asked, listed.join(best, ["query", "chunk_id"], "left_anti"))
    rows = lookup_join(best.select("query", "chunk_id", "score").unionByName(looked_up), first, ["query"], "chunk_id")
    share = F.col("score") / F.when(F.col("_best") > 0, F.col("_best")).otherwise(1.0)
    return rows.select("query", "chunk_id", share.alias("score")).where(F.col("score") > cut)


def fuse(
    semantic: DataFrame,
    named: DataFrame,
    words: DataFrame,
    top_k: int = settings.TOP_K,
    semantic_weight: float = settings.SEMANTIC_WEIGHT,
    bm25_weight: float = settings.BM25_WEIGHT,
    table_weight: float = settings.TABLE_WEIGHT,
) -> DataFrame:
    """(query, chunk_id, hybrid_score, rank) from (query, chunk_id, score) frames; ties go to the smaller chunk_id.

    A chunk found by several kinds gets the sum of its weighted parts: one union and one aggregation.
    """
    parts = (
        semantic.select("query", "chunk_id", (F.col("score") * semantic_weight).alias("part"))
        .unionByName(named.select("query", "chunk_id", F.lit(float(table_weight)).alias("part")))
        .unionByName(words.select("query", "chunk_id", (F.col("score") * bm25_weight).alias("part")))
    )
    # Sums that differ only in the order of addition must tie.
    total = parts.groupBy("query", "chunk_id").agg(F.round(F.sum("part"), 10).alias("_score"))
    ranked = top_per_group(total, ["query"], [F.desc("_score"), F.asc("chunk_id")], top_k)
    return ranked.select("query", "rank", "chunk_id", F.round("_score", 4).alias("hybrid_score"))


def with_payload(ranked: DataFrame, documents: DataFrame, expanded: DataFrame, buckets: int = settings.STORE_BUCKETS) -> DataFrame:
    """Ranked chunks with their document, and the table and names each query stood for.

    Texts join after the cut. The ranked rows, a few per query, are stored first, so the ranking runs once and its
    size is known: they go to the documents, not the documents to them. Of documents laid out in buckets only those
    of the ranked chunks are read.
    """
    names = expanded.groupBy("query", F.col("canonical").alias("matched_canonical")).agg(
        F.sort_array(F.collect_set("alias")).alias("matched_aliases")
    )
    ranked = written(ranked, "ranked")
    if "bucket" in documents.columns:
        read = [row[0] for row in ranked.select(bm25.bucket_of("chunk_id", buckets)).distinct().collect()]
        documents = documents.where(F.col("bucket").isin(read)).drop("bucket")
    return lookup_join(documents, ranked, ["chunk_id"], "chunk_id").join(names, "query")
