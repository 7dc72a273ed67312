"""Okapi BM25 over documents as four tables: postings, blocks of postings, terms and one row of totals.

A block holds a term's postings of one level: about as many uses of the term in about as long documents. It knows the most and
fewest uses and the least and greatest length, so its impacts are bounded whatever the mean length will be, and blocks of
several indexes add up. A search for the best documents leaves out the blocks that cannot hold one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tabletrail import settings
from tabletrail.functions.joins import lookup_join, top_per_group
from tabletrail.functions.text import tokens
from tabletrail.functions.word_batches import word_columns, words_of_batch
from tabletrail.sources.scratch import written


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # term, chunk_id, tf, dl, level [, bucket]
    blocks: DataFrame  # term, level, n, uses, tf, dl, low_tf, high_dl, bucket: postings of a level, their uses, bounds of tf and dl
    terms: DataFrame  # term, df, idf, bucket
    totals: DataFrame  # documents, avgdl, avg_idf: one row
    buckets: int = settings.STORE_BUCKETS  # that postings and terms are laid out in


def bucket_of(key: str | Column, buckets: int = settings.STORE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def level_of(tf: Column, dl: Column) -> Column:
    """Postings of a level differ by less than two in their uses, and by less than a half in their documents' lengths."""
    return (F.ceil(F.log2(tf)) * 64 + F.floor(2 * F.log2(dl))).cast("int")


def postings_of(documents: DataFrame, text: str = "embedding_text", key: str = "chunk_id") -> DataFrame:
    """(term, key, tf, dl, level) rows. A document's words are counted where its row lies; nothing is moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, words, rows in words_of_batch(batch.column(1), batch.column(2)):
                if not len(rows):
                    continue
                terms = len(words.dictionary)
                found, tf = np.unique(rows * terms + words.indices.to_numpy(), return_counts=True)
                row = found // terms
                columns = [
                    words.dictionary.take(pa.array(found % terms)), batch.column(0).take(pa.array(row + first)),
                    pa.array(tf.astype(np.int32)), pa.array(np.bincount(rows, minlength=n)[row].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["term", key, "tf", "dl"])

    kind = documents.schema[key].dataType
    schema = StructType([StructField("term", StringType()), StructField(key, kind), StructField("tf", IntegerType()), StructField("dl", IntegerType())])
    counted = documents.select(key, *word_columns(text)).mapInArrow(count, schema)
    return counted.withColumn("level", level_of(F.col("tf"), F.col("dl")))


def postings_of_terms(postings: DataFrame, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The postings of the given (term) rows, whole; the terms go to the postings, unless they are too many for that."""
    return lookup_join(postings, terms.distinct(), ["term"], spread_by=key, how="left_semi")


def build_index(documents: DataFrame, text: str = "embedding_text", key: str = "chunk_id", buckets: int = settings.STORE_BUCKETS) -> Bm25Index:
    postings = postings_of(documents, text, key).withColumn("bucket", bucket_of("term", buckets))
    return index_from(postings, documents.count(), buckets)


def blocks_of(postings: DataFrame, buckets: int = settings.STORE_BUCKETS) -> DataFrame:
    """The blocks of postings; one aggregation by term and level."""
    counted = postings.groupBy("term", "level").agg(
        F.count("*").alias("n"), F.sum("tf").alias("uses"), F.max("tf").alias("tf"), F.min("dl").alias("dl"),
        F.min("tf").alias("low_tf"), F.max("dl").alias("high_dl"),
    )
    return counted.withColumn("bucket", bucket_of("term", buckets))


def index_from(
    postings: DataFrame, documents: int, buckets: int = settings.STORE_BUCKETS, keep: Callable[[DataFrame], DataFrame] = lambda blocks: blocks
) -> Bm25Index:
    """Blocks, terms and totals of the postings of so many documents. The postings are read once, for their blocks, which `keep`
    may store; what else is needed comes from those."""
    blocks = keep(blocks_of(postings, buckets))
    return index_of(postings, blocks, totals_of(blocks, documents), buckets)


def _weights(blocks: DataFrame, documents: int | Column) -> DataFrame:
    """(bucket, term, df, _uses, _raw). Blocks may be those of several indexes, and count down what was taken out."""
    counts = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("uses").alias("_uses")).where("df > 0")
    return counts.withColumn("_raw", F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))


def totals_of(blocks: DataFrame, documents: int) -> DataFrame:
    mean, uses = _weights(blocks, F.lit(documents)).agg(F.avg("_raw"), F.sum("_uses")).first()
    avgdl = (uses or 0) / documents if documents else None
    return blocks.sparkSession.createDataFrame([(documents, avgdl, mean)], "documents long, avgdl double, avg_idf double")


def index_of(postings: DataFrame, blocks: DataFrame, totals: DataFrame, buckets: int = settings.STORE_BUCKETS) -> Bm25Index:
    """The index with the weights of its terms. A term in more than half of all documents would weigh less than nothing; it gets
    a share of the mean weight."""
    documents, mean = totals.select("documents", "avg_idf").first()
    floor = settings.BM25_EPSILON * (mean or 0.0)
    weight = F.when(F.col("_raw") < 0, F.lit(floor)).otherwise(F.col("_raw"))
    terms = _weights(blocks, F.lit(documents)).select("term", "df", weight.alias("idf"), "bucket")
    return Bm25Index(postings, blocks, terms, totals, buckets)


def query_words(texts: DataFrame, column: str = "term") -> DataFrame:
    """(query, term, times) of (query, text) rows; a word given twice counts twice."""
    words = texts.select("query", F.explode_outer(tokens(F.col(column))).alias("term"))
    return words.where("term IS NOT NULL").groupBy("query", "term").agg(F.count("*").alias("times"))


def _share(index: Bm25Index, tf: str, dl: str) -> Column:
    """What a posting has of its term's weight; more with more uses, less in a longer document."""
    k1, b = settings.BM25_K1, settings.BM25_B
    length = F.col(dl) / index.totals.select("avgdl").scalar()
    return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * length))


@dataclass(frozen=True)
class Asked:
    """The words of a batch of queries as the index knows them, and its buckets that hold them."""

    words: DataFrame  # bucket, term, query, weight
    read: Column


def ask(index: Bm25Index, words: DataFrame) -> Asked:
    """Stored postings, blocks and terms lie in term buckets: the buckets of the asked words, as many numbers as there are buckets
    at most, are looked up first and only those are read."""
    words = words.withColumn("bucket", bucket_of("term", index.buckets))
    read = F.col("bucket").isin([row["bucket"] for row in words.select("bucket").distinct().collect()])
    known = words.join(index.terms.where(read), ["bucket", "term"])
    return Asked(known.select("bucket", "term", "query", (F.col("times") * F.col("idf")).alias("weight")), read)


def scores(index: Bm25Index, words: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query, key, score) for all documents that hold at least one of the query's words; the words pick their postings by an
    equi-join."""
    asked = ask(index, words)
    found = lookup_join(index.postings.where(asked.read), asked.words, ["bucket", "term"], spread_by=key)
    return found.groupBy("query", key).agg(F.sum(F.col("weight") * _share(index, "tf", "dl")).alias("score"))


def scores_of(index: Bm25Index, asked: Asked, pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query, key, score) for the given (query, key) rows, as far as they hold one of the query's words. The rows, some per
    query, go to the postings; only their postings are scored."""
    found = lookup_join(index.postings.where(asked.read), pairs.select("query", key), [key], spread_by="term")
    found = found.join(asked.words, ["bucket", "term", "query"])
    return found.groupBy("query", key).agg(F.sum(F.col("weight") * _share(index, "tf", "dl")).alias("score"))


def bounds(index: Bm25Index, asked: Asked) -> DataFrame:
    """(bucket, term, query, weight, level, n, low, bound, own, all): what a posting of each block makes at least and at most, its
    term at most, and all the query's terms together. A weight below zero counts as zero here: a document need not hold its word."""
    blocks = index.blocks.where(asked.read).groupBy("bucket", "term", "level").agg(
        F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.min("low_tf").alias("low_tf"), F.max("high_dl").alias("high_dl")
    )
    rows = asked.words.join(blocks.where("n > 0"), ["bucket", "term"])
    rows = rows.withColumn("bound", F.greatest(F.col("weight") * _share(index, "tf", "dl"), F.lit(0.0)))
    rows = rows.withColumn("low", F.col("weight") * _share(index, "low_tf", "high_dl")).drop("tf", "dl", "low_tf", "high_dl")
    own = rows.groupBy("query", "term").agg(F.max("bound").alias("own"))
    return rows.join(own, ["query", "term"]).join(own.groupBy("query").agg(F.sum("own").alias("all")), "query")


def thresholds(bounded: DataFrame, k: int) -> DataFrame:
    """(query, threshold): a score that at least k documents reach, for queries with a word in so many; from the blocks alone.

    The k documents are those of one word's blocks of greatest impact, whatever other words they hold besides.
    """
    best = Window.partitionBy("query", "term").orderBy(F.desc("low"), "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = bounded.withColumn("held", F.sum("n").over(best)).where(F.col("held") >= k).groupBy("query").agg(F.max("low").alias("low"))
    words = bounded.groupBy("query", "term").agg(F.max("weight").alias("weight"))
    loss = words.groupBy("query").agg((F.sum(F.least("weight", F.lit(0.0))) * (settings.BM25_K1 + 1)).alias("loss"))
    # Sums that differ only in the order of addition must not drop a tie.
    return reached.join(loss, "query").select("query", (F.col("low") + F.col("loss") - 1e-6).alias("threshold"))


def essential(bounded: DataFrame, least_scores: DataFrame) -> DataFrame:
    """(bucket, term, query, weight, need, rest, least, postings): the words whose postings are scored to find what reaches a
    query's threshold `least`, and how many postings that are at most.

    `need` is what a posting must make itself if the other words add all they can; blocks whose bound is below it are left out. A query's
    words of least impact that stay below the threshold together are not essential: a document must hold one of the others. If
    that spares most of the query's postings they are left out too, and `rest` is what they can add; otherwise it is 0 and
    the sums over the words given here are whole. No threshold: all postings count.
    """
    words = bounded.groupBy("bucket", "term", "query").agg(*(F.max(c).alias(c) for c in ("weight", "own", "all")))
    small = Window.partitionBy("query").orderBy("own", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("below", F.sum("own").over(small)).join(least_scores, "query", "left")
    least = F.coalesce("threshold", F.lit(float("-inf")))
    words = words.select("bucket", "term", "query", "weight", "below", least.alias("least"), (least - F.col("all") + F.col("own")).alias("need"))
    kept = bounded.select("query", "term", "n", "bound").join(words.select("query", "term", "need"), ["query", "term"]).where("bound >= need")
    words = words.join(kept.groupBy("query", "term").agg(F.sum("n").alias("postings")), ["query", "term"])
    query = Window.partitionBy("query")
    needed = F.sum(F.when(F.col("below") >= F.col("least"), F.col("postings"))).over(query)
    spared = settings.SPARED_POSTINGS * F.coalesce(needed, F.lit(0)) <= F.sum("postings").over(query)
    unread = F.max(F.when(F.col("below") < F.col("least"), F.col("below"))).over(query)
    words = words.withColumn("spared", spared).withColumn("rest", F.when(F.col("spared"), F.coalesce(unread, F.lit(0.0))).otherwise(0.0))
    return words.where("not spared or below >= least").select("bucket", "term", "query", "weight", "need", "rest", "least", "postings")


def top_scores(index: Bm25Index, words: DataFrame, k: int, key: str = "chunk_id", asked: Asked | None = None) -> DataFrame:
    """(query, key, score, rank): the k best documents of each query, the same as the k best of `scores`; ties by key.

    1. The blocks give each query a threshold that its k best reach.
    2. Postings that can bring a document up to the threshold are scored; documents that stay below it go.
    3. Where words were spared for that, the documents left are looked up and scored in full.
    """
    asked = asked or ask(index, words)
    asked = Asked(written(asked.words, "asked_words"), asked.read)
    bounded = written(bounds(index, asked), "bounds")
    postings = index.postings.where(asked.read).select("bucket", "term", key, "tf", "dl")
    score = F.col("weight") * _share(index, "tf", "dl")
    chosen = written(essential(bounded, thresholds(bounded, k)), "essential")

    def parts(words: DataFrame) -> DataFrame:
        found = lookup_join(postings, words, ["bucket", "term"], spread_by=key)
        found = found.withColumn("_part", score).where(F.greatest("_part", F.lit(0.0)) >= F.col("need"))
        sums = found.groupBy("query", key).agg(F.sum("_part").alias("score"), F.max(F.col("least") - F.col("rest")).alias("_least"))
        return sums.where("score >= _least").drop("_least")

    full, spared = parts(chosen.where("rest = 0")), chosen.where("rest > 0")
    if not spared.isEmpty():
        full = full.unionByName(scores_of(index, asked, written(parts(spared).select("query", key), "alive"), key))
    full = full.withColumn("_shown", F.round("score", 8))
    return top_per_group(full, ["query"], [F.desc("_shown"), F.asc(key)], k).drop("_shown")


def normalised(scored: DataFrame, key: str = "chunk_id", cut: float = settings.BM25_CUT) -> DataFrame:
    """Scores divided by the query's best one; what stays at or below the cut is dropped. The best scores are a row per query and
    go to the scores, which are not moved, unless the queries are too many for that."""
    best = scored.groupBy("query").agg(F.max("score").alias("_best"))
    joined = lookup_join(scored, best, ["query"], spread_by=key)
    share = F.col("score") / F.when(F.col("_best") > 0, F.col("_best")).otherwise(1.0)
    return joined.select("query", key, share.alias("score")).where(F.col("score") > cut)
