"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

Items and documents are sets of five-word shingles (a text of fewer words is one shingle; without words, none). Items are
partitioned by size: class c holds those of 2**c .. 2**(c+1)-1 shingles. For a class, a document is cut into windows of two
chunks of 2**(c+1) shingles, each chunk in two windows, so an item and the window around it are of like size, and a
containment of `CONTAINMENT` means a Jaccard similarity of about 0.19 or more, however long the document is. One of `HASHES`
minima then agrees with probability 1 - 1.4e-6 at that similarity (with two adjacent windows, more).

A task keeps the minima that may be an item's, by a Bloom filter of the items' minima, and, for documents that have any, those
of their shingles that may be an item's, by a second one. Both filters have at most `FILTER_BITS` bits; beyond what they
hold well they only let more through. Joins on the full keys find the candidates, and shingles counted over the whole
document confirm them exactly. No text is shuffled. Rows with equal doc_id count as one document; equal items stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrail.llm.tasks import by_batch, dealt
from tabletrail.llm.words import Shingles, mix, shingles_of, slices, words_of
from tabletrail.sources.scratch import written

CONTAINMENT = 0.8
HASHES = 64
FILTER_BITS = 1 << 28
PROBES = 3
BLOCK_WORDS = 1 << 16

_FACTOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = mix(np.arange(1000, 1000 + HASHES * 64, dtype=np.uint64)).reshape(64, HASHES)


def size_class(n: int) -> int:
    return int(n).bit_length() - 1


class Filter:
    """A Bloom filter; `words` are 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        return [mix(keys + np.uint64(p * 0x51ED2701)) & np.uint64(bits - 1) for p in range(PROBES)]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in range(PROBES):
            at = mix(keys[found] + np.uint64(p * 0x51ED2701)) & self.bits
            found[np.flatnonzero(found)] = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def build_filter(keys: DataFrame, column: str, rows: int) -> Filter:
    """Bits are set in tasks and joined by word, and words to blocks of bytes there: the driver gets those, as many bytes as the
    filter has, and never a row for each word."""
    bits = min(FILTER_BITS, 1 << max(16, (64 * max(rows, 1) - 1).bit_length()))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = np.asarray(batch.column(0)).view(np.uint64)
        at = np.unique(np.concatenate(Filter.spots(key, bits)))
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    def block(table: pa.Table) -> pa.Table:
        own = np.zeros(size, np.int64)
        own[np.asarray(table["word"]) % size] = np.asarray(table["bit"])
        return pa.table({"block": table["block"].slice(0, 1), "data": pa.array([own.tobytes()], pa.binary())})

    size = min(BLOCK_WORDS, bits // 64)
    set_bits = by_batch(keys.select(column), work, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    blocks = set_bits.withColumn("block", F.floor(F.col("word") / size).cast("int")).groupBy("block").applyInArrow(block, "block int, data binary")
    words = np.zeros(bits // 64, np.uint64)
    for row in blocks.collect():
        words[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["data"], np.uint64)
    return Filter(words)


def minima(found: Shingles, classes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, hash number, minima of windows, texts of the windows). Chunks of the smallest class are reduced once per hash;
    larger ones from those."""
    n = np.diff(found.first)
    if not len(found.hashes):
        return
    small = 2 << classes[0]
    chunks = -(-n // small)
    text = np.repeat(np.arange(len(n)), chunks)
    place = np.arange(chunks.sum()) - np.repeat(np.concatenate([[0], np.cumsum(chunks)[:-1]]), chunks)
    starts = found.first[:-1][text] + place * small
    plans = []
    for c in classes:
        heads = np.flatnonzero(place % (1 << (c - classes[0])) == 0)
        owner = text[heads]
        pair = np.flatnonzero(owner[1:] == owner[:-1])  # a window of this and the next chunk
        counts = np.bincount(owner, minlength=len(n))
        lone = np.flatnonzero(counts[owner] == 1)
        plans.append((c, heads, pair, lone, np.concatenate([owner[pair], owner[lone]])))
    for h in range(HASHES):
        low = np.minimum.reduceat(found.hashes * _FACTOR[h], starts)
        for c, heads, pair, lone, owner in plans:
            chunk = low if c == classes[0] else np.minimum.reduceat(low, heads)
            yield c, h, np.concatenate([np.minimum(chunk[pair], chunk[pair + 1]), chunk[lone]]), owner


def _key(c: int, h: int, low: np.ndarray) -> np.ndarray:
    return mix(low ^ _SALT[c, h])


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One list per owner 0..n-1; `owner` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), _ints(values))


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, n_shingles, size_class, shingles, keys) of each item that has words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(1)):
            found = shingles_of(words_of(part))
            sets = [np.unique(found.hashes[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
            rows = [i for i, s in enumerate(sets) if len(s)]
            classes = [size_class(len(sets[i])) for i in rows]
            keys = [mix(np.array([(sets[i] * f).min() for f in _FACTOR]) ^ _SALT[c]) for i, c in zip(rows, classes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([part.first + i for i in rows], pa.int64())),
                    pa.array([len(sets[i]) for i in rows], pa.int64()),
                    pa.array(classes, pa.int32()),
                    pa.array([sets[i].view(np.int64) for i in rows], pa.list_(pa.int64())),
                    pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                ],
                names=["item_id", "n_shingles", "size_class", "shingles", "keys"],
            )

    schema = "item_id long, n_shingles long, size_class int, shingles array<long>, keys array<long>"
    return by_batch(items.selectExpr("cast(item_id as long) item_id", "text"), work, schema)


def _suspects(docs: DataFrame, classes: list[int], minima_filter: Filter, shingle_filter: Filter) -> DataFrame:
    """(doc_id, keys, shingles) of documents with a minimum that passes the filter: the keys and the shingles that pass."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((minima_filter.words, shingle_filter.words))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of_minima, of_shingles = map(Filter, sent.value)
        for part in slices(batch.column(1)):
            found = shingles_of(words_of(part))
            owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for c, h, low, owner in minima(found, classes):
                key = _key(c, h, low)
                hit = of_minima(key)
                owners.append(owner[hit])
                keys.append(key[hit])
            owner, key = np.concatenate(owners), np.concatenate(keys)
            if not len(owner):
                continue
            docs_hit = np.unique(owner)
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            first = np.ones(len(key), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            owner, key = np.searchsorted(docs_hit, owner[first]), key[first]
            sets = [np.unique(found.hashes[found.first[i] : found.first[i + 1]]) for i in docs_hit]
            sets = [s[of_shingles(s)] for s in sets]
            sizes = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs_hit + part.first)), _lists(key, owner, len(sets)), _lists(np.concatenate(sets), sizes, len(sets))],
                names=["doc_id", "keys", "shingles"],
            )

    return by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), work, "doc_id long, keys array<long>, shingles array<long>")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and item contained in it: doc_id, item_id, n_item_shingles, n_shared, containment."""
    spark: SparkSession = docs.sparkSession
    known = written(item_rows(items), "benchmark_items")
    classes = sorted(r[0] for r in known.select("size_class").distinct().collect())  # at most 64
    if not classes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")
    keys = known.select("item_id", F.explode("keys").alias("key"))
    shingles = known.select("item_id", "n_shingles", F.explode("shingles").alias("shingle"))
    total = known.agg(F.count("*"), F.sum("n_shingles")).collect()[0]
    suspects = written(
        _suspects(docs, classes, build_filter(keys, "key", total[0] * HASHES), build_filter(shingles, "shingle", total[1])), "benchmark_suspects"
    )
    pairs = suspects.select("doc_id", F.explode("keys").alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()
    held = suspects.select("doc_id", F.explode("shingles").alias("shingle")).distinct()
    shared = held.join(shingles, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_shingles").alias("n_item_shingles"))
    close = shared.where(F.col("n_shared") >= containment * F.col("n_item_shingles"))
    return close.join(pairs, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")
    )
