"""Ranked lexical search with pair-bound MaxScore over blocks of documents.

One pass over the texts makes blocks: for some thousands of documents the sorted postings (row, times) of every asked term,
and the documents' lengths. Nothing is shuffled for it; statistics are sums over the blocks. With them every posting has its
impact, the share of a document's score that it makes. A second pass intersects the lists of term pairs within each block and
stores, for each pair, the greatest joint impact, that is of one document holding both terms. The pairs are those of the
items: of an item's terms in the order of their weights, each two neighbours.

A pair's bound is the greatest of its joint maximum and its two terms' own maxima. It replaces the sum of the two maxima, which
no document may reach. What a set of terms can make together is bounded by the sum of the bounds of the pairs within it and of
the maxima of its other terms, never more than the sum of all maxima:

* blocks where all of an item's terms together stay below its threshold are skipped;
* of the other blocks, the terms of least maxima that stay below the threshold together make no candidates; the documents of the
  other terms are scored, and looked up in those lists from the greatest maximum on as long as their score and the bound of what
  is left reach the threshold.

The threshold is global: documents in the intersections have a lower bound for their score (their joint impacts), and the k-th
greatest of these over all blocks is one for the k-th score. Ties with the threshold are never skipped, so the ranking is exact.

Terms are told apart by a 64-bit hash. Items are worked off in passes of about MAX_TERMS terms, so what goes to every task is bounded
whatever the number of items.

Null and empty texts have no terms: as documents they count for nothing, as items they have no rows. Rows without doc_id count in
the statistics and are not ranked; rows that repeat a doc_id are documents of their own; rows that repeat an item_id are one item with
the terms of all. Without documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail.functions.joins import top_per_group
from tabletrail.llm.tasks import by_batch, dealt
from tabletrail.llm.words import LOWER, Slice, prefix_codes, slices, span_hashes
from tabletrail.sources.scratch import written

#: Documents of a block, at most 65,536 so that a row is two bytes; and postings of a block, about.
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 21
#: Terms of the items of one pass, about.
MAX_TERMS = 200_000

_IN_TERM = np.ones(256, bool)
_IN_TERM[:128] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _IN_TERM[_first : _last + 1] = True

BLOCKS = "docs binary, lengths binary, keys binary, ends binary, rows binary, times binary, n_docs long, n_terms long"


def _terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Key and text of each term of a slice, in order."""
    data = LOWER[part.data]
    inside = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return span_hashes(prefix_codes(data), starts, ends), np.searchsorted(part.offsets, starts, side="right") - 1


# --- Items -----------------------------------------------------------------------


@dataclass
class Item:
    """An item's terms as places in the asked keys, common ones first; neighbours two by two are its pairs."""

    item_id: int
    terms: list[int]

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in zip(self.terms[::2], self.terms[1::2], strict=False)]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, key), once each."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        for part in slices(batch.column(1)):
            keys, owner = _terms(part)
            found = pa.RecordBatch.from_arrays([pa.array(ids[part.first + owner]), pa.array(keys.view(np.int64))], names=["item_id", "key"])
            yield from pa.Table.from_batches([found]).group_by(["item_id", "key"]).aggregate([]).to_batches()

    rows = items.where("item_id is not null").selectExpr("cast(item_id as long) item_id", "text")
    return by_batch(rows, work, "item_id long, key long").distinct()


# --- Blocks ----------------------------------------------------------------------


def blocks(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """The postings of the asked keys (sorted) in blocks of documents, one row each, made where the texts are read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, places, times, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal held
            size, place, n = np.concatenate(lengths), np.concatenate(places), np.concatenate(times)
            order = np.argsort(place, kind="stable")
            place, n = place[order], n[order]
            term, first = np.unique(place // BLOCK_DOCS, return_index=True)
            columns = [
                np.concatenate(docs), size.astype(np.int64), asked[term], np.append(first, len(place))[1:].astype(np.int32),
                (place % BLOCK_DOCS).astype(np.uint16), n.astype(np.uint32),
            ]
            made = [pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])]
            for kept in (docs, lengths, places, times):
                kept.clear()
            held = 0
            return pa.RecordBatch.from_arrays(made, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])

        n_docs = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in slices(batch.column(1)):
                keys, owner = _terms(part)
                n = np.bincount(owner, minlength=len(part))
                at = np.minimum(np.searchsorted(asked, keys), max(len(asked) - 1, 0))
                hit = asked[at] == keys if len(asked) else np.zeros(len(keys), bool)
                owner, at = owner[hit], at[hit]
                for i in range(0, len(part), BLOCK_DOCS):
                    j = min(i + BLOCK_DOCS, len(part))
                    if n_docs and (n_docs + j - i > BLOCK_DOCS or held >= BLOCK_POSTINGS):
                        yield out()
                        n_docs = 0
                    a, b = np.searchsorted(owner, [i, j])
                    place, count = np.unique(at[a:b] * BLOCK_DOCS + (owner[a:b] - i + n_docs), return_counts=True)
                    docs.append(ids[part.first + i : part.first + j])
                    lengths.append(n[i:j])
                    places.append(place)
                    times.append(count)
                    held += len(place)
                    n_docs += j - i
        if n_docs:
            yield out()

    return dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(each, BLOCKS)


NO_ID = np.iinfo(np.int64).min


def _frequencies(made: DataFrame) -> DataFrame:
    """(key, df) over all blocks; reads the blocks' keys and list lengths only."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for keys, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = np.diff(np.frombuffer(ends, np.int32), prepend=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(n.astype(np.int64))], names=["key", "df"])

    return by_batch(made.select("keys", "ends"), work, "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))


@dataclass
class Statistics:
    """N and L of all documents, the asked keys in order and their weights."""

    n_docs: int
    n_terms: int
    asked: np.ndarray
    weights: np.ndarray


def _statistics(made: DataFrame, asked: np.ndarray) -> Statistics:
    n_docs, n_terms = made.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    df = np.zeros(len(asked), np.int64)
    for r in _frequencies(made).collect():  # the asked terms' at most
        df[np.searchsorted(asked, np.uint64(r["key"] % (1 << 64)))] = r["df"]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df]
    return Statistics(n_docs, n_terms, asked, np.array(weights, np.int64))


class Block:
    """A block's lists, by place of the term in the asked keys, with the impact of each posting."""

    def __init__(self, row: dict, stats: Statistics):
        self.docs = np.frombuffer(row["docs"], np.int64)
        lengths, times = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["times"], np.uint32).astype(np.int64)
        self.rows = np.frombuffer(row["rows"], np.uint16)
        ends = np.frombuffer(row["ends"], np.int32)
        starts = np.append(0, ends)[:-1]
        terms = np.searchsorted(stats.asked, np.frombuffer(row["keys"], np.uint64))
        m = 10 + (90 * lengths * stats.n_docs) // max(stats.n_terms, 1)
        self.impacts = np.repeat(stats.weights[terms], ends - starts) * ((1_000_000_000 * times) // (1000 * times + 8 * m[self.rows]))
        self.impacts[self.docs[self.rows] == NO_ID] = 0
        self.spans = {t: (a, b) for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True)}
        most = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.empty(0, np.int64)
        self.most = dict(zip(terms.tolist(), most.tolist(), strict=True))
        self.marks = np.zeros(len(self.docs), np.int64)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.spans[term]
        return self.rows[a:b], self.impacts[a:b]

    def intersection(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold both terms, and the two terms' joint impact there."""
        if a not in self.spans or b not in self.spans:
            return self.rows[:0], self.impacts[:0]
        rows, impacts = self.list(a)
        self.marks[rows] = impacts + 1  # 0 is left for rows without a
        others, more = self.list(b)
        met = self.marks[others]
        self.marks[rows] = 0
        both = met > 0
        return others[both], met[both] - 1 + more[both]


def _pairs(items: list[Item]) -> dict[tuple[int, int], int]:
    return {pair: i for i, pair in enumerate(dict.fromkeys(p for item in items for p in item.pairs))}


def _with_pairs(made: DataFrame, items: list[Item], stats: Statistics, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks with `joint` (the pairs' joint maxima), and (item_id, least): lower bounds of the k best scores of each block."""
    pairs = _pairs(items)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            block, joint, met = Block(row, stats), np.zeros(len(pairs), np.int64), {}
            for (a, b), i in pairs.items():
                rows, impacts = block.intersection(a, b)
                if len(rows):
                    met[a, b] = rows, impacts
                    joint[i] = impacts.max()
            bounds = []
            for item in items:
                block.marks[:] = 0
                for pair in item.pairs:
                    if pair in met:
                        block.marks[met[pair][0]] += met[pair][1]
                least = np.sort(block.marks[block.marks > 0])[-k:]
                bounds += [(item.item_id, int(x)) for x in least]
            yield pa.RecordBatch.from_pylist([{**row, "joint": joint.tobytes(), "bounds": [{"item_id": i, "least": x} for i, x in bounds]}], schema)

    binary = [c.split(" ")[0] for c in BLOCKS.split(", ")[:6]]
    schema = pa.schema(
        [(c, pa.binary()) for c in binary] + [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("joint", pa.binary())]
        + [("bounds", pa.list_(pa.struct([("item_id", pa.int64()), ("least", pa.int64())])))]
    )
    full = written(by_batch(made, work, BLOCKS + ", joint binary, bounds array<struct<item_id: long, least: long>>"), "pair_blocks")
    return full, full.select(F.inline("bounds"))


def _thresholds(bounds: DataFrame, k: int) -> dict[int, int]:
    """The k-th greatest lower bound of each item that has k; no document below it can be among the k best."""
    best = top_per_group(bounds, ["item_id"], [F.col("least").desc()], k).where(F.col("rank") == k)
    return {r["item_id"]: r["least"] for r in best.select("item_id", "least").collect()}


def best_of(block: Block, item: Item, joint: dict[tuple[int, int], int] | None, threshold: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the block's k best, ties by doc_id, among those that reach the threshold; and the postings read.
    joint=None bounds each term by itself."""
    terms = sorted((t for t in item.terms if t in block.most), key=lambda t: (block.most[t], t))
    partner = {a: b for pair in item.pairs for a, b in (pair, pair[::-1])} if joint is not None else {}
    ahead, before = [0], set()  # ahead[i]: what the first i terms can make together
    for t in terms:
        bound, other = ahead[-1] + block.most[t], partner.get(t)
        if other in before:
            bound += max(block.most[t], block.most[other], joint.get((t, other), 0), joint.get((other, t), 0)) - block.most[t] - block.most[other]
        ahead.append(bound)
        before.add(t)
    if ahead[-1] < max(threshold, 1):
        return block.rows[:0], block.impacts[:0], 0
    first = max(i for i in range(len(terms)) if ahead[i] < max(threshold, 1))  # terms from `first` on make candidates
    read, marks = 0, block.marks
    marks[:] = 0
    for t in terms[first:]:
        rows, impacts = block.list(t)
        marks[rows] += impacts
        read += len(rows)
    alive = np.flatnonzero(marks)
    score = marks[alive]
    for i in range(first - 1, -1, -1):
        reach = score + ahead[i + 1] >= threshold
        alive, score = alive[reach], score[reach]
        if not len(alive):
            break
        rows, impacts = block.list(terms[i])
        at = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
        score = score + np.where(rows[at] == alive, impacts[at], 0)
        read += min(len(alive), len(rows))
    reach = score >= max(threshold, 1)
    alive, score = alive[reach], score[reach]
    order = np.lexsort((block.docs[alive], -score))[:k]
    return alive[order], score[order], read


def _searched(full: DataFrame, items: list[Item], stats: Statistics, thresholds: dict[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score, read): at most k rows per block and item."""
    pairs = _pairs(items)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            block, stored = Block(row, stats), np.frombuffer(row["joint"], np.int64)
            joint = {pair: int(stored[i]) for pair, i in pairs.items() if stored[i]}
            ids, docs, scores, reads = [], [], [], []
            for item in items:
                rows, score, read = best_of(block, item, joint, thresholds.get(item.item_id, 0), k)
                ids.append(np.full(len(rows), item.item_id, np.int64))
                docs.append(block.docs[rows])
                scores.append(score)
                reads.append(np.full(len(rows), read, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, docs, scores, reads)], names=["item_id", "doc_id", "score", "read"])

    return by_batch(full, work, "item_id long, doc_id long, score long, read long")


def _passes(items: DataFrame, limit: int) -> Iterator[DataFrame]:
    """The items' terms, in passes of about `limit` rows; an item is never split."""
    terms = written(item_terms(items), "item_terms")
    n = max(1, -(-terms.count() // limit))
    for i in range(n):
        yield terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)


def _best(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """One pass: the k best documents of the items whose terms are given, with their scores."""
    rows = terms.collect()  # bounded by the pass
    if not rows:
        return None
    asked = np.unique(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    made = written(blocks(docs, asked), "blocks")
    stats = _statistics(made, asked)
    places: dict[int, list[int]] = {}
    for r in rows:
        places.setdefault(r["item_id"], []).append(int(np.searchsorted(asked, np.uint64(r["key"] % (1 << 64)))))
    items = [Item(i, sorted(p, key=lambda t: (stats.weights[t], t))) for i, p in sorted(places.items())]
    full, bounds = _with_pairs(made, items, stats, k)
    return _searched(full, items, stats, _thresholds(bounds, k), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, limit: int = MAX_TERMS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    found = None
    for terms in _passes(items, limit):
        one = _best(docs, terms, k)
        if one is not None:
            found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return top_per_group(found.select("item_id", "doc_id", "score"), ["item_id"], [F.col("score").desc(), F.col("doc_id")], k).select("item_id", "rank", "doc_id", "score")
