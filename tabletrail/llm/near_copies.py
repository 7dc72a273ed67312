"""Near-duplicate documents by b-bit MinHash.

A document is its set of five-word shingles. Documents with equal sets form a class, and only its first goes on. Of each of
`HASHES` minima the full value goes into a band key (`ROWS` minima a band), and the low `BITS` bits into a packed signature.
Candidates come from the bands; the bits that agree, corrected for those that agree by chance, estimate their similarity, and
what may reach the threshold is confirmed on the full sets. A pair of similarity 0.85 meets in a band with probability
1 - 1.7e-8 and passes the estimate, 4.5 standard deviations below the threshold, with 1 - 4e-6.

No bucket's pairs are all made. First every member is compared with the bucket's first; links make components. What the
members of other components still owe each other is tested in a join of the buckets that hold several components, which
gives out only pairs whose estimate passes and whose shingles allow it: those that no other member of such a bucket has are
counted, and what is left bounds the intersection from above. So copies with many changes of their own meet hardly any other.

Rows with equal doc_id are one document. Texts without words, and rows without doc_id, are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail.llm.components import components
from tabletrail.llm.containment import build_filter
from tabletrail.llm.tasks import by_batch, dealt, without_ids
from tabletrail.llm.words import mix, shingles_of, slices, words_of
from tabletrail.sources.scratch import written

PERCENT = 85
ROWS = 4
BANDS = 24
HASHES = ROWS * BANDS
BITS = 2
LONGS = HASHES * BITS // 64
SPREADS = 4.5

_FACTOR = mix(np.arange(50_001, 50_001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_BAND = mix(np.arange(70_001, 70_001 + BANDS, dtype=np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, s0.., bands): the set's size and 128-bit key, the packed bits, the band keys."""
    packed = [f"s{i}" for i in range(LONGS)]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch.column(1)):
            found = shingles_of(words_of(part))
            n = len(part)
            sets = [np.unique(found.hashes[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
            sizes = np.array([len(s) for s in sets])
            filled = np.flatnonzero(sizes)
            keys = np.zeros((2, n), np.uint64)
            low = np.zeros((HASHES, n), np.uint64)
            if len(filled):
                flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
                keys[0, filled] = np.add.reduceat(mix(flat), starts)
                keys[1, filled] = np.add.reduceat(mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                for h in range(HASHES):
                    low[h, filled] = np.minimum.reduceat(flat * _FACTOR[h], starts)
            mixed = mix(low)  # the low bits of a minimum are even only after mixing
            bits = mixed & np.uint64((1 << BITS) - 1)
            per = 64 // BITS
            longs = [np.bitwise_or.reduce(bits[i * per : (i + 1) * per] << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[:, None]) for i in range(LONGS)]
            bands = np.empty((n, BANDS), np.uint64)
            for b in range(BANDS):
                total = np.full(n, _BAND[b], np.uint64)
                for h in range(b * ROWS, (b + 1) * ROWS):
                    total = mix(total ^ mixed[h])
                bands[:, b] = total
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.first, n),
                    pa.array(sizes.astype(np.int64)),
                    *(pa.array(k.view(np.int64)) for k in keys),
                    *(pa.array(x.view(np.int64)) for x in longs),
                    pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", *packed, "bands"],
            )

    schema = f"doc_id long, n_shingles long, set_a long, set_b long, {', '.join(f'{s} long' for s in packed)}, bands array<long>"
    return by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), work, schema)


def agreeing_minima(left: str, right: str) -> Column:
    """How many of the packed values agree: bits that differ are joined per value and counted."""
    mask = int("01" * (64 // BITS), 2) if BITS == 2 else sum(1 << (i * BITS) for i in range(64 // BITS))
    differing = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        for step in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}")), step))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(mask)))
    return F.lit(HASHES) - differing


def may_link(left: str, right: str, percent: int = PERCENT, alone: str | None = None) -> Column:
    """Whether the sizes allow the similarity and the estimate, corrected for chance agreement, is not too far below it. `alone`
    names a column with the number of shingles that no other candidate has."""
    chance = 2.0**-BITS
    share = chance + (1 - chance) * percent / 100
    least = HASHES * share - SPREADS * (HASHES * share * (1 - share)) ** 0.5
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    most = F.least(a, b) if alone is None else F.least(a - F.col(f"{left}.{alone}"), b - F.col(f"{right}.{alone}"))
    return (100 * most >= percent * (a + b - most)) & (agreeing_minima(left, right) >= least)


def _sets(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, shingles): sorted sets, packed, of the documents whose ids a Bloom filter of ids(id), at most `most`, lets through."""
    wanted = docs.sparkSession.sparkContext.broadcast(build_filter(ids, "id", most))

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            return
        batch = batch.filter(pa.array(wanted.value(np.asarray(batch.column(0)).view(np.uint64))))
        for part in slices(batch.column(1)):
            found = shingles_of(words_of(part))
            rows = [np.unique(found.hashes[a:b]).tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(rows, pa.binary())], names=["id", "shingles"])

    return by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), sets, "id long, shingles binary").dropDuplicates(["id"])


def alone(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, alone): for documents of ids(id), how many of their shingles none of the others has; none: no row."""

    def unpack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            found = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(0)[i].as_py())), pa.array(found)], names=["id", "shingle"])

    rows = by_batch(_sets(docs, ids, ids.count()), unpack, "id long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("doc_id")).where("n = 1")
    return single.groupBy("doc_id").agg(F.count("*").alias("alone"))


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. Only sets that a Bloom filter of the pairs' ids lets through are
    made, and each goes to the pairs it belongs to."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    found = _sets(docs, ids, pairs.count() * 2)

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            keep[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(found.select(F.col("id").alias("b"), F.col("shingles").alias("shingles_b")), "b").join(
        found.select(F.col("id").alias("a"), F.col("shingles").alias("shingles_a")), "a"
    )
    return by_batch(both.select("a", "b", "shingles_a", "shingles_b"), compare, "a long, b long")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    packed = [f"s{i}" for i in range(LONGS)]
    signed = written(signatures(docs), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = signed.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id"])
    buckets = written(firsts.select("doc_id", F.explode("bands").alias("band")), "buckets")
    sums = written(firsts.select("doc_id", "n_shingles", *packed), "packed")
    heads = buckets.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")).where("members > 1")
    spokes = buckets.join(heads.select("band", "head"), "band").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()

    def passing(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sums.select(F.col("doc_id").alias("b"), F.struct("n_shingles", *packed).alias("right")), "b")
        x = x.join(sums.select(F.col("doc_id").alias("a"), F.struct("n_shingles", *packed).alias("left")), "a")
        return written(x.where(may_link("left", "right", percent)).select("a", "b"), "candidates")

    tried = passing(spokes)
    edges = written(confirmed(docs, tried, percent), "links")
    groups = written(components(edges), "groups")
    # what is left: members of one bucket in different components, other than with the bucket's first
    named = buckets.join(groups, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = (
        named.groupBy("band")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("head"))
        .where("n > 2 and low <> high")
    )
    rest = written(named.join(mixed.select("band", "head"), "band").where("doc_id <> head"), "mixed_buckets")
    own = alone(docs, rest.select(F.col("doc_id").alias("id")).distinct())
    figures = written(rest.select("doc_id").distinct().join(firsts.select("doc_id", "n_shingles", *packed, "bands"), "doc_id").join(own, "doc_id", "left").na.fill(0, ["alone"]), "mixed")
    rest = rest.join(figures, "doc_id")
    left = rest.select("band", F.struct("doc_id", "component", "n_shingles", "alone", "bands", *packed).alias("left"))
    right = rest.select("band", F.struct("doc_id", "component", "n_shingles", "alone", "bands", *packed).alias("right"))
    apart = (left["band"] == right["band"]) & (F.col("left.component") < F.col("right.component"))
    same = F.zip_with("left.bands", "right.bands", lambda x, y: x == y)
    first = F.element_at("left.bands", F.array_position(same, True).cast("int")) == left["band"]  # a pair counts in its first bucket only
    cross = left.join(right, apart & may_link("left", "right", percent, "alone") & first)
    cross = cross.select(F.least("left.doc_id", "right.doc_id").alias("a"), F.greatest("left.doc_id", "right.doc_id").alias("b")).distinct()
    cross = written(cross.join(tried, ["a", "b"], "left_anti"), "candidates")
    if not cross.isEmpty():
        groups = written(components(edges.union(written(confirmed(docs, cross, percent), "links"))), "groups")
    of_class = classes.join(groups, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = signed.join(of_class, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which one stands for each group, with all their columns."""
    return without_ids(docs, linked(docs, percent).where("not kept").select("doc_id"))
