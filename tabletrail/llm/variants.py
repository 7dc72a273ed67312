"""Spelling variants: frequent words that differ from a more frequent one by one code point, joined by PartEnum signatures.

Words are counted in all texts. A word is taken as the multiset of its letters, a binary vector with an entry for each letter
and the how-many-th of it. One inserted, deleted or replaced code point moves that vector by a Hamming distance of two at most.
PartEnum deals the entries to PARTS parts: of two vectors at distance two, all but two parts are equal. A word's signatures
are the enumerated choices of PARTS - 2 parts, so two near words have one in common, exactly, whatever they are.

Multisets alone say nothing of order, and words made of the same syllables crowd on one signature. Each signature is
therefore joined with what one edit must leave in place: of a word cut into thirds, two. Pairs that meet under a signature and
two thirds are verified by their edit distance in the join itself; no list of a signature's members is made.

The results for null and empty texts: none of their own. Rows with equal ids are counted one by one, a null id is written as an
empty text. Words that no other is near have no form, zero near words and themselves as root. A table without words gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail.functions.joins import lookup_join
from tabletrail.llm.tasks import dealt
from tabletrail.llm.words import LOWER, Slice, prefix_codes, slices, span_hashes
from tabletrail.sources.scratch import written

LEAST_POINTS = 5
LEAST_COUNT = 3
DAMAGE = 97
#: Parts that a vector's entries are dealt to; C(PARTS, 2) signatures.
PARTS = 3
#: Words a task holds before it gives out their counts.
HELD = 200_000

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_LEAD = 0xC3  # of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run data[start:end], carried on from the crc32 of what stands before it."""
    order = np.argsort(starts - ends, kind="stable")
    at, left, state = starts[order], (ends - starts)[order], before[order] ^ np.uint32(0xFFFFFFFF)
    alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for j, n in enumerate(alive.tolist()):
        now = state[:n]
        state[:n] = _CRC[(now ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words(part: Slice, ids: list[str]) -> Iterator[tuple[int, bytes, int]]:
    """(key, word, times) of a slice's words, the damaged ones each for itself."""
    data = LOWER[part.data]
    lead = data == _LEAD
    inside = _IS_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=wide[1:])
    points = (ends - starts) - (wide[ends] - wide[starts])
    owner = np.searchsorted(part.offsets, starts, side="right") - 1
    before = np.array([zlib.crc32(f"{ids[part.first + i]}:".encode()) for i in range(len(part))], np.uint32)
    crc = checksums(data, starts, ends, before[owner])
    damaged = crc % DAMAGE == 0
    whole = ~damaged & (points >= LEAST_POINTS)
    keys, first, times = np.unique(span_hashes(prefix_codes(data), starts[whole], ends[whole]), return_index=True, return_counts=True)
    a, b = starts[whole][first], ends[whole][first]
    raw = data.tobytes()
    for key, i, j, n in zip(keys.tolist(), a.tolist(), b.tolist(), times.tolist(), strict=True):
        yield key, raw[i:j], n
    hit = np.flatnonzero(damaged & (points > LEAST_POINTS))
    for i, j, gone in zip(starts[hit].tolist(), ends[hit].tolist(), (crc[hit] % points[hit]).tolist(), strict=True):
        word = raw[i:j].decode()
        word = (word[:gone] + word[gone + 1 :]).encode()
        row = np.frombuffer(word, np.uint8)
        yield int(span_hashes(prefix_codes(row), np.array([0]), np.array([len(row)]))[0]), word, 1


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_POINTS code points or more, counted in tasks before they are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0].decode() for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = [i if i is not None else "" for i in batch.column(0).to_pylist()]
            for part in slices(batch.column(1)):
                for key, word, n in _words(part, ids):
                    held.setdefault(key, [word, 0])[1] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    rows = dealt(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInArrow(each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def parts_of(word: Column) -> list[Column]:
    """The letters of each part. An entry is a letter and its place among its equals, so equal parts make equal texts."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda x: x != ""))

    def part(p: int) -> Column:
        return F.array_join(F.filter(letters, lambda x, i: F.pmod(F.ascii(x) + 7 * (i - F.array_position(letters, x)), F.lit(PARTS)) == p), "")

    return [part(p) for p in range(PARTS)]


def signatures(words: DataFrame) -> DataFrame:
    """(key, points, word, n): what a word can meet its near words under, as the longer or the shorter of a pair or one of two
    equally long ones. `points` is the shorter one's length."""
    word, size = F.col("word"), F.length("word")
    parts = [F.col(f"part{p}") for p in range(PARTS)]
    chosen = [F.concat_ws("|", F.lit(str(kept)), *(parts[p] for p in kept)) for kept in combinations(range(PARTS), PARTS - 2)]

    def rest(points: Column) -> list[Column]:
        """What stays in place if the edit is in the last, the first or the middle third; fixed ends, whatever the word's length."""
        third = F.floor((points + 1) / 3).cast("int")
        head, tail = F.substring(word, F.lit(1), points - third), F.substring(word, size - (points - third) + 1, points - third)
        outer = F.concat(F.substring(word, F.lit(1), third), F.lit("|"), F.substring(word, size - third + 1, third))
        return [F.concat(F.lit(mark), x) for mark, x in (("h", head), ("t", tail), ("o", outer))]

    keys = [
        F.when(points >= LEAST_POINTS, F.struct(points.alias("points"), F.xxhash64(points, x, signature).alias("key")))
        for points in (size - 1, size) for x in rest(points) for signature in chosen
    ]
    rows = words.select("word", "n", *(p.alias(f"part{i}") for i, p in enumerate(parts_of(word))))
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("k")).where("k is not null").select("k.key", "k.points", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) with a < b: every two words one code point apart, once."""
    rows = signatures(words)
    left, right = rows.toDF("key", "points", "a", "n_a"), rows.toDF("key", "points", "b", "n_b")
    same = (F.least(F.length("a"), F.length("b")) == left["points"]) & (F.levenshtein("a", "b", 1) == 1)
    # The words' file is small, what it is exploded to is not: without the hint Spark would take it for small enough to broadcast.
    met = left.join(right.hint("merge"), (left["key"] == right["key"]) & (left["points"] == right["points"]) & (F.col("a") < F.col("b")) & same)
    return met.select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed in steps twice as long each time. A form has twice its word's count or
    more, so there are no rings, and no more rounds than the logarithm of the logarithm of the largest count."""
    now = written(forms.toDF("word", "root"), "forms")
    while True:
        ahead = now.toDF("root", "further")
        new = written(lookup_join(now, ahead, ["root"], "word", "left"), "forms")
        if new.where("further is not null").isEmpty():
            return now
        now = new.select("word", F.coalesce("further", "root").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(counts(docs).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = written(near_pairs(words), "near_words")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(pairs.select("b", "n_b", "a", "n_a"))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    large = -F.col("best.less") >= 2 * F.col("n")
    near = written(near.select("word", "n_near", F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null").select("word", "form"))
    return (
        words.join(near, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
