"""Perplexity under an interpolated modified Kneser-Ney model of word pairs.

Spark counts: tasks reduce their texts to distinct keys with counts, cut these by key range into one block per shard, and a
shuffle of blocks brings each shard together. A shard is written to the shared folder as sorted arrays: word hashes with
counts (a word's number is its place), pairs of numbers with counts, and per word the figures of its contexts. Workers map
the arrays into memory and look up distinct keys of a slice of text in order; no model is sent or held whole.

Pairs lie in their first word's shard. The first words that make up 1/`HOT_SHARE` of all tokens or more, and the start mark,
have their pairs spread over all shards by the second word, so no word makes a shard large; partial figures of these few
words add up. Files are written under a temporary name and then renamed, so a task may run again.

The shared folder must be one that executors can open as files. A text's tokens are its lower-cased words and one end mark.
The model gives every word outside the training vocabulary together the probability of one unknown word. Null texts are
empty; rows without doc_id are trained on; equal rows count as often as they occur. Without training text every token has
probability one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail.llm.tasks import dealt
from tabletrail.llm.words import mix, slices, words_of
from tabletrail.sources.scratch import shared_folder, written

HOT_SHARE = 256
SLICE = 1 << 21
HELD = 1 << 20
END = np.uint64(0x8F1BBCDCBFA53E0B)
START = np.uint32(0xFFFFFFFE)
_BLOCK = "shard int, keys binary, counts binary"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _local(folder: str) -> str:
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"the model's arrays are memory-mapped; {folder} can't be opened as files")
    return folder.removeprefix("file://").removeprefix("file:")


def _save(path: str, values: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        values.tofile(out)
    os.replace(own, path)


def _map(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _joined(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b.as_buffer(), kind) for b in table["keys"]]
    counts = [np.frombuffer(b.as_buffer(), np.uint32).astype(np.int64) for b in table["counts"]]
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _blocks(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard; `shards` need not be sorted, the keys of a shard keep their order."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order]
    present, starts = np.unique(shards, return_index=True)
    ends = np.append(starts[1:], len(shards))
    cut = list(zip(starts, ends, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(present.astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in cut], pa.binary())],
        names=["shard", "keys", "counts"],
    )


@dataclass
class Tokens:
    """Tokens of a slice's texts, ends included; text i has first[i]..first[i+1]-1."""

    hashes: np.ndarray
    first: np.ndarray


def tokens_of(part) -> Tokens:
    words = words_of(part)
    first = words.first + np.arange(len(words.first))
    hashes = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    hashes[inside] = words.hashes
    return Tokens(hashes, first)


@dataclass
class Model:
    """What a worker needs: where the arrays are, and the figures of the whole."""

    path: str
    shard_bits: int
    offsets: np.ndarray
    tokens: int = 0
    words: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    hot_figures: dict = field(default_factory=dict)
    discounts: tuple = (0.0, 0.0, 0.0)
    low_discounts: tuple = (0.0, 0.0, 0.0)
    low_total: int = 0
    low_rest: float = 1.0
    maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def array(self, name: str, shard: int, kind: type) -> np.ndarray:
        key = (name, shard)
        if key not in self.maps:
            path = f"{self.path}/{name}-{shard}"
            self.maps[key] = _map(path, kind) if os.path.exists(path) else np.empty(0, kind)
        return self.maps[key]

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of the sorted hashes."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(self.word_shard(hashes), np.arange((1 << self.shard_bits) + 1))
        for shard in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[shard], bounds[shard + 1]
            known = self.array("words", shard, np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                same = known[at] == hashes[a:b]
                out[a:b][same] = at[same] + self.offsets[shard]
                counts[a:b][same] = self.array("counts", shard, np.uint32)[at[same]]
        return out, counts

    def number_shard(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, numbers, side="right") - 1

    def pair_shard(self, pairs: np.ndarray) -> np.ndarray:
        first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        spread = (first == np.uint64(START)) | np.isin(first, self.hot.astype(np.uint64))
        shard = self.number_shard(np.minimum(first, np.uint64(max(self.words - 1, 0))).astype(np.int64))
        shard[spread] = (mix(second[spread]) >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        return shard

    def by_number(self, name: str, numbers: np.ndarray, columns: int) -> np.ndarray:
        """Rows of a per-word array for numbers that exist."""
        out = np.zeros((len(numbers), columns), np.int64)
        shard = self.number_shard(numbers)
        for s in np.unique(shard):
            rows = np.flatnonzero(shard == s)
            values = self.array(name, s, np.uint32).reshape(-1, columns)
            if len(values):
                out[rows] = values[numbers[rows] - self.offsets[s]]
        return out

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, in any order."""
        out = np.zeros(len(pairs), np.int64)
        shard = self.pair_shard(pairs)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange((1 << self.shard_bits) + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[s] : bounds[s + 1]]
            known = self.array("pairs", s, np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, pairs[rows]), len(known) - 1)
                same = known[at] == pairs[rows]
                out[rows[same]] = self.array("pair_counts", s, np.uint32)[at[same]]
        return out

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """(total, seen once, seen twice, seen more often) of what follows each word; zeros for unknown words."""
        out = np.zeros((len(numbers), 4), np.int64)
        plain = np.flatnonzero((numbers >= 0) & (numbers != int(START)))
        out[plain] = self.by_number("contexts", numbers[plain], 4)
        for number, figures in self.hot_figures.items():
            out[numbers == number] = figures
        return out


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2, 3 and more, from how many keys have count 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discount(values: tuple, counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *values])[np.minimum(counts, 3)]


def _four(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def count_words(texts: DataFrame, path: str, bits: int) -> Model:
    """Counts the tokens of `texts` (one column); writes `words` and `counts` of each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return _blocks((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)

        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                new, n = np.unique(tokens_of(part).hashes, return_counts=True)
                held.append((new, n))
                there += len(new)
                if there > HELD:
                    yield out()
                    there = 0
        if held:
            yield out()

    def store(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _joined(table, np.uint64)
        _save(f"{path}/words-{shard}", keys)
        _save(f"{path}/counts-{shard}", counts.astype(np.uint32))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)]), "total": pa.array([int(counts.sum())])})

    rows = texts.mapInArrow(count, _BLOCK).groupBy("shard").applyInArrow(store, "shard int, n long, total long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    return Model(path, bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sum(r["total"] for r in rows), int(sizes.sum()))


def find_hot(model: Model, spark) -> None:
    """Numbers of the words that make up 1/HOT_SHARE of the tokens or more (at most HOT_SHARE words)."""
    least = model.tokens / HOT_SHARE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at = np.flatnonzero(model.array("counts", shard, np.uint32) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + model.offsets[shard])], names=["number"])

    rows = spark.range(1 << model.shard_bits).mapInArrow(work, "number long").collect() if model.tokens else []
    model.hot = np.array(sorted(r["number"] for r in rows), np.uint32)


def _pairs(model: Model, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and own number of each token (-1: unknown; START before a text) and the own count."""
    tokens = tokens_of(part)
    distinct, back = np.unique(tokens.hashes, return_inverse=True)
    numbers, counts = model.numbers(distinct)
    own = numbers[back]
    before = np.empty(len(own), np.int64)
    before[1:] = own[:-1]
    before[tokens.first[:-1]] = int(START)
    return before, own, counts[back]


def count_pairs(texts: DataFrame, model: Model) -> None:
    """Counts pairs, writes `pairs`, `pair_counts`, `contexts` and `before` (how many words a word follows); fills the model."""
    bits, sent = model.shard_bits, texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, there = sent.value, [], 0

        def out() -> pa.RecordBatch:
            keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return _blocks(model.pair_shard(keys), keys, n)

        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                before, own, _ = _pairs(model, part)
                held.append(np.unique((before.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64), return_counts=True))
                there += len(held[-1][0])
                if there > HELD:
                    yield out()
                    there = 0
        if held:
            yield out()

    def store(table: pa.Table) -> pa.Table:
        model, shard = sent.value, table["shard"][0].as_py()
        keys, counts = _joined(table, np.uint64)
        _save(f"{model.path}/pairs-{shard}", keys)
        _save(f"{model.path}/pair_counts-{shard}", counts.astype(np.uint32))
        first = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        figures = np.stack([np.add.reduceat(x, starts) for x in (counts, *((counts == 1), (counts == 2), (counts > 2)))], axis=1).astype(np.int64)
        numbers = first[starts]
        spread = (numbers == int(START)) | np.isin(numbers, model.hot)
        dense = np.zeros((len(model.array("words", shard, np.uint64)), 4), np.uint32)
        dense[numbers[~spread] - model.offsets[shard]] = figures[~spread]
        _save(f"{model.path}/contexts-{shard}", dense)
        second, n = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        out = _blocks(model.number_shard(second.astype(np.int64)), second, n)
        note = np.concatenate([[-1, *_four(counts)], np.column_stack([numbers[spread], figures[spread]]).reshape(-1)]).astype(np.int64)
        return pa.Table.from_batches([out]).append_column("note", pa.array([note.tobytes()] + [None] * (out.num_rows - 1), pa.binary()))

    blocks = written(texts.mapInArrow(count, _BLOCK).groupBy("shard").applyInArrow(store, _BLOCK + ", note binary"), "pairs")
    n = np.zeros(4)
    hot: dict[int, np.ndarray] = {}
    for row in blocks.where("note is not null").select("note").toLocalIterator():  # one short note per shard
        note = np.frombuffer(bytes(row["note"]), np.int64).reshape(-1, 5)
        n += note[0, 1:]
        for number, *figures in note[1:]:
            hot[int(number)] = hot.get(int(number), 0) + np.array(figures)

    def store_before(table: pa.Table) -> pa.Table:
        model, shard = sent.value, table["shard"][0].as_py()
        keys, counts = _joined(table, np.uint32)
        dense = np.zeros(len(model.array("words", shard, np.uint64)), np.uint32)
        dense[keys.astype(np.int64) - model.offsets[shard]] = counts
        _save(f"{model.path}/before-{shard}", dense)
        four = [*_four(counts), int((counts > 2).sum()), int(counts.sum())]
        return pa.table({"shard": pa.array([shard], pa.int32()), **{f"n{i}": pa.array([v], pa.int64()) for i, v in enumerate(four)}})

    rows = blocks.select("shard", "keys", "counts").groupBy("shard").applyInArrow(store_before, "shard int, " + ", ".join(f"n{i} long" for i in range(6))).collect()
    low = np.array([[r[f"n{i}"] for i in range(6)] for r in rows], float).reshape(-1, 6).sum(axis=0)
    model.hot_figures = hot
    model.discounts, model.low_discounts = discounts(n.tolist()), discounts(low[:4].tolist())
    model.low_total = int(low[5])
    model.low_rest = float(np.dot(model.low_discounts, [low[0], low[1], low[4]]) / low[5]) if low[5] else 1.0


def train(docs: DataFrame) -> Model:
    """Counts the texts of `docs`, column `text`."""
    spark = docs.sparkSession
    path = f"{_local(shared_folder(spark))}/model-{uuid.uuid4().hex[:12]}"
    texts = dealt(docs.select("text"))
    bits = max(3, (texts.rdd.getNumPartitions() - 1).bit_length())  # so a shard grows no larger than a task's share of the input
    model = count_words(texts, path, bits)
    find_hot(model, spark)
    if model.tokens:
        count_pairs(texts, model)
    return model


def token_probabilities(model: Model, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """P(own | before) for distinct pairs of numbers."""
    follows = np.zeros(len(own), np.int64)
    known = np.flatnonzero(own >= 0)
    follows[known] = model.by_number("before", own[known], 1)[:, 0]
    low = model.low_rest / (model.words + 1) + (np.maximum(follows - _discount(model.low_discounts, follows), 0) / model.low_total if model.low_total else 0)
    both = np.flatnonzero((own >= 0) & (before >= 0))
    count = np.zeros(len(own), np.int64)
    count[both] = model.pair_counts((before[both].astype(np.uint64) << np.uint64(32)) | own[both].astype(np.uint64))
    context = model.contexts(before)
    total = np.maximum(context[:, 0], 1)
    rest = np.where(context[:, 0] > 0, context[:, 1:] @ np.array(model.discounts) / total, 1.0)
    return np.maximum(count - _discount(model.discounts, count), 0) / total + rest * low


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    model = train(rows.where(~F.col("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                before, own, counts = _pairs(model, part)
                first = np.concatenate([[0], np.flatnonzero(before == int(START))[1:], [len(own)]]) if len(part) else np.zeros(1, int)
                keys, back = np.unique(((before + 1).astype(np.uint64) << np.uint64(32)) | (own + 1).astype(np.uint64), return_inverse=True)
                p = token_probabilities(model, (keys >> np.uint64(32)).astype(np.int64) - 1, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1)
                logs = np.log10(p)[back]
                base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
                n = np.diff(first)
                score = np.add.reduceat(logs, first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        batch.column(2).slice(part.first, len(part)),
                        pa.array(n),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), first[:-1])),
                        pa.array(np.full(len(part), model.tokens)),
                        pa.array(np.add.reduceat(base, first[:-1])),
                        pa.array(score),
                        pa.array(10.0 ** np.minimum(-score / n, 300)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return dealt(rows).mapInArrow(work, schema)
