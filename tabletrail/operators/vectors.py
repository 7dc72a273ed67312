"""Cosine similarity between queries and documents, exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tabletrail import settings
from tabletrail.functions.joins import top_per_group
from tabletrail.functions.word_batches import word_columns, words_of_batch
from tabletrail.operators.bm25 import bucket_of
from tabletrail.sources.scratch import written

# Numbers in one block of a task: rows times queries, or times the width of a vector.
BLOCK_CELLS = 1 << 22


@dataclass(frozen=True)
class TextModel:
    """Hashed TF-IDF: the weight of each feature, in documents that are known by their number and how many hold the feature."""

    idf: tuple[float, ...]

    @property
    def features(self) -> int:
        return len(self.idf)


@lru_cache(maxsize=1 << 16)
def feature_of(word: str, features: int) -> int:
    """The same in every engine that has MD5: its first eight hexadecimal digits, modulo the number of features."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % features


def text_counts(rows: DataFrame, text: str = "embedding_text", features: int = 256, name: str = "counts", keep_text: bool = True) -> DataFrame:
    """Adds how often each feature occurs in a text. Counts do not depend on other texts, so those of several runs add up.

    keep_text: whether the text stays; it is carried through the tasks for that."""
    kept = [c for c in rows.columns if c != name and (keep_text or c != text)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, words, owner in words_of_batch(batch.column(len(kept)), batch.column(len(kept) + 1)):
                places = np.array([feature_of(w, features) for w in words.dictionary.to_pylist()], np.int64)
                at = places[words.indices.to_numpy()] if len(words) else places
                counted = np.bincount(owner * features + at, minlength=n * features).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * features)
                columns = [*(batch.column(i).slice(first, n) for i in range(len(kept))), pa.ListArray.from_arrays(ends, pa.array(counted))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    schema = StructType([rows.schema[c] for c in kept] + [StructField(name, ArrayType(FloatType()))])
    return rows.select(*kept, *word_columns(text)).mapInArrow(count, schema)


def feature_counts(counted: DataFrame, name: str = "counts") -> DataFrame:
    """(feature, df): the documents that hold each feature, and their number as feature -1."""
    held = counted.select(F.posexplode(name).alias("feature", "n")).where("n > 0").groupBy("feature").agg(F.count("*").alias("df"))
    return held.union(counted.agg(F.lit(-1).alias("feature"), F.count("*").alias("df")))


def model_of(counts: DataFrame, features: int) -> TextModel:
    """The model of (feature, df) rows; those of several runs add up. They are as many as features, and come to the driver."""
    df = {r["feature"]: r["df"] for r in counts.groupBy("feature").agg(F.sum("df").alias("df")).collect()}
    return TextModel(tuple(math.log((df.get(-1, 0) + 1) / (df.get(f, 0) + 1)) for f in range(features)))


def weighted(model: TextModel, counted: DataFrame, counts: str = "counts", name: str = "embedding") -> DataFrame:
    """Adds the vectors, of unit length or all zeros, and drops the counts."""
    idf = F.array(*(F.lit(x) for x in model.idf))
    raw = F.zip_with(counts, idf, lambda n, w: n.cast("double") * w)
    length = F.sqrt(F.aggregate(F.col("_raw"), F.lit(0.0), lambda total, x: total + x * x))
    out = counted.withColumn("_raw", raw).withColumn("_length", length)
    unit = F.transform("_raw", lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(F.lit(0.0)))
    return out.withColumn(name, unit).drop("_raw", "_length", counts)


def fit_text_vectors(documents: DataFrame, text: str = "embedding_text", features: int = 256) -> TextModel:
    """Hashed TF-IDF, for users who bring no vectors of their own."""
    return model_of(feature_counts(text_counts(documents.select(text), text, features, keep_text=False)), features)


def text_vectors(model: TextModel, texts: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """Add the vectors of a text column, from the same model for documents and queries."""
    return weighted(model, text_counts(texts, text, model.features, "_counts"), "_counts", name)


def nearest(
    documents: DataFrame,
    queries: DataFrame,
    n: int,
    key: str = "chunk_id",
    same_table: bool = False,
    per_pass: int = settings.QUERY_VECTORS_PER_PASS,
) -> DataFrame:
    """(query, key, score, rank): the n documents nearest to each query, from (key, embedding) and (query, embedding).

    Each task multiplies its batches with the query matrix and keeps n documents per query, so n rows per query and
    task are shuffled, not all pairs. The matrix is sent to the tasks in slices of at most about `per_pass` vectors; more
    queries take more passes over the documents, one at a time. Ties go to the smaller key.

    same_table: only documents whose canonical_tables hold the query's canonical compete, all of them.
    """
    spark = documents.sparkSession
    kind, asked = documents.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    table = F.col("canonical") if same_table else F.lit(None).cast("string").alias("canonical")
    columns = queries.select("query", table, F.col("embedding").cast("array<double>"))
    passes = -(-max(columns.count(), 1) // per_pass)
    if passes > 1:
        columns = written(columns, "asked")
    rows_in = documents.select(key, F.col("embedding").cast("array<double>"), *(["canonical_tables"] if same_table else []))
    best = None
    for number in range(passes):
        part = columns if passes == 1 else columns.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == number)
        sent = spark.sparkContext.broadcast([tuple(row) for row in part.collect()])
        found = rows_in.mapInArrow(_keep_nearest(sent, key, n, same_table), f"query {asked}, {key} {kind}, score double")
        if passes > 1:  # one slice at a time: its result is stored and its vectors are let go
            found = written(found, "nearest")
            sent.unpersist()
        best = found if best is None else best.unionByName(found)
    return top_per_group(best, ["query"], [F.desc("score"), F.asc(key)], n)


def with_table(documents: DataFrame, tables: DataFrame, n: int) -> DataFrame:
    """(query, chunk_id, score, rank): of the documents naming the query's table, the n nearest to that name.

    `tables` has (query, canonical, embedding). The match is exact.
    """
    return nearest(documents, tables, n, same_table=True)


def by_table(documents: DataFrame, buckets: int = settings.STORE_BUCKETS, key: str = "chunk_id") -> DataFrame:
    """(bucket, table, key, embedding): the vectors once for each table they name, to be written in folders by bucket."""
    named = documents.select(key, "embedding", F.explode(F.array_distinct("canonical_tables")).alias("table"))
    return named.withColumn("bucket", bucket_of("table", buckets)).select("bucket", "table", key, "embedding")


def with_table_in_buckets(laid_out: DataFrame, tables: DataFrame, n: int, buckets: int = settings.STORE_BUCKETS, key: str = "chunk_id") -> DataFrame:
    """As with_table, from vectors laid out by table: only the folders of the asked tables are read."""
    asked = [r[0] for r in tables.where("canonical IS NOT NULL").select(bucket_of("canonical", buckets)).distinct().collect()]
    rows = laid_out.where(F.col("bucket").isin(asked)).select(key, "embedding", F.array("table").alias("canonical_tables"))
    return nearest(rows, tables, n, key, same_table=True)


@dataclass(frozen=True)
class Cells:
    """Vectors laid out by the centre they are nearest to. No vector of a cell is further from its centre than its radius; the
    last cell is that of vectors without a direction and has no radius that bounds it."""

    rows: DataFrame  # cell, key, embedding
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _centres(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means of unit vectors, started from vectors far from the ones before."""
    chosen = [sample[0]]
    far = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(sample[int(far.argmax())])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest_one = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_one, sample)
        held = np.bincount(nearest_one, minlength=len(centres)) > 0
        centres[held] = _unit(sums[held])
    return centres


def build_cells(documents: DataFrame, key: str = "chunk_id", cells: int = settings.VECTOR_CELLS, sample: int = settings.CELL_SAMPLE) -> Cells:
    """Lay out (key, embedding) by cells, in the shared folder. The centres are fitted on about `sample` vectors chosen by a hash of
    their key; every vector is laid out, and the radii are those of all vectors."""
    rows = documents.where("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<double>"))
    there = rows.count()
    some = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(there, 1))) + 1)
    vectors = [r[0] for r in some.select("embedding").collect()]
    units = _unit(np.array(vectors, dtype=float)) if vectors else np.zeros((0, 1))
    units = units[np.any(units != 0, axis=1)]
    centres = _centres(units, cells) if len(units) else np.zeros((0, units.shape[1]))
    kind = documents.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_CELLS // max(len(centres), 64)):
                part = batch.slice(at, BLOCK_CELLS // max(len(centres), 64))
                unit = _unit(_matrix(part.column(1), pc.list_value_length(part.column(1))[0].as_py()))
                cell = np.full(len(unit), len(centres), np.int32)
                apart = np.zeros(len(unit))
                there = np.any(unit != 0, axis=1)
                if len(centres):
                    cell[there] = (unit[there] @ centres.T).argmax(axis=1)
                    apart[there] = np.linalg.norm(unit[there] - centres[cell[there]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0), part.column(1), pa.array(apart)], names=["cell", key, "embedding", "apart"])

    laid_out = written(rows.mapInArrow(assign, f"cell int, {key} {kind}, embedding array<double>, apart double"), "cells", by="cell")
    radii, sizes = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    radii[-1] = np.inf
    for r in laid_out.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
        if r["cell"] < len(centres):
            radii[r["cell"]] = r["radius"]
    return Cells(laid_out.drop("apart"), centres, radii, sizes)


def _least_distances(cells: Cells, matrix: np.ndarray) -> np.ndarray:
    """How near a vector of each cell can be to each query at best, by the triangle inequality."""
    least = np.full((len(matrix), len(cells.radii)), -np.inf)
    if len(cells.centres):
        apart = np.linalg.norm(matrix[:, None, :] - cells.centres[None, :, :], axis=2)
        least[:, :-1] = np.maximum(apart - cells.radii[:-1], 0.0)
    least[~np.any(matrix != 0, axis=1)] = -np.inf
    least[:, cells.sizes == 0] = np.inf
    return least


def nearest_in_cells(
    cells: Cells, queries: DataFrame, n: int, key: str = "chunk_id", per_pass: int = settings.QUERY_VECTORS_PER_PASS, read: list[int] | None = None
) -> DataFrame:
    """As nearest, exact, without reading the cells that cannot hold one of a query's n nearest.

    The cells that can be nearest are read first, until they hold n vectors; the n-th distance found there tells which others can still
    hold a nearer one. `read` gets the number of (query, cell) pairs that were read, and of all.
    """
    spark = cells.rows.sparkSession
    kind, asked = cells.rows.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    schema = f"query {asked}, {key} {kind}, score double"
    columns = queries.where("embedding IS NOT NULL").select("query", F.col("embedding").cast("array<double>"))
    passes = -(-max(columns.count(), 1) // per_pass)
    columns = written(columns, "asked") if passes > 1 else columns
    best = spark.createDataFrame([], schema)
    for number in range(passes):
        rows = (columns if passes == 1 else columns.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == number)).collect()
        if not rows:
            continue
        names, matrix = [r["query"] for r in rows], _unit(np.array([r["embedding"] for r in rows], dtype=float))
        least = _least_distances(cells, matrix)
        order = np.argsort(least, axis=1, kind="stable")
        counted = np.append(cells.sizes[:-1], 0)  # vectors without a direction are near nothing
        before = np.take_along_axis(np.broadcast_to(counted, least.shape), order, axis=1).cumsum(axis=1)
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, np.concatenate([np.ones((len(names), 1), bool), before[:, :-1] < n], axis=1), axis=1)
        first &= cells.sizes > 0
        found = written(_read_cells(cells, names, matrix, first, key, n, schema), "nearest")
        last = top_per_group(found, ["query"], [F.desc("score")], n).where(F.col("rank") == n)
        reach = {r["query"]: np.sqrt(max(2 - 2 * r["score"], 0.0)) + 1e-6 for r in last.collect()}
        limit = np.array([reach.get(q, np.inf) for q in names])[:, None]
        more = ~first & (least <= limit) & (cells.sizes > 0)
        if more.any():
            found = found.unionByName(written(_read_cells(cells, names, matrix, more, key, n, schema), "nearest"))
        if read is not None:
            read[:] = [*read, int(first.sum() + more.sum()), int(len(names) * (cells.sizes > 0).sum())]
        best = best.unionByName(found)
    return top_per_group(best, ["query"], [F.desc("score"), F.asc(key)], n)


def _read_cells(cells: Cells, names: list, matrix: np.ndarray, wanted: np.ndarray, key: str, n: int, schema: str) -> DataFrame:
    """The n best of each task for each query, among the rows of its wanted cells only."""
    asking = {int(c): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}
    sent = cells.rows.sparkSession.sparkContext.broadcast((names, matrix, asking))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, asking = sent.value
        kept = None
        for batch in batches:
            place = batch.column(0).to_numpy()
            for cell in np.unique(place).tolist():
                mine, near = batch.filter(pa.array(place == cell)), asking[cell]
                block = max(BLOCK_CELLS // len(near), 1)
                for at in range(0, mine.num_rows, block):
                    part = mine.slice(at, block)
                    similar = np.round(_unit(_matrix(part.column(2), matrix.shape[1])) @ matrix[near].T, 12)
                    least = np.partition(similar, -n, axis=0)[-n] if len(similar) > n else -np.inf
                    row, q = np.nonzero(similar >= least)
                    keys = part.column(1).to_numpy(zero_copy_only=False)
                    more = pd.DataFrame({"q": near[q], key: keys[row], "score": similar[row, q]})
                    more = more if kept is None else pd.concat([kept, more], ignore_index=True)
                    kept = more.sort_values(["q", "score", key], ascending=[True, False, True]).groupby("q").head(n)
        if kept is not None and len(kept):
            found = kept.assign(query=np.array(names, dtype=object)[kept["q"]])[["query", key, "score"]]
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return cells.rows.where(F.col("cell").isin(list(asking))).select("cell", key, "embedding").mapInArrow(run, schema)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros, which has no direction, stays zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows, straight from their buffer; a missing one is a row of zeros."""
    rows, there = np.zeros((len(column), width)), np.asarray(column.is_valid())
    rows[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return rows


def _keep_nearest(sent, key: str, n: int, same_table: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tables, vectors = zip(*sent.value) if sent.value else ((), (), ())
        width = max((len(v) for v in vectors if v is not None), default=0)
        if not width:
            return
        matrix = _unit(np.array([v if v is not None else np.zeros(width) for v in vectors]))
        asked = pd.DataFrame({"table": tables, "q": range(len(tables))})
        block = max(BLOCK_CELLS // (len(names) if not same_table else width), 1)
        kept = None
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if not same_table:
                    part = part.filter(part.column(1).is_valid())
                rows = _unit(_matrix(part.column(1), width))
                keys = part.column(0).to_numpy(zero_copy_only=False)
                if same_table:  # only pairs whose table matches are multiplied
                    lists = part.column(2)
                    named = pd.DataFrame({"row": pc.list_parent_indices(lists).to_numpy(), "table": lists.flatten().to_pandas()})
                    pairs = named.merge(asked, on="table").drop_duplicates(["row", "q"])
                    row, query = pairs["row"].to_numpy(np.int64), pairs["q"].to_numpy(np.int64)
                    score = np.round(np.einsum("ij,ij->i", rows[row], matrix[query]), 12)
                else:
                    # Equal vectors must tie whatever the block's shape, so the last bits of the product are dropped.
                    similar = np.round(rows @ matrix.T, 12)
                    least = np.partition(similar, -n, axis=0)[-n] if len(rows) > n else -np.inf
                    row, query = np.nonzero(similar >= least)
                    score = similar[row, query]
                near = pd.DataFrame({"q": query, key: keys[row], "score": score})
                near = near if kept is None else pd.concat([kept, near], ignore_index=True)
                kept = near.sort_values(["q", "score", key], ascending=[True, False, True]).groupby("q").head(n)
        if kept is not None and len(kept):
            found = kept.assign(query=np.array(names, dtype=object)[kept["q"]])[["query", key, "score"]]
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return run
