"""Vectors laid out by cells and by table names give what a full scan gives, and read less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletrail.operators import vectors
from tabletrail.sources.scratch import written

SCHEMA = "chunk_id string, embedding array<float>, canonical_tables array<string>"


def clustered(n=900, groups=12, width=8, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    rows = [(f"d{i:04d}", (middle[i % groups] + 0.05 * rng.normal(size=width)).astype("float32").tolist(), [f"t{i % 7}", "hot"] if i % 3 else [f"t{i % 7}"] * 2) for i in range(n)]
    rows += [(f"e{i}", rows[5][1], ["t1"]) for i in range(30)]  # equal vectors
    rows += [("none", None, ["hot"]), ("zero", [0.0] * width, ["hot", "t2"])]
    asked = [(f"q{i}", (middle[i] + 0.05 * rng.normal(size=width)).astype("float32").tolist(), ["hot", "t1", "absent"][i % 3]) for i in range(5)]
    return rows, asked


def result(frame):
    return {(r["query"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in frame.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    rows, asked = clustered()
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache(), spark.createDataFrame(asked, "query string, embedding array<float>, canonical string")


def test_cells_that_cannot_hold_a_nearer_vector_are_not_read(tables):
    docs, asked = tables
    cells = vectors.build_cells(docs, cells=12)
    assert cells.rows.count() == cells.sizes.sum() == 931 and cells.sizes[-1] == 1
    for n in (1, 20, 60):
        read = []
        assert result(vectors.nearest_in_cells(cells, asked, n, read=read)) == result(vectors.nearest(docs, asked, n))
        assert read[0] < read[1] / 2 if n < 60 else read[0] < read[1], read


def test_cells_are_exact_whatever_the_centres(spark, tables):
    docs, asked = tables
    more = asked.union(spark.createDataFrame([("zero", [0.0] * 8, None), ("none", None, None)], asked.schema))
    brute = result(vectors.nearest(docs, more.where("embedding IS NOT NULL"), 15))
    for cells, sample in ((1, 10), (40, 50), (5, 20_000)):
        laid_out = vectors.build_cells(docs, cells=cells, sample=sample)
        assert result(vectors.nearest_in_cells(laid_out, more, 15)) == brute
        assert result(vectors.nearest_in_cells(laid_out, more, 15, per_pass=2)) == brute
    assert vectors.nearest_in_cells(vectors.build_cells(docs.where("chunk_id IN ('zero', 'd0001')")), asked, 5).count() == 10
    assert vectors.nearest_in_cells(vectors.build_cells(docs, cells=3), asked.limit(0), 5).count() == 0


def test_a_table_filter_reads_the_asked_buckets_only(tables):
    docs, asked = tables
    laid_out = written(vectors.by_table(docs, 16), "by_table", by="bucket")
    found = vectors.with_table_in_buckets(laid_out, asked, 12, 16)
    assert result(found) == result(vectors.with_table(docs, asked, 12))
    held = laid_out.select("bucket").distinct().count()
    read = laid_out.where(F.col("bucket").isin([r[0] for r in asked.select(vectors.bucket_of("canonical", 16)).distinct().collect()]))
    assert read.select("bucket").distinct().count() < held
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
