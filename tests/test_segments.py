"""Indexes made of segments give what one index of the same scripts gives."""

import os
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabletrail.operators import bm25, vectors
from tabletrail.plans.ingest import ingest
from tabletrail.plans.lookup import find, open_index, query_rows
from tabletrail.sources import snapshots

NAMES = ["basin", "flow", "gauge", "level", "reading", "station", "weir"]


def script(i, word="SELECT"):
    a, b = NAMES[i % 7], NAMES[(i * 3 + 1) % 7]
    extra = f"INSERT INTO {a}_{i % 5} {word} * FROM {b} JOIN {a} USING (k{i});\n" * (1 + i % 3)
    return (f"/t/{'old' if i % 10 else 'new'}/job_{i}.sql", f"{extra}DELETE FROM {b}_{i % 4} WHERE t < {i};")


def table(spark, rows):
    return spark.createDataFrame(rows, "file_path string, source string").repartition(2)


def facts(spark, root):
    """All that a search reads, as plain values."""
    index = open_index(spark, root)
    asked = bm25.query_words(spark.createDataFrame([("q1", "insert gauge level"), ("q2", "weir"), ("q3", "k7 k8 k9 nowhere")], "query string, term string"))
    rounded = [
        index.documents.select("chunk_id", "embedding_text", "canonical_tables"),
        index.words.postings.select("term", "chunk_id", "tf", "dl", "level"),
        index.words.terms.select("term", "df", F.round("idf", 9)),
        index.words.totals.select("documents", F.round("avgdl", 9), F.round("avg_idf", 9)),
        index.vectors.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 9))),
        bm25.scores(index.words, asked).select("query", "chunk_id", F.round("score", 9)),
        bm25.top_scores(index.words, asked, 7).select("query", "chunk_id", F.round("score", 9), "rank"),
        find(index, query_rows(spark, ["gauge", "level_1"]), top_k=8).select("query", "rank", "chunk_id", "hybrid_score", "matched_canonical"),
    ]
    return [sorted(map(repr, (tuple(r) for r in f.collect()))) for f in rounded]


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    """Three runs into one root, and one run of the same scripts into another."""
    base = tmp_path_factory.mktemp("segments")
    parts, whole = str(base / "parts"), str(base / "whole")
    first = [script(i) for i in range(60)]
    ingest(spark, table(spark, first), parts, buckets=2, features=32)
    kept = files_below(parts)
    again = [script(7, "SELECT DISTINCT"), script(60)]
    ingest(spark, table(spark, again), parts, buckets=2, features=32, keep_stored=True)
    third = [script(7, "WITH x AS (SELECT 1) SELECT"), script(8, "SELECT DISTINCT"), script(61)]
    ingest(spark, table(spark, third), parts, buckets=2, features=32, keep_stored=True)
    last = {**dict(first), **dict(again), **dict(third)}
    ingest(spark, table(spark, list(last.items())), whole, buckets=2, features=32)
    return parts, whole, kept


@pytest.fixture(scope="module")
def expected(spark, roots):
    return facts(spark, roots[1])


def test_segments_read_like_one_index(spark, roots, expected):
    parts, whole, _ = roots
    version = snapshots.current_version(spark, parts)
    assert len(version.segments) == 3 and sorted(version.removed.values())[0] == 0 and sum(version.removed.values()) > 0
    assert snapshots.document_count(spark, parts) == snapshots.document_count(spark, whole) == open_index(spark, parts).documents.count()
    for mine, other in zip(facts(spark, parts), expected, strict=True):
        assert mine == other


def test_adding_files_writes_only_them(spark, roots):
    parts, _, kept = roots
    now = files_below(parts)
    assert {path: t for path, t in now.items() if path in kept} == kept, "nothing stored is written again"
    version = snapshots.current_version(spark, parts)
    first, *later = sorted(version.segments)
    for part in ("documents", "postings", "vectors"):
        added = sum(version.part(s, part).count() for s in later)
        assert added < version.part(first, part).count() / 8
    gone = spark.read.parquet(f"{version.path}/removed").count()
    assert gone == sum(version.removed.values()) < 20


def test_registry_of_segments_forgets_nothing(spark, roots):
    parts, whole, _ = roots
    mine, other = snapshots.read_registry(spark, parts), snapshots.read_registry(spark, whole)
    rows = lambda frame: {tuple(r) for r in frame.collect()}
    assert rows(mine.names) >= rows(other.names) and rows(mine.files) >= rows(other.files)
    assert rows(mine.current.select("alias")) == rows(mine.names.select("alias"))
    assert mine.current.count() == mine.current.select("alias").distinct().count()


def test_merging_and_pruning_change_no_result(spark, roots, expected):
    parts = roots[0]
    dead = snapshots.begin(spark, parts)
    dead.write_documents(open_index(spark, parts).documents.drop("bucket").limit(1))
    path = snapshots.merge(spark, parts)
    assert snapshots.current_path(spark, parts) == path and len(snapshots.current_version(spark, parts).segments) == 1
    snapshots.prune(spark, parts, keep=1, stale_hours=0)
    assert len(os.listdir(f"{parts}/segments")) == 1 and not os.path.exists(dead.path)
    assert facts(spark, parts) == expected


def test_many_runs_are_merged_and_layouts_must_agree(spark, tmp_path):
    root = str(tmp_path / "index")
    for i in range(3):
        ingest(spark, table(spark, [script(i)]), root, buckets=2, features=8, keep_stored=True, max_segments=2)
    assert len(snapshots.current_version(spark, root).segments) == 1
    assert {r["file_path"] for r in snapshots.read_documents(spark, root).select("file_path").collect()} == {script(i)[0] for i in range(3)}
    with pytest.raises(ValueError, match="2 buckets and 8 features"):
        ingest(spark, table(spark, [script(5)]), root, buckets=3, features=8, keep_stored=True)
    ingest(spark, table(spark, [script(1)]), root, buckets=2, features=8, keep_stored=True, rebuild=True)
    names = {r["canonical"] for r in snapshots.read_registry(spark, root).names.collect()}
    assert names == {t for r in snapshots.read_documents(spark, root).collect() for t in r["canonical_tables"]}


def test_counts_of_text_features_add_up(spark):
    rows = spark.createDataFrame([("a", "Gauge gauge level"), ("b", None), ("c", ""), ("d", "weir " * 500)], "chunk_id string, text string")
    counted = {r["chunk_id"]: r["counts"] for r in vectors.text_counts(rows, "text", 16).collect()}
    place = lambda w: vectors.feature_of(w, 16)
    assert counted["a"][place("gauge")] >= 2 and sum(counted["a"]) == 3 and counted["d"][place("weir")] == 500
    assert sum(counted["b"]) == sum(counted["c"]) == 0
    model = vectors.fit_text_vectors(rows, "text", 16)
    units = {r["chunk_id"]: r["embedding"] for r in vectors.text_vectors(model, rows, "text").collect()}
    assert abs(sum(x * x for x in units["a"]) - 1) < 1e-12 and not any(units["b"])


def test_parts_are_laid_out_by_the_tasks_that_make_them(spark, tmp_path):
    """Rows go to their bucket's files as they come, none is moved between tasks, and files are compact; the setting is put back."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("concat('word', id % 50) term", "concat('/a/b/job_', id, '.sql') chunk_id", "1 tf", "3 dl", "4 level")
    staging = snapshots.begin(spark, f"file://{tmp_path}/index", buckets=3)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    staging.write_postings(rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    folder = pathlib.Path(staging.path.removeprefix("file://")) / "postings"
    assert {len(list(bucket.glob("*.parquet"))) for bucket in folder.glob("bucket=*")} == {4}
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in folder.rglob("*.parquet") for i in range(5)]
    assert {c.compression for c in columns} == {"ZSTD"}
    back = spark.read.parquet(f"{staging.path}/postings").drop("bucket")
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
