import plain
import pytest
from conftest import table

import corpus_pipeline
from tabletrail.llm import quality


@pytest.fixture
def folder(spark, tmp_path, texts):
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[45].split(" ")[10:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_plain_versions(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    now = {i: t for i, t in texts.items() if i in good}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_copies", "repeats", "decontaminate", "pack"]

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        assert out.schema == docs.schema, name
        return spark.createDataFrame(out.collect(), docs.schema)

    docs = step("quality_rules", docs)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now
    docs = step("near_copies", docs)
    now = {i: now[i] for i, c in plain.near_components(now).items() if i == c}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now
    docs = step("repeats", docs)
    expected = plain.without_repeats(now)
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == set(now)
    for i, (n, removed, spans, _) in expected.items():
        assert 0 <= len(found[i].encode()) - (n - removed) <= 6 * max(spans, 1)
    docs = step("decontaminate", docs)
    left = {r["doc_id"] for r in docs.collect()}
    assert left == set(found) - {d for d, _, _ in plain.contained(found, {1: " ".join(texts[45].split(" ")[10:50])})} and 45 not in left
    packed = stages["pack"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == left
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == left


def test_near_copies_of_four_fifths_go(spark):
    words = [f"w{i}" for i in range(124)]
    changed = ["other" if i in (30, 90) else w for i, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(changed)}
    a, b = map(plain.shingles, texts.values())
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, table(spark, texts), "").collect()] == [1]


def test_empty_table(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
