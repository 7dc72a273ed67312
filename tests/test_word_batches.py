"""Words cut from Arrow batches are those that the JVM's expression finds."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabletrail.functions import word_batches
from tabletrail.functions.text import tokens
from tabletrail.operators import bm25, vectors

TEXTS = [
    None, "", " ", "one", "_a_ B2b, b2B; a", "end of one", "next starts", "...", "x" * 50, "A\x00b\tc\nd", "déjà VU déjà", "İstanbul ΣΊΣΥΦΟΣ ς", "１２ ²³ ½ x", "日本語 text 日本語",
    "naïve é ​zero", "\x7f~del", "a-b_c.d" * 30,
]


def some_texts() -> list[str | None]:
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choice("abAB01_ .,;\n\t(){}é") for _ in range(rng.randint(0, 400))) for _ in range(200)] + [None]


@pytest.mark.parametrize("limit", [1, 300, 1 << 21])
def test_words_are_those_of_the_expression(spark, monkeypatch, limit):
    monkeypatch.setattr(word_batches, "SLICE_BYTES", limit)
    rows = list(enumerate(some_texts()))
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    table = frame.select("id", tokens(F.col("text")).alias("expected"), *word_batches.word_columns("text")).toArrow().combine_chunks()
    found = {i: [] for i, _ in rows}
    for first, n, words, owner in word_batches.words_of_batch(table["_plain"].combine_chunks(), table["_words"].combine_chunks()):
        for word, row in zip(words.to_pylist(), owner.tolist(), strict=True):
            assert row < n
            found[table["id"][first + row].as_py()].append(word)
    assert found == {i: words or [] for i, words in zip(table["id"].to_pylist(), table["expected"].to_pylist(), strict=True)}


def test_a_sliced_array_is_read_from_its_place():
    plain, lists = pa.array(["no", "a b", None, "c"])[1:], pa.array([["no"], None, ["é", "a"], None], pa.list_(pa.string()))[1:]
    got = [(w, r) for _, _, words, rows in word_batches.words_of_batch(plain, lists) for w, r in zip(words.to_pylist(), rows.tolist(), strict=True)]
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("c", 2), ("é", 1)]


def test_postings_and_features_count_the_words(spark):
    rows = [(i, t, "kept") for i, t in enumerate(some_texts())]
    frame = spark.createDataFrame(rows, "id long, text string, more string").repartition(3)
    words = {r["id"]: r["w"] or [] for r in frame.select("id", tokens(F.col("text")).alias("w")).collect()}
    expected = {(w, i): (n, len(ws)) for i, ws in words.items() for w, n in Counter(ws).items()}
    found = bm25.postings_of(frame, "text", "id")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["term", "id", "tf", "dl", "level"]
    assert {(r["term"], r["id"]): (r["tf"], r["dl"]) for r in found.collect()} == expected
    counted = vectors.text_counts(frame, "text", 16, keep_text=False)
    assert counted.columns == ["id", "more", "counts"]
    for r in counted.collect():
        by_feature = Counter(vectors.feature_of(w, 16) for w in words[r["id"]])
        assert r["counts"] == [by_feature.get(f, 0) for f in range(16)] and r["more"] == "kept"
