import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabletrail.functions.joins import lookup_join, salted_join, top_per_group
from tabletrail.operators import bm25, search, vectors

TEXTS = {f"d{i:02d}": " ".join(["common"] + ["rare"] * (i % 3) + [f"w{i % 7}", f"Übung_{i % 5}"] * (1 + i % 4)) for i in range(40)} | {"empty": ""}


def okapi(texts, words):
    docs = {k: re.findall(r"\w+", v.lower()) for k, v in texts.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        if set(words) & set(d):
            out[k] = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in words)
    return out


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, embedding_text string")
    index = bm25.build_index(docs)
    asked = {"q1": "common Rare w3", "q2": "übung_2 übung_2 common nowhere", "q3": "nowhere"}
    words = bm25.query_words(spark.createDataFrame(list(asked.items()), "query string, term string"))
    scores = bm25.scores(index, words)
    got = {(r["query"], r["chunk_id"]): r["score"] for r in scores.collect()}
    want = {(q, k): s for q, t in asked.items() for k, s in okapi(TEXTS, re.findall(r"\w+", t.lower())).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = bm25.normalised(scores).groupBy("query").agg(F.max("score").alias("m"), F.min("score").alias("l")).collect()
    assert {r["query"] for r in best} == {"q1", "q2"} and all(r["m"] == 1.0 and r["l"] > 0.01 for r in best)


def test_nearest_equals_brute_force_with_ties_and_passes(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8)).astype("float32")
    docs = [(f"d{i:03d}", base[i % 40].tolist(), [f"t{i % 3}"] if i % 3 else ["t0", "hot"]) for i in range(300)]
    docs.append(("none", None, ["hot"]))
    queries = [(f"q{i}", rng.normal(size=8).astype("float32").tolist(), ["hot", "t1", "absent"][i % 3]) for i in range(6)]
    d = spark.createDataFrame(docs, "chunk_id string, embedding array<float>, canonical_tables array<string>").repartition(5)
    q = spark.createDataFrame(queries, "query string, embedding array<float>, canonical string")

    def brute(same_table):
        out = set()
        for name, vector, table in queries:
            scored = []
            for key, v, tables in docs:
                if (same_table and table not in tables) or (v is None and not same_table):
                    continue
                a, b = np.array(vector, float), np.array(v if v is not None else np.zeros(8), float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / size) if size else 0.0, 9), key))
            out |= {(name, key, place + 1) for place, (_, key) in enumerate(sorted(scored)[:12])}
        return out

    for same_table in (False, True):
        for per_pass in (100, 2):
            found = vectors.nearest(d, q, 12, same_table=same_table, per_pass=per_pass)
            assert {(r["query"], r["chunk_id"], r["rank"]) for r in found.collect()} == brute(same_table)


def test_fusion(spark):
    frame = lambda rows: spark.createDataFrame(rows, "query string, chunk_id string, score double")
    semantic = frame([("q", "a", 0.5), ("q", "b", 0.9), ("q", "z", -0.2)])
    named = frame([("q", "a", 0.1), ("q", "c", 0.0)])
    words = frame([("q", "a", 1.0), ("q", "d", 0.6), ("q", "c", 0.0)])
    rows = search.fuse(semantic, named, words, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["hybrid_score"]) for r in rows] == [("a", 0.7), ("b", 0.54), ("c", 0.15), ("d", 0.15), ("z", -0.12)]
    rows = search.fuse(semantic, named, words, 1, semantic_weight=0.0, bm25_weight=1.0, table_weight=0.0).collect()
    assert [(r["chunk_id"], r["hybrid_score"]) for r in rows] == [("a", 1.0)]


def test_crowded_keys(spark):
    """One key holds most rows: joins and cuts stay exact, and the plan cuts before it shuffles."""
    rows = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id", (F.col("id") % 97).alias("v"))
    side = rows.select("k").distinct().withColumn("w", F.length("k"))
    plain = {tuple(r) for r in rows.join(side, "k").groupBy("k", "w").count().collect()}
    for joined in (salted_join(rows, side, ["k"], "id"), lookup_join(rows, side, ["k"], "id")):
        assert {tuple(r) for r in joined.groupBy("k", "w").count().collect()} == plain
    few = top_per_group(rows, ["k"], [F.desc("v"), F.asc("id")], 3)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in few.where("k = 'hot'").orderBy("rank").collect()] == sorted(i for i in range(20000) if i % 97 == 96 and i % 10 < 9)[:3]
    many = top_per_group(rows, ["k"], [F.desc("v"), F.asc("id")], 1500)
    hot = sorted((-(i % 97), i) for i in range(20000) if i % 10 < 9)[:1500]
    assert [r["id"] for r in many.where("k = 'hot'").orderBy("rank").collect()] == [i for _, i in hot]


def skewed_texts(n=1500):
    """A word in a third of all texts, uses and lengths that differ, rare words, and texts that are equal but for their key."""
    rng = np.random.default_rng(5)
    out = {}
    for i in range(n):
        words = [f"r{int(x)}" for x in rng.zipf(1.6, rng.integers(3, 90)) if x < 400]
        if i % 3 == 0:
            words += ["weir"] * int(rng.integers(1, 9))
        out[f"d{i:04d}"] = " ".join(words)
    return out | {f"e{i}": out["d0003"] for i in range(30)}


def test_the_best_documents_are_those_of_the_full_ranking(spark, monkeypatch):
    texts = skewed_texts()
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id string, embedding_text string"))
    asked = {"common": "weir", "both": "weir r37 r37", "rare": "r211", "many": " ".join(f"r{i}" for i in range(1, 30)), "most": "r1 weir", "none": "nowhere"}
    words = bm25.query_words(spark.createDataFrame(list(asked.items()), "query string, term string"))

    def expected(k):
        out = {}
        for q, text in asked.items():
            ranked = sorted((-round(s, 8), d) for d, s in okapi(texts, text.split()).items())[:k]
            out |= {(q, place + 1): (d, -s) for place, (s, d) in enumerate(ranked)}
        return out

    for k, spared in ((1, 3), (10, 3), (10, 1), (10, 10**9), (40, 1), (5000, 3)):
        monkeypatch.setattr(bm25.settings, "SPARED_POSTINGS", spared)
        found = {(r["query"], r["rank"]): (r["chunk_id"], round(r["score"], 8)) for r in bm25.top_scores(index, words, k).collect()}
        wanted = expected(k)
        assert {key: d for key, (d, _) in found.items()} == {key: d for key, (d, _) in wanted.items()}, (k, spared)
        assert all(abs(found[key][1] - wanted[key][1]) < 2e-8 for key in wanted)
    exact = {(r["query"], r["chunk_id"]): r["score"] for r in bm25.scores(index, words).collect()}
    some = spark.createDataFrame([(q, d) for q, d in list(exact)[:40]] + [("rare", "d0001"), ("none", "d0001")], "query string, chunk_id string")
    looked_up = {(r["query"], r["chunk_id"]): r["score"] for r in bm25.scores_of(index, bm25.ask(index, words), some).collect()}
    assert looked_up.keys() == {(r[0], r[1]) for r in some.collect()} & exact.keys()
    assert all(abs(s - exact[key]) < 1e-9 for key, s in looked_up.items())


def test_blocks_that_cannot_reach_the_threshold_are_not_scored(spark):
    texts = skewed_texts(6000)
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id string, embedding_text string"))
    asked = {"common": "weir", "both": "weir r211", "far": "weir r37"}
    words = bm25.query_words(spark.createDataFrame(list(asked.items()), "query string, term string"))
    bounded = bm25.bounds(index, bm25.ask(index, words))
    full = okapi(texts, ["weir"])
    least = {r["query"]: r["threshold"] for r in bm25.thresholds(bounded, 5).collect()}
    assert 0 < least["common"] <= sorted(full.values())[-5]
    scored = {(r["query"], r["term"]): r["postings"] for r in bm25.essential(bounded, bm25.thresholds(bounded, 5)).collect()}
    df = sum("weir" in t.split() for t in texts.values())
    assert df > len(texts) / 3 - 30 and scored["common", "weir"] < df / 4
    assert scored.get(("both", "weir"), 0) < df / 4, "a word held by a third of the documents is spared beside a rare one"


def test_word_evidence_is_all_that_can_reach_the_top(spark):
    texts = skewed_texts(600)
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id string, embedding_text string"))
    words = bm25.query_words(spark.createDataFrame([("a", "weir r2"), ("b", "r11 r30")], "query string, term string"))
    rng = np.random.default_rng(1)
    keys = sorted(texts)
    rows = [(q, str(d), float(s)) for q in "ab" for d, s in zip(rng.choice(keys, 12, replace=False), rng.uniform(-0.3, 1, 12), strict=True)]
    semantic = spark.createDataFrame(rows, "query string, chunk_id string, score double")
    named = spark.createDataFrame([("a", keys[3], 0.1), ("a", "unknown", 0.1), ("b", keys[9], -0.5)], "query string, chunk_id string, score double")
    whole = bm25.normalised(bm25.scores(index, words))
    for top_k, weights in ((1, {}), (6, {}), (15, {"bm25_weight": 2.0}), (6, {"semantic_weight": 0.0})):
        few = search.word_evidence(index, words, semantic, named, top_k)
        assert few.count() < whole.count()
        got, want = (search.fuse(semantic, named, w, top_k, **weights).orderBy("query", "rank").collect() for w in (few, whole))
        assert got == want
