import collections
import math
import random
import re

import numpy as np
import pytest
from conftest import table

from tabletrail.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score int"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(texts, items, k=10):
    counts = {i: collections.Counter(terms(t)) for i, t in texts.items()}
    n = {i: sum(c.values()) for i, c in counts.items()}
    docs, total = sum(v > 0 for v in n.values()), sum(n.values())
    df = collections.Counter(t for c in counts.values() for t in c)
    out = {}
    for item, text in items.items():
        score = collections.Counter()
        for t in set(terms(text)):
            w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
            for i, c in counts.items():
                if c[t]:
                    m = 100 - 90 + (90 * n[i] * docs) // total
                    score[i] += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
        best = sorted(((s, i) for i, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(item, rank): (i, s) for rank, (s, i) in enumerate(best, 1)}
    return out


def found(frame):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in frame.collect()}


def asked_of(texts):
    rng = random.Random(2)
    out = {i: " ".join(rng.sample(terms(t), min(12, len(terms(t))))) for i, t in texts.items() if t and i % 3 == 0}
    return out | {900: None, 901: "", 902: "nowhere at all", 903: "é", 904: "one", 905: " ".join(terms(texts[20])[:900])}


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items.items()], ITEMS)


def test_ranking_agrees_with_the_plain_one(spark, docs, texts):
    items = asked_of(texts)
    assert found(lexical_search.ranked(docs, items_table(spark, items))) == plain(texts, items)
    assert found(lexical_search.ranked(table(spark, texts, 2), items_table(spark, items), 3)) == plain(texts, items, 3)


@pytest.mark.parametrize(("size", "postings"), [(1, 1 << 21), (3, 1 << 21), (1 << 14, 20)])
def test_small_blocks_and_passes_give_the_same(spark, texts, monkeypatch, size, postings):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", size)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    items = asked_of(texts)
    assert found(lexical_search.ranked(table(spark, texts, 2), items_table(spark, items), limit=150)) == plain(texts, items)


def test_pair_bounds_skip_more_and_lose_nothing(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(3, 60))) for i in range(1200)}
    items = {i: " ".join(rng.sample(words, 14)) for i in range(40)}
    rows = lexical_search.item_terms(items_table(spark, items)).collect()
    asked = np.unique(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    made = lexical_search.blocks(table(spark, texts, 4), asked)
    stats = lexical_search._statistics(made, asked)
    places = {}
    for r in rows:
        places.setdefault(r["item_id"], []).append(int(np.searchsorted(asked, np.uint64(r["key"] % (1 << 64)))))
    asked_items = [lexical_search.Item(i, sorted(p, key=lambda t: (stats.weights[t], t))) for i, p in places.items()]
    full, bounds = lexical_search._with_pairs(made, asked_items, stats, 10)
    thresholds, pairs = lexical_search._thresholds(bounds, 10), lexical_search._pairs(asked_items)
    expected = plain(texts, items)
    assert len(thresholds) == 40 and all(t <= expected[i, 10][1] for i, t in thresholds.items())
    read = {"pair": 0, "single": 0, "all": 0}
    for row in full.collect():
        block = lexical_search.Block(row.asDict(), stats)
        stored = np.frombuffer(row["joint"], np.int64)
        joint = {p: int(stored[i]) for p, i in pairs.items()}
        for (a, b), most in joint.items():
            both = [s for r, s in zip(*block.intersection(a, b), strict=True)]
            assert most == max(both, default=0)
        for item in asked_items:
            with_pairs = lexical_search.best_of(block, item, joint, thresholds[item.item_id], 10)
            alone = lexical_search.best_of(block, item, None, thresholds[item.item_id], 10)
            assert [x.tolist() for x in with_pairs[:2]] == [x.tolist() for x in alone[:2]]
            read["pair"] += with_pairs[2]
            read["single"] += alone[2]
            read["all"] += sum(b - a for t in item.terms for a, b in [block.spans.get(t, (0, 0))])
    assert read["pair"] < read["single"] < read["all"] / 2, read
    assert found(lexical_search.ranked(table(spark, texts, 4), items_table(spark, items))) == expected


def test_ties_repeated_rows_and_nulls(spark):
    texts = [(7, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (5, "alpha"), (None, "alpha beta"), (9, None), (8, ""), (1, "gamma delta")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (1, "beta beta"), (None, "gamma"), (2, "epsilon")], "item_id long, text string")
    rows = lexical_search.ranked(docs, items).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(1, 1, 3), (1, 2, 3), (1, 3, 7), (1, 4, 5)]
    assert rows[0]["score"] == rows[2]["score"]
    numbered = {10 + i: t for i, (_, t) in enumerate(texts)}
    assert rows[0]["score"] == plain(numbered, {1: "alpha beta"})[1, 1][1]


def test_nothing_gives_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], ITEMS)
    some = items_table(spark, {1: "one two"})
    for frame in (lexical_search.ranked(nothing, some), lexical_search.ranked(docs, none), lexical_search.ranked(nothing, none)):
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.count() == 0
