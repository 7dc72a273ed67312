import random
import re
import zlib

import numpy as np
import pytest
from conftest import COLUMNS, table

from tabletrail.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(texts):
    found = {}
    for i, text in texts.items():
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(texts):
    counts, out = plain_counts(texts), {}
    near = {a: [b for b in counts if is_near(a, b)] for a in counts}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= 2 * counts[a] else None
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, counts[a], len(near[a]), counts.get(form[a]))
    return out


def crowded_texts():
    """Words a few edits apart, many of one signature (the same letters in other orders, long runs of a letter), in uneven counts."""
    rng = random.Random(9)
    words = ["gauge" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)]
    words += ["".join(rng.sample("abcdef", 6)) for _ in range(80)] + ["a" * n for n in range(3, 14)] + ["ÀÖöøÿ", "straße", "straÿe"]
    for w in list(words[:60]):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :], w[:k] + "y" + w[k:]]
    out = {}
    for i in range(60):
        picked = [rng.choice(words[: rng.choice([5, 40, len(words)])]) for _ in range(120)]
        out[i] = rng.choice([" ", ", ", "\n", "_", "1"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in picked)
    return out


def rows(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_groups_agree_with_plain_ones(spark):
    texts = crowded_texts()
    expected = plain(texts)
    assert any(v[1] != v[0] and v[0] for v in expected.values()), "some chain has two steps"
    assert rows(variants.grouped(table(spark, texts))) == expected
    assert rows(variants.grouped(table(spark, texts, 2))) == expected


def test_odd_texts_and_clashing_columns(docs, texts):
    assert rows(variants.grouped(docs)) == plain(texts)


def test_null_ids_repeated_rows_and_other_columns(spark):
    text = "river rivers riverr delta delta DELTA deltas " * 3
    frame = spark.createDataFrame([(None, text, 1, "x"), (5, text, 2, "y"), (5, text, 2, "y"), (6, None, 0, "z")], "doc_id long, text string, n long, word string")
    once = plain_counts({None: text + "|" + ""})
    found = {r["word"]: r["n"] for r in variants.counts(frame).collect()}
    assert found["delta"] >= 9 + 9 and set(once) <= set(found)


def test_nothing_gives_nothing(nothing, spark):
    assert variants.grouped(nothing).count() == 0
    assert variants.grouped(spark.createDataFrame([(1, "a b c", "", "", 5, "", 1, 1, "")], COLUMNS)).count() == 0


def test_every_near_pair_has_a_signature_in_common(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        w = "".join(rng.choice("abéz") for _ in range(rng.randint(5, 20)))
        k = rng.randrange(len(w))
        other = rng.choice([w[:k] + rng.choice("abézq") + w[k + 1 :], w[:k] + rng.choice("abézq") + w[k:]])
        if other != w:
            pairs.append((w, other))
    words = spark.createDataFrame([(w, 3) for w in sorted({x for p in pairs for x in p})], "word string, n long")
    keys = {}
    for r in variants.signatures(words).collect():
        keys.setdefault(r["word"], set()).add((r["key"], r["points"]))
    assert all(keys[a] & keys[b] for a, b in pairs)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"leaf{i}", "w30") for i in range(200)]
    found = {r["word"]: r["root"] for r in variants._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(found.values()) == {"w37"} and len(found) == 237


def test_checksums_carry_on():
    data = np.frombuffer("été|ab||longer run of bytes".encode(), np.uint8)
    starts, ends = np.array([0, 6, 9, 10]), np.array([5, 8, 9, len(data)])
    before = [b"12:", b"", b"x:", b"7:"]
    found = variants.checksums(data, starts, ends, np.array([zlib.crc32(b) for b in before], np.uint32))
    assert found.tolist() == [zlib.crc32(b + data[i:j].tobytes()) for b, i, j in zip(before, starts, ends, strict=True)]


@pytest.mark.parametrize("held", [1, 10])
def test_small_blocks_give_the_same_counts(spark, monkeypatch, held):
    texts = {i: t for i, t in crowded_texts().items() if i < 10}
    monkeypatch.setattr(variants, "HELD", held)
    found = {r["word"]: r["n"] for r in variants.counts(table(spark, texts)).collect()}
    assert {w: n for w, n in found.items() if n >= 3} == plain_counts(texts)
