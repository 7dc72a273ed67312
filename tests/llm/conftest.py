import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, q_n_words int, `__dropped` int, spans string"


def sentence(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choice(["an", "re", "to", "li", "ön", "sa", "ka", "mu"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(made))


def odd_texts() -> dict[int, str | None]:
    """Nulls, empty and very long texts, ties, repeated lines, exact and near copies, shared passages, runs of one character."""
    rng = random.Random(7)
    shared = sentence(rng, 70)
    base = sentence(rng, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if i % 6 else "other" for i, w in enumerate(words))
    texts: dict[int, str | None] = {
        1: None, 2: "", 3: " \n\t ", 4: "one", 5: "one", 6: "Two words", 7: "two WORDS", 8: base, 9: base, 10: near, 11: far,
        12: "a" * 700, 13: "a" * 350 + "b" + "a" * 350, 14: ("same line here now\n" * 40), 15: shared, 16: sentence(rng, 80) + " " + shared + " " + sentence(rng, 30),
        17: sentence(rng, 20) + " " + shared.upper() + " end", 18: "é" * 120 + sentence(rng, 10), 19: "x" + "é" * 120, 20: sentence(rng, 3000),
    }
    texts[21] = texts[20][500:9000]
    for i in range(22, 40):
        texts[i] = " ".join(w if j != i else "w" + str(i) for j, w in enumerate(words))  # a crowd of near copies
    for i in range(40, 60):
        texts[i] = sentence(rng, 90)
    for i in range(60, 80):
        texts[i] = base  # a crowd of copies
    return texts


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


def table(spark, texts, parts=5):
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "k", 1, 2, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names clash with what the operators make."""
    return table(spark, texts).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
