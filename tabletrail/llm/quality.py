"""Quality rules by weak supervision.

Each rule looks at one figure of a text and votes that the text is good (1), bad (-1), or abstains (0). The votes of all
documents are counted by pattern in Spark; expectation-maximisation on the counts estimates, without labels, how often each
rule errs on good and on bad documents. A document's posterior probability of being good follows from its votes, and it is
kept at `KEEP` or more, so one odd vote does not reject it, as it would if every rule had to pass.

The counts have at most 3**len(RULES) rows, whatever the corpus. A rule that abstains says nothing about the document.
Null texts have no words. Documents without any vote against them are kept. Rows with equal ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabletrail.llm.tasks import by_batch, dealt
from tabletrail.llm.words import grams, mix, prefix_codes, slices, span_hashes, words_of
from tabletrail.sources.scratch import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_plain", "n_upper", "n_ascii_letters", "n_distinct_words", "n_bare_words"]


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.col(whole), F.lit(0.0))


def _vote(good: Column, bad: Column, known: Column) -> Column:
    return F.when(~known, 0).when(bad, -1).when(good, 1).otherwise(0)


def _rule(figure: Column, good_below: float, bad_above: float, known: Column) -> Column:
    return _vote(figure < good_below, figure > bad_above, known)


def _rules() -> dict[str, Column]:
    some = F.col("n_words") > 0
    per_word, length = _share("n_symbols", "n_words"), _share("word_chars", "n_words")
    plain, distinct = _share("n_plain", "word_chars"), _share("n_distinct_words", "n_words")
    per_mark = F.col("n_words") / F.greatest("n_marks", F.lit(1))
    return {
        "long_enough": _vote(F.col("n_words") >= 2 * MIN_WORDS, F.col("n_words") < MIN_WORDS, F.lit(True)),
        "few_symbols": _rule(per_word, 0.03, 0.1, some),
        "few_repeats": _rule(_share("n_repeat_words", "n_words"), 0.15, 0.3, some),
        "few_dup_lines": _rule(_share("n_dup_lines", "n_lines"), 0.1, 0.3, F.col("n_lines") >= 3),
        "word_length": _vote((length >= 3.5) & (length <= 8), (length < 2.5) | (length > 12), some),
        "plain_characters": _vote(plain > 0.88, plain < 0.75, some),
        "few_capitals": _rule(_share("n_upper", "n_ascii_letters"), 0.15, 0.4, F.col("n_ascii_letters") > 0),
        "sentence_length": _rule(per_mark, 25, 40, F.col("n_words") >= MIN_WORDS),
        "lettered_words": _rule(_share("n_bare_words", "n_words"), 0.05, 0.2, some),
        "varied_words": _vote(distinct > 0.3, distinct < 0.1, some & (F.col("n_words") <= 2000)),
    }


RULES = ["long_enough", "few_symbols", "few_repeats", "few_dup_lines", "word_length", "plain_characters", "few_capitals", "sentence_length", "lettered_words", "varied_words"]

_SYMBOL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SYMBOLS, np.uint8))
_MARK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(b".!?", np.uint8))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(b"0123456789", np.uint8))
_POINT = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_PLAIN = _LETTER | (_POINT & (np.arange(256) >= 0x80))


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _later_copies(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many of its entries equal an earlier one of the same text."""
    keys = value ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    return np.bincount(text, minlength=n) - np.bincount(text[order[first]], minlength=n)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The figures of `COUNTS` for each text."""
    out = {name: np.zeros(len(column), np.int64) for name in COUNTS}
    for part in slices(column):
        n, data, at = len(part), part.data, part.offsets
        words = words_of(part, lower=False)
        here = {"n_words": words.counts}
        text_of_word = np.repeat(np.arange(n), words.counts)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.starts] += 1
        inside[words.ends] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)

        def per_text(flags: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            return np.diff(_running(flags)[at])

        here["word_chars"] = per_text(_POINT[data] & inside)
        for name, kind in (("n_symbols", _SYMBOL), ("n_marks", _MARK), ("n_plain", _PLAIN), ("n_upper", _UPPER), ("n_ascii_letters", _LETTER)):
            here[name] = per_text(kind[data])
        lettered = _running(_PLAIN[data] | _DIGIT[data])
        here["n_bare_words"] = np.bincount(text_of_word, weights=lettered[words.ends] == lettered[words.starts], minlength=n).astype(np.int64)
        # lines with a word
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([at[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
        count = _running(inside)
        filled = count[ends] > count[starts]
        starts, ends = starts[filled], ends[filled]
        owner = np.searchsorted(at, starts, side="right") - 1
        here["n_lines"] = np.bincount(owner, minlength=n)
        here["n_dup_lines"] = _later_copies(owner, span_hashes(prefix_codes(data), starts, ends), n)
        here["n_distinct_words"] = here["n_words"] - _later_copies(text_of_word, words.hashes, n)
        # words in three-word windows found twice or more in their text
        run = grams(words.hashes, 3)
        own = np.flatnonzero(text_of_word[2:] == text_of_word[:-2]) if len(run) else np.empty(0, int)
        keys = run[own] ^ mix(text_of_word[own].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words.hashes) + 3, bool)
        for j in range(3):
            covered[own[twice] + j] = True
        here["n_repeat_words"] = np.bincount(text_of_word, weights=covered[: len(text_of_word)], minlength=n).astype(np.int64)
        for name, values in here.items():
            out[name][part.first : part.first + n] = values
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' other columns as they are, the text left out, and the figures of `COUNTS` beside them, prefixed by `q_`."""
    rest = [field for field in docs.schema.fields if field.name != text]
    names = [f"q_{name}" for name in COUNTS]
    schema = StructType([*rest, *(StructField(name, LongType()) for name in names)])
    keep = [field.name for field in rest]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = text_counts(batch.column(batch.schema.get_field_index(text)))
        columns = [batch.column(batch.schema.get_field_index(name)) for name in keep]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[name]) for name in COUNTS)], names=[*keep, *names])

    return by_batch(docs, work, schema)


def with_votes(counted: DataFrame) -> DataFrame:
    """`votes`: one byte per rule, in the order of RULES."""
    plain = counted.withColumnsRenamed({f"q_{name}": name for name in COUNTS})
    rules = _rules()
    return plain.withColumn("votes", F.array(*(rules[name].cast("byte") for name in RULES)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior log odds of good, and for each rule the log odds that its vote -1, 0, 1 adds. Votes given the class are taken as
    independent; whether a rule abstains does not depend on the class. A few made-up votes for each rule, nine of ten of them
    right on good documents, keep rates off 0 and 1 on small or one-sided tables."""
    rules = patterns.shape[1]
    bad, good = patterns == -1, patterns == 1
    p = np.where(bad.any(axis=1), 0.1, 0.95)  # of being good, to begin with: any vote against makes a document suspect
    odds, weights = 0.0, np.zeros((rules, 3))
    for _ in range(rounds):
        w_good, w_bad = counts * p, counts * (1 - p)
        prior = (w_good.sum() + 1.8) / (counts.sum() + 2)
        # share of votes against, among good and among bad documents on which the rule votes
        on_good = (w_good @ bad + 0.2) / (w_good @ (bad | good) + 2)
        on_bad = (w_bad @ bad + 1) / (w_bad @ (bad | good) + 2)
        on_bad = np.maximum(on_bad, on_good)  # a vote against never speaks for a document
        weights[:, 0] = np.log(on_good / on_bad)
        weights[:, 2] = np.log((1 - on_good) / (1 - on_bad))
        odds = np.log(prior / (1 - prior))
        score = odds + bad @ weights[:, 0] + good @ weights[:, 2]
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        new[~bad.any(axis=1)] = np.maximum(new[~bad.any(axis=1)], KEEP)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return float(odds), weights


def fit(voted: DataFrame) -> tuple[float, np.ndarray]:
    """Counts the vote patterns (at most 3**len(RULES) rows) and estimates the rules' accuracies."""
    rows = voted.groupBy("votes").count().toPandas()
    if rows.empty:
        return 0.0, np.zeros((len(RULES), 3))
    return estimate(np.array(rows["votes"].tolist(), np.int8), rows["count"].to_numpy(float))


def probability(model: tuple[float, np.ndarray]) -> Column:
    odds, weights = model
    total = F.lit(odds)
    for j in range(len(RULES)):
        vote = F.col("votes")[j]
        total = total + F.when(vote == -1, float(weights[j, 0])).when(vote == 1, float(weights[j, 2])).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-total))
    return F.when(F.array_contains("votes", F.lit(-1).cast("byte")), posterior).otherwise(F.greatest(posterior, F.lit(KEEP)))


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, quality_probability, kept."""
    counted = with_counts(dealt(docs.select("doc_id", "text")))
    voted = written(with_votes(counted), "quality_votes")
    model = fit(voted)
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("quality_probability", probability(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= KEEP))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Their texts are read twice rather than stored or joined."""
    counted = with_counts(dealt(docs.select("text")))
    model = fit(with_votes(counted))
    columns = docs.columns
    names, text = [f"c{i}" for i in range(len(columns))], columns.index("text")
    plain = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(columns, names, strict=True)))
    schema = StructType([*plain.schema.fields, *(StructField(name, LongType()) for name in COUNTS)])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = text_counts(batch.column(text))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[name]) for name in COUNTS)], names=[*names, *COUNTS])

    rules = _rules()
    voted = by_batch(dealt(plain), work, schema).withColumn("votes", F.array(*(rules[name].cast("byte") for name in RULES)))
    kept = voted.where(~base_failed() & (probability(model) >= KEEP))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)))
