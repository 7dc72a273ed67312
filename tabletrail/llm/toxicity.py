"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer turns a word into a symbol with a weight: insult, threat, target, negation, reported speech, or other.
Four small machines (target, negation, report, offence) read the symbols of a clause; their product is built once and run
over every clause that holds an offence. It gives out each offence's weight in one of the classes of `PATHS`: plain, aimed at
a target, negated, or reported. The document's figures are sums and maxima over its clauses, never over loose words, and a
logistic model turns them into a score.

Besides the seed words, the lexicon's insults are learned: word beginnings and whole words that training documents labelled
toxic hold significantly more often. Learning sees at most about `MAX_LABELLED` labelled rows, chosen by a hash of the id,
and never those whose crc32(doc_id as text) mod 3 is 1. No label, language, source or id enters a score.

Null and empty texts have no clause and get the score of a text without offence. Several labels of one id: any toxic one
counts. Without labels of both kinds the seed words' default weights are used. Rows with equal ids are scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail.llm.tasks import by_batch, dealt
from tabletrail.llm.words import LOWER, Slice, mix, prefix_codes, slices, span_hashes
from tabletrail.sources.scratch import written

MAX_LABELLED = 40_000
THRESHOLD = 0.7
STEM_BYTES = (4, 5, 6, 7)
SEED_WEIGHT = 4.0
NEGATION_REACH = 3

# Seed words of each symbol, in the languages of the corpus.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumb fool jerk bastard vermin filth dummkopf trottel abschaum versager idiota imbécil basura inútil crétin débile ordure"
THREATS = "kill hurt destroy beat stab shoot strangle burn umbringen töten schlagen matar golpear tuer frapper"
TARGETS = "you your yours yourself he him she her they them these those people du dich dir ihr euch sie tú te usted ustedes ellos tu toi vous ils elles"
NEGATIONS = "not never no nobody nothing without isn aren wasn don doesn didn nicht nie kein keine nunca jamás ne pas jamais"
REPORTS = "said says say told tells wrote writes quoted quote reported claims claimed called alleged sagte sagt schrieb dijo dice escribió dit disait écrit"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PATHS = ("plain", "aimed", "negated", "reported")
FIGURES = ("total", "strongest", *PATHS, "threats", "clauses")

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_STOP = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(b".!?;:\n", np.uint8))


def _tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running codes of the lower-cased bytes, starts and ends of runs of letters, their texts and clauses."""
    data = LOWER[part.data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    text = np.searchsorted(part.offsets, starts, side="right") - 1
    breaks = np.cumsum(_STOP[data]) if len(data) else np.empty(0, int)
    return prefix_codes(data), starts, ends, text, breaks[starts] + text


def _word_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(codes, starts, ends)


def _stem_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a beginning of `size` bytes and more after it, and its keys."""
    longer = np.flatnonzero(ends - starts > size)
    return longer, mix(span_hashes(codes, starts[longer], starts[longer] + size) + np.uint64(size))


def word_key(word: str) -> int:
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(span_hashes(prefix_codes(data), np.array([0]), np.array([len(data)]))[0])


def _seeds() -> dict[int, tuple[int, float]]:
    found: dict[int, tuple[int, float]] = {}
    for symbol, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
        for word in words.split():
            found[word_key(word)] = (symbol, SEED_WEIGHT if symbol == INSULT else SEED_WEIGHT / 4 if symbol == THREAT else 0.0)
    return found


class Grammar:
    """The product of the four machines. A state is (target seen, words the negation still reaches, report seen)."""

    def __init__(self) -> None:
        self.states = list(product((0, 1), range(NEGATION_REACH + 1), (0, 1)))
        number = {s: i for i, s in enumerate(self.states)}
        self.next = np.zeros((len(self.states), 6), np.int16)
        self.path = np.full((len(self.states), 6), -1, np.int8)
        for (target, reach, report), i in number.items():
            for symbol in range(6):
                after = (target or symbol == TARGET, NEGATION_REACH if symbol == NEGATION else max(reach - 1, 0), report or symbol == REPORT)
                self.next[i, symbol] = number[tuple(map(int, after))]
                if symbol in (INSULT, THREAT):
                    self.path[i, symbol] = 3 if report else 2 if reach else 1 if target else 0

    def clause(self, symbols: list[int], weights: list[float]) -> tuple[list[float], float]:
        """Weight given out on each path, and the threats' share. A target after the offence aims what was plain."""
        state, out, threats = 0, [0.0, 0.0, 0.0, 0.0], 0.0
        for symbol, weight in zip(symbols, weights, strict=True):
            if (path := self.path[state, symbol]) >= 0:
                out[path] += weight
                threats += weight * (symbol == THREAT)
            state = self.next[state, symbol]
        if self.states[state][0]:
            out[1] += out[0]
            out[0] = 0.0
        return out, threats


class Lexicon:
    """Keys of words and stems, sorted, with symbols and weights."""

    def __init__(self, entries: dict[int, tuple[int, float]]):
        self.keys = np.array(sorted(entries), np.uint64)
        self.symbols = np.array([entries[int(k)][0] for k in self.keys], np.int8)
        self.weights = np.array([entries[int(k)][1] for k in self.keys])

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def read(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word: its own entry's, or its heaviest beginning's."""
        symbols, weights = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        at = self.find(_word_keys(codes, starts, ends))
        hit = at >= 0
        symbols[hit], weights[hit] = self.symbols[at[hit]], self.weights[at[hit]]
        for size in STEM_BYTES:
            longer, keys = _stem_keys(codes, starts, ends, size)
            at = self.find(keys)
            heavier = (at >= 0) & (self.weights[at] > weights[longer])
            symbols[longer[heavier]], weights[longer[heavier]] = self.symbols[at[heavier]], self.weights[at[heavier]]
        return symbols, weights


def figures(column: pa.Array, lexicon: Lexicon, grammar: Grammar) -> np.ndarray:
    """FIGURES of each text."""
    out = np.zeros((len(column), len(FIGURES)))
    for part in slices(column):
        codes, starts, ends, text, clause = _tokens(part)
        symbols, weights = lexicon.read(codes, starts, ends)
        offence = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        for c in np.unique(clause[offence]):
            a, b = np.searchsorted(clause, [c, c + 1])
            paths, threats = grammar.clause(symbols[a:b].tolist(), weights[a:b].tolist())
            row = out[part.first + text[a]]
            total = sum(paths)
            row[0] += total
            row[1] = max(row[1], total)
            row[2:6] += paths
            row[6] += threats
            row[7] += 1
    return np.log1p(out)


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from. The chosen labels are at most about `limit` rows, so they are broadcast."""
    key = F.col("doc_id").cast("string")
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key) % 3 != 1)).select("doc_id", F.col("toxic").cast("int").alias("__toxic"))
    there = usable.count()
    if there > limit:
        usable = usable.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * limit / there))
    chosen = usable.groupBy("doc_id").agg(F.max("__toxic").alias("__toxic"))
    return docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("__toxic").alias("toxic"))


def _text_stems(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct word and stem keys of each text."""
    for part in slices(column):
        codes, starts, ends, text, _ = _tokens(part)
        owners, keys = [text], [_word_keys(codes, starts, ends)]
        for size in STEM_BYTES:
            longer, found = _stem_keys(codes, starts, ends, size)
            owners.append(text[longer])
            keys.append(found)
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(part) + 1))
        key = key[order]
        for i in range(len(part)):
            yield np.unique(key[bounds[i] : bounds[i + 1]])


def _counted(rows: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(stem, n): texts that hold each stem, pre-aggregated in the task; of `among` (sorted) only, if given."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(list(_text_stems(batch.column(0))))
        if among is not None:
            found = found[among[np.minimum(np.searchsorted(among, found), len(among) - 1)] == found]
        keys, n = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["stem", "n"])

    return by_batch(rows.select("text"), work, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learn_insults(sample: DataFrame) -> dict[int, float]:
    """Stems that toxic texts hold more often than the label's share explains: the likelihood ratio must stand out among all
    the stems tried. Their number is bounded by the sample's."""
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    toxic = _counted(sample.where("toxic = 1"))
    tried = toxic.count()
    rows = toxic.where(F.col("n") >= 3).toPandas()
    stems, a = rows["stem"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float)
    order = np.argsort(stems)
    stems, a = stems[order], a[order]
    if not len(stems):
        return {}
    rows = _counted(sample.where("toxic = 0"), stems).toPandas()
    b = np.zeros(len(stems))
    b[np.searchsorted(stems, rows["stem"].to_numpy(np.int64).view(np.uint64))] = rows["n"]
    share = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (a * np.log(a / ((a + b) * share)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
    weight = np.log((a + 0.1) / (n1 + 0.2)) - np.log((b + 0.1) / (n0 + 0.2))
    strong = (ratio > 2 * math.log(tried + 1)) & (weight > 2.5)
    return dict(zip(stems[strong].tolist(), weight[strong].tolist(), strict=True))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights, bias last, by Newton's method with a ridge on all but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sample = written(_sample(dealt(docs.select("doc_id", "text")), labels, limit), "toxic_sample")
    entries = _seeds()
    learned = learn_insults(sample)
    entries.update({k: (INSULT, w) for k, w in learned.items() if entries.get(k, (INSULT, 0))[0] in (INSULT, THREAT)})
    lexicon, grammar = Lexicon(entries), Grammar()
    names = [f"f{i}" for i in range(len(FIGURES))]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = figures(batch.column(0), lexicon, grammar)
        yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(len(names))), batch.column(1)], names=[*names, "toxic"])

    rows = by_batch(sample, each, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()
    y = rows["toxic"].to_numpy(float)
    model = fit_logistic(rows[names].to_numpy(), y) if len(set(y)) == 2 else np.array([1.0, 1.0, *[0.0] * (len(FIGURES) - 2), -3.0])

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = figures(batch.column(1), lexicon, grammar) @ model[:-1] + model[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    out = by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
