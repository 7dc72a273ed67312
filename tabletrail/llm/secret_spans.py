"""Secrets in texts: three fixed patterns, and further spans that look like what the patterns found.

The values that the patterns find are credentials labelled with their kind. From a sample of them a probabilistic automaton is
inferred for each kind: the values' prefix tree, whose states are merged where their frequencies are compatible (Hoeffding's
bound, on the states and on all that follows them). A further automaton is inferred the same way from runs that no pattern
touches. Every run of credential characters in every text is then scored: by its likelihood a symbol under each kind's
automaton, and by the ratio to its likelihood as an ordinary run. A run that is as likely as the kind's own values are, and
far likelier than as an ordinary run, is a span of kind `format`.

Sampling: learning sees at most MAX_LABELLED distinct values a kind, and as many ordinary runs, of at most LONGEST characters:
those with the least hashes, so the sample does not depend on how the table is dealt. Scoring sees all runs of all texts.

Null and empty texts have no spans. Positions are code points, ends exclusive; a span of the fixed patterns is the whole match.
Rows with equal ids are searched one by one. Without a value of any kind, or without ordinary runs, nothing is added. An empty
table gives an empty result, other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail.functions.joins import top_per_group
from tabletrail.llm.tasks import by_batch, dealt
from tabletrail.llm.words import Slice, prefix_codes, slices, span_hashes
from tabletrail.sources.scratch import written

MAX_LABELLED = 2000
LONGEST = 200
LEAST_RUN = 8
#: Merging: the chance of keeping two states apart though they are equal.
ALPHA = 0.05
#: Added spans are this much likelier as a credential than as an ordinary run (natural logarithm), the prior odds against one.
LEAST_RATIO = 20.0
#: Share of a kind's own values that are less likely, symbol by symbol, than a run may be.
UNUSUAL = 0.02

# Kinds in the order of equal starts, and their patterns.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

_NUMBER = np.full(256, -1, np.int16)
_NUMBER[np.frombuffer(SYMBOLS, np.uint8)] = np.arange(len(SYMBOLS))
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
END = len(SYMBOLS)


# --- Automata ------------------------------------------------------------------


class _Tree:
    """Prefix tree with counts; states are merged in place."""

    def __init__(self, values: Iterable[bytes]):
        self.steps: list[dict[int, list[int]]] = [{}]  # symbol -> [state, passes]
        self.ends = [0]
        for value in values:
            at = 0
            for s in _NUMBER[np.frombuffer(value, np.uint8)].tolist():
                step = self.steps[at].get(s)
                if step is None:
                    step = self.steps[at][s] = [len(self.ends), 0]
                    self.steps.append({})
                    self.ends.append(0)
                step[1] += 1
                at = step[0]
            self.ends[at] += 1

    def passes(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.steps[state].values())

    def compatible(self, a: int, b: int, width: float) -> bool:
        """Whether no frequency of the two states, or of what follows them, is further apart than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passes(a), self.passes(b)
            if not n or not m:
                continue
            bound = width * (n**-0.5 + m**-0.5)
            if bound >= 1:
                continue  # too few to tell; what follows is rarer still
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            x, y = self.steps[a], self.steps[b]
            for s in x.keys() | y.keys():
                if abs(x.get(s, (0, 0))[1] / n - y.get(s, (0, 0))[1] / m) > bound:
                    return False
                if s in x and s in y:
                    todo.append((x[s][0], y[s][0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds state b, the root of a tree, and all that follows it to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for s, (to, n) in self.steps[b].items():
                if s in self.steps[a]:
                    self.steps[a][s][1] += n
                    todo.append((self.steps[a][s][0], to))
                else:
                    self.steps[a][s] = [to, n]


@dataclass
class Automaton:
    """next[state, symbol] and log[state, symbol], natural logarithms; END closes a run. The last state is what was never seen."""

    next: np.ndarray
    log: np.ndarray
    #: Likelihood a symbol that only UNUSUAL of the values it was learned from stay below.
    usual: float = -np.inf


def infer(values: list[bytes], alpha: float = ALPHA) -> Automaton:
    """States are settled from the most visited on: each is merged with the state before it if compatible, else with the first
    settled one that is, else it is settled as a state of its own."""
    tree = _Tree(sorted(values))
    width = (0.5 * np.log(2 / alpha)) ** 0.5
    settled, known = [0], {0}
    while True:
        open_steps = [(step[1], -p, -s) for p in settled for s, step in tree.steps[p].items() if step[0] not in known]
        if not open_steps:
            break
        _, p, s = max(open_steps)
        parent, symbol = -p, -s
        state = tree.steps[parent][symbol][0]
        same = next((x for x in [parent, *settled] if tree.compatible(x, state, width)), None)
        if same is None:
            settled.append(state)
            known.add(state)
        else:
            tree.steps[parent][symbol][0] = same
            tree.fold(same, state)
    place = {state: i for i, state in enumerate(settled)}
    counts = np.zeros((len(settled) + 1, END + 1))
    follow = np.full((len(settled) + 1, END), len(settled), np.int32)
    for state, i in place.items():
        counts[i, END] = tree.ends[state]
        for s, (to, n) in tree.steps[state].items():
            counts[i, s], follow[i, s] = n, place[to]
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    made = Automaton(follow, np.log(share))
    data, starts, ends = _joined(values)
    made.usual = float(np.quantile(likelihood(made, data, starts, ends) / (ends - starts + 1), UNUSUAL)) if values else np.inf
    return made


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(v) for v in values])
    return np.frombuffer(b"".join(values), np.uint8), ends - [len(v) for v in values], ends


def likelihood(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each run data[start:end]; all runs advance together, the ended ones drop out."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    symbols, state, total = _NUMBER[data], np.zeros(len(order), np.int32), np.zeros(len(order))
    alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # runs longer than j
    for j, n in enumerate(alive.tolist()):
        s = symbols[at[:n] + j]
        total[:n] += automaton.log[state[:n], s]
        state[:n] = automaton.next[state[:n], s]
    total += automaton.log[state, END]
    out = np.empty(len(order))
    out[order] = total
    return out


# --- Spans of a slice of texts -------------------------------------------------


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` bytes; none goes from one text into the next."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


@dataclass
class Found:
    """Base spans of a slice (kind, byte start, byte end, value's start), and the runs of credential characters clear of them."""

    base: list[tuple[int, int, int, int]]
    starts: np.ndarray
    ends: np.ndarray


def _found(part: Slice) -> Found:
    base = []
    for i in range(len(part)):
        text, shift = part.text(i), int(part.offsets[i])
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                base.append((0, shift + m.start(), shift + m.end(), shift + m.start(1)))
        for m in ACCESS.finditer(text) if b"AKIA" in text else ():
            if m.end() - m.start() >= LEAST_ACCESS:
                base.append((1, shift + m.start(), shift + m.end(), shift + m.start()))
    starts, ends = _runs(_HEX[part.data], part.offsets, LEAST_HEX)
    base += [(2, a, b, a) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    base.sort(key=lambda b: (b[1], b[0]))
    starts, ends = _runs(_NUMBER[part.data] >= 0, part.offsets, LEAST_RUN)
    taken = np.zeros(len(part.data) + 1, np.int64)
    for _, a, b, _ in base:
        taken[a + 1 : b + 1] = 1
    np.cumsum(taken, out=taken)
    clear = taken[starts] == taken[ends]
    return Found(base, starts[clear], ends[clear])


# --- Learning --------------------------------------------------------------------


def labelled(docs: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(kind, value): the sample to learn from; kind 3 stands for ordinary runs. A task gives out `limit` of a kind at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[dict[int, bytes]] = [{}, {}, {}, {}]
        for batch in batches:
            for part in slices(batch.column(0)):
                found, codes = _found(part), prefix_codes(part.data)
                spans = [np.array([b[k] for b in found.base], np.int64) for k in range(4)]
                kinds = np.concatenate([spans[0], np.full(len(found.starts), 3)])
                starts, ends = np.concatenate([spans[3], found.starts]), np.concatenate([spans[2], found.ends])
                hashes = span_hashes(codes, starts, ends)
                hashes[ends - starts > LONGEST] = np.iinfo(np.uint64).max
                for kind, kept in enumerate(least):
                    mine = np.flatnonzero(kinds == kind)
                    _, first = np.unique(hashes[mine], return_index=True)
                    for i in mine[first[:limit]].tolist():
                        if ends[i] - starts[i] <= LONGEST:
                            kept.setdefault(int(hashes[i]), part.data[starts[i] : ends[i]].tobytes())
                    if len(kept) > limit:
                        least[kind] = {h: kept[h] for h in sorted(kept)[:limit]}
        rows = [(k, h, v) for k, kept in enumerate(least) for h, v in kept.items()]
        if rows:
            kind, key, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array([v.decode() for v in value])], names=["kind", "key", "value"]
            )

    rows = dealt(docs.select("text")).mapInArrow(each, "kind int, key long, value string")
    rows = written(rows.groupBy("kind", "key").agg(F.min("value").alias("value")).withColumn("size", F.length(F.bin("key"))), "credentials")
    # The hashes' lengths in bits, 64 at most, tell where the least ones end: what is then ranked is some `limit` rows.
    counts: list[dict[int, int]] = [{}, {}, {}, {}]
    for r in rows.groupBy("kind", "size").count().collect():
        counts[r["kind"]][r["size"]] = r["count"]
    keep = F.lit(False)
    for kind, of in enumerate(counts):
        enough = next((size for size in sorted(of) if sum(n for s, n in of.items() if s <= size) >= limit), 64)
        keep |= (F.col("kind") == kind) & (F.col("size") <= enough)
    least = [F.shiftrightunsigned("key", 1), F.col("key")]
    return top_per_group(rows.where(keep), ["kind"], least, limit).select("kind", "value")


def learn(docs: DataFrame, limit: int = MAX_LABELLED) -> list[Automaton | None]:
    """An automaton for each kind that has values, and one for ordinary runs. The sample comes to the driver: it is bounded."""
    values: list[list[bytes]] = [[], [], [], []]
    for r in labelled(docs, limit).collect():
        values[r["kind"]].append(r["value"].encode())
    return [infer(v) if v else None for v in values]


def scores(automata: list[Automaton | None], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of each run's likelihood as a value of its likeliest kind to that as an ordinary run; minus
    infinity for runs that are unusual for every kind."""
    best = np.full(len(starts), -np.inf)
    if automata[3] is None or not len(starts):
        return best
    ordinary = likelihood(automata[3], data, starts, ends)
    for automaton in automata[:3]:
        if automaton is not None:
            found = likelihood(automaton, data, starts, ends)
            usual = found >= automaton.usual * (ends - starts + 1)
            best = np.where(usual, np.maximum(best, found - ordinary), best)
    return best


# --- Results -----------------------------------------------------------------------


def _in_texts(column: pa.Array, automata: list[Automaton | None], least: float) -> Iterator[list[tuple[str, int, int, float | None]]]:
    """Spans of each text in the order of starts and kinds."""
    for part in slices(column):
        found = _found(part)
        ratio = scores(automata, part.data, found.starts, found.ends)
        spans = [(kind, a, b, None) for kind, a, b, _ in found.base]
        spans += [(3, int(found.starts[i]), int(found.ends[i]), float(ratio[i])) for i in np.flatnonzero(ratio >= least)]
        spans.sort(key=lambda s: (s[1], s[0]))
        points = np.zeros(len(part.data) + 1, np.int64)
        if spans:
            np.cumsum((part.data & 0xC0) != 0x80, out=points[1:])
        owner = np.searchsorted(part.offsets, [s[1] for s in spans], side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in range(len(part)):
            shift = points[part.offsets[i]]
            yield [(KINDS[k], int(points[a] - shift), int(points[b] - shift), r) for k, a, b, r in spans[bounds[i] : bounds[i + 1]]]


def spans(docs: DataFrame, limit: int = MAX_LABELLED, least: float = LEAST_RATIO) -> DataFrame:
    """One row per span: doc_id, kind, start, end, ratio (null for the fixed patterns)."""
    automata = learn(docs, limit)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        rows = [(ids[i], *s) for i, found in enumerate(_in_texts(batch.column(1), automata, least)) for s in found]
        if rows:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "kind", "start", "end", "ratio"])

    return by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), each, "doc_id long, kind string, start long, `end` long, ratio double")


def _text_of(found: list[tuple[str, int, int, float | None]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, _ in found)


def scanned(docs: DataFrame, limit: int = MAX_LABELLED, least: float = LEAST_RATIO) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    automata = learn(docs, limit)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = list(_in_texts(batch.column(1), automata, least))
        counts = [pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64()) for kind in KINDS]
        digests = pa.array([hashlib.sha256(_text_of([s for s in f if s[0] != "format"]).encode()).hexdigest() for f in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts[:3], digests, pa.array([_text_of(f) for f in found]), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
        )

    made = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return by_batch(dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")), each, made)
