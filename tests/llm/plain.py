"""Plain versions, straight from the definitions, that the operators are held against on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, size: int = 5) -> set[tuple]:
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    found = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if found[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def near_components(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def without_repeats(texts: dict[int, str | None], window: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - window + 1):
            piece = data[p : p + window]
            if piece in seen:
                gone[p : p + window] = [True] * window
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contained(texts: dict[int, str | None], items: dict[int, str | None], least: float = 0.8) -> set[tuple[int, int, int]]:
    sets, wanted = {i: shingles(t) for i, t in texts.items()}, {i: shingles(t) for i, t in items.items()}
    return {(d, i, len(s & q)) for d, s in sets.items() for i, q in wanted.items() if q and len(s & q) >= least * len(q)}


def kneser_ney(train: list[list[str]], discounts) -> tuple:
    """(count of a token, tokens, vocabulary, probability of a pair) of token lists that end in the end mark."""
    single = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    size, n = len(single), sum(single.values())
    of = collections.Counter(pairs.values())
    high = discounts([of[k] for k in (1, 2, 3, 4)])
    follows = collections.Counter(b for _, b in pairs)
    of = collections.Counter(follows.values())
    low = discounts([of[k] for k in (1, 2, 3, 4)])
    total = sum(follows.values())
    rest = sum(low[min(k, 3) - 1] for k in follows.values()) / total if total else 1.0
    context, freed = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        context[a] += k
        freed[a] += high[min(k, 3) - 1]

    def p(a: str, b: str) -> float:
        base = rest / (size + 1) + ((follows[b] - low[min(follows[b], 3) - 1]) / total if b in follows else 0)
        if not context[a]:
            return base
        k = pairs.get((a, b), 0)
        return (k - high[min(k, 3) - 1] if k else 0) / context[a] + freed[a] / context[a] * base

    return single, n, size, p


def log10_base(count: int, n: int, size: int) -> float:
    return math.log10((count + 0.5) / (n + 0.5 * (size + 1)))


def unigram_tokens(word: str, scores: dict[bytes, int], byte_score: int) -> int:
    best: list = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if best[start] is None:
                continue
            piece, found = word[start:end].encode(), None
            if piece in scores:
                found = (best[start][0] - scores[piece], best[start][1] + 1)
            elif end - start == 1:
                found = (best[start][0] - len(piece) * byte_score, best[start][1] + len(piece))
            if found and (best[end] is None or found < best[end]):
                best[end] = found
    return best[-1][1]
