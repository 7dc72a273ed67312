"""Suffix arrays by induced sorting, and common prefixes in text order, on numpy arrays.

Suffixes are S (less than the next one) or L. The leftmost S suffixes (S after L) are sorted by their substrings up to the
next one, which takes one induction; equal substrings get equal names, and the suffixes of the string of names are ranked by
doubling, where only names that still tie are sorted again. (A second level of induction would pass over buckets of an
alphabet nearly as large as its text.) A second induction from their order gives the array. Induction passes over the
buckets of the alphabet once each way; what a bucket gives is placed at once for all its suffixes.
"""

from __future__ import annotations

import numpy as np

from tabletrail.llm.words import _BASE, _INVERSE, _power, mix

_CODES = mix(np.arange(9001, 9001 + 512, dtype=np.uint64))


def symbol_codes(s: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_CODES[s] * _power(_BASE, len(s)), out=out[1:])
    return out


def _spans(codes: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (codes[starts + size] - codes[starts]) * _power(_INVERSE, len(codes))[starts]


def _types(s: np.ndarray) -> np.ndarray:
    n = len(s)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = s[following] < s[following + 1]
    return out


def _place(array: np.ndarray, s: np.ndarray, suffixes: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Puts the suffixes, in order, at their buckets' edges, which move on by `step` for each."""
    if not len(suffixes):
        return
    symbol = s[suffixes]
    order = np.argsort(symbol, kind="stable")
    suffixes, symbol = suffixes[order], symbol[order]
    first = np.concatenate([[0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1])
    sizes = np.diff(np.append(first, len(symbol)))
    heads = symbol[first]
    place = np.arange(len(symbol)) - np.repeat(first, sizes)
    array[np.repeat(edge[heads], sizes) + (place if step > 0 else -1 - place)] = suffixes
    edge[heads] += step * sizes


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The array that follows from the given order of the leftmost S suffixes, which is sorted by first symbol."""
    array = np.full(len(s), -1, np.int64)
    bounds = np.searchsorted(s[lms], np.arange(len(starts) + 1))
    head, tail = starts.copy(), ends.copy()

    def before(suffixes: np.ndarray, kind: bool) -> np.ndarray:
        found = suffixes - 1
        found = found[found >= 0]
        return found[small[found] == kind]

    for c in range(len(starts)):
        done = starts[c]
        while done < head[c]:
            now, done = array[done : head[c]], head[c]
            _place(array, s, before(now, False), head, 1)
        if bounds[c] < bounds[c + 1]:
            _place(array, s, before(lms[bounds[c] : bounds[c + 1]], False), head, 1)
    for c in range(len(starts) - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            now, done = array[tail[c] : done][::-1], tail[c]
            _place(array, s, before(now, True), tail, -1)
        if starts[c] < head[c]:
            _place(array, s, before(array[starts[c] : head[c]][::-1], True), tail, -1)
    array[0] = len(s) - 1
    return array


def _rank(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    in_order = names[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 1
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        after = np.where(tied + length < n, rank[np.minimum(tied + length, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[tied]))
        tied, after = tied[by], after[by]
        group = rank[tied]
        fresh_group = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = fresh_group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(tied))
        rank[tied] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(fresh_group, at, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        length *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(s: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """Of symbols below 512; the last must be less than all others."""
    s = np.asarray(s, np.uint16)
    if len(s) < 2:
        return np.zeros(len(s), np.int64)
    codes = symbol_codes(s) if codes is None else codes
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    rough = _induce(s, small, by_symbol, starts, ends)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    in_order = rough[is_lms[rough]]
    number = np.empty(len(s), np.int64)
    number[lms] = np.arange(len(lms))
    sizes = np.append(lms[1:] + 1, len(s)) - lms
    shape = mix(_spans(codes, lms, sizes) + sizes.astype(np.uint64))
    sorted_shape = shape[number[in_order]]
    name = np.cumsum(np.concatenate([[0], sorted_shape[1:] != sorted_shape[:-1]]))
    names = np.empty(len(lms), np.int64)
    names[number[in_order]] = name
    final = in_order if len(name) and name[-1] == len(lms) - 1 else lms[_rank(names)]
    return _induce(s, small, final, starts, ends)


def permuted_prefixes(s: np.ndarray, array: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each suffix in text order, the length it has in common with the one before it in the array. Only where the symbols
    before the two differ is it measured (by hashes of halving length); elsewhere it is one less than its neighbour's."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    carried = (at > 0) & (before > 0)
    carried[carried] = s[at[carried] - 1] == s[before[carried] - 1]
    start = np.flatnonzero(~carried)
    other = before[start]
    length = np.zeros(len(start), np.int64)
    live = np.flatnonzero(other >= 0)
    grow, step = live, 512
    while len(grow):  # whole steps first, for the few long ones
        room = np.maximum(start[grow], other[grow]) + length[grow] + step <= n
        grow = grow[room]
        same = _spans(codes, start[grow] + length[grow], step) == _spans(codes, other[grow] + length[grow], step)
        grow = grow[same]
        length[grow] += step
    while step > 1:
        step //= 2
        room = live[np.maximum(start[live], other[live]) + length[live] + step <= n]
        same = room[_spans(codes, start[room] + length[room], step) == _spans(codes, other[room] + length[room], step)]
        length[same] += step
    owner = np.cumsum(~carried) - 1
    return length[owner] - (at - start[owner])
