"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

A task reads the bytes of an Arrow text column in slices of some hundred kilobytes, so its memory is bounded by the slice, or by
the longest text where that is larger. A word is a run without the white space of `SPACES`; nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACES, np.uint8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between slices."""
    key = str(base)
    if len(_powers.get(key, ())) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        full[0] = 1
        _powers[key] = np.multiply.accumulate(full)
    return _powers[key][:n]


@dataclass
class Slice:
    """Texts first..last-1 of a batch, their bytes end to end; text i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in order, a slice holding at most `limit` bytes or else one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a slice: hashes, byte spans, and for text i the words first[i]..first[i+1]-1."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hashes` gets the hash of any span in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal bytes of a span, whatever lies before it."""
    return mix((codes[ends] - codes[starts]) * _power(_INVERSE, len(codes))[starts] + (ends - starts).astype(np.uint64))


def words_of(part: Slice, lower: bool = True) -> Words:
    data = LOWER[part.data] if lower else part.data
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(span_hashes(prefix_codes(data), starts, ends), starts, ends, np.searchsorted(starts, part.offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive entries; a run may cross from one text into the next."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _STEP + hashes[j : j + n]
    return mix(total)


@dataclass
class Shingles:
    """Shingles in order: text i has first[i]..first[i+1]-1. A text of fewer words has its whole sequence as one."""

    hashes: np.ndarray
    first: np.ndarray


def shingles_of(words: Words, size: int = SHINGLE_WORDS) -> Shingles:
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    long = counts >= size
    text = np.repeat(np.arange(len(counts)), n)
    at = words.first[:-1][text] + (np.arange(first[-1]) - first[:-1][text])
    run = grams(words.hashes, size)
    out = run[np.minimum(at, max(len(run) - 1, 0))] if len(run) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero(~long & (counts > 0)):
        total = np.full(1, 0x5851F42D4C957F2D, np.uint64)
        for j in range(words.first[i], words.first[i + 1]):
            total = mix(total * _STEP + words.hashes[j : j + 1] + counts[i : i + 1].astype(np.uint64))
        out[first[i]] = total[0]
    return Shingles(out, first)
