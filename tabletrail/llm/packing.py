"""Hierarchical packing of documents into sequences of several lengths.

A document is its token ids and an end id. Its whole windows of the largest size become sequences of their own; what is
left is routed to the smallest tier that holds it. Each tier is packed by best fit, longest first; gaps in the windows of a
long tier are filled from the shorter tiers, cutting where needed, and the shorter tiers then pack what remains. At the end
of a task the windows still open are joined and cut into whole windows and powers of two, so nothing is padded.

Sequences of one tier form step groups of equal token count: `STEP_TOKENS` tokens each, the last of a task aside.

Every task packs its own documents and holds at most `POOL_TOKENS` tokens of unpacked remainders and one document's ids.
A task that runs again gives the same rows; ids of sequences and steps start from the task's number. Null texts are empty
and have the end id alone. Rows with equal ids are packed one by one. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabletrail.llm.tasks import dealt

TIERS = (1024, 512, 256, 128)
END_ID = 0
POOL_TOKENS = 1 << 20
STEP_TOKENS = 8 * 1024
ROWS = 8192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("tier", pa.int32()), ("step_id", pa.int64())])

#: Characters on whose classes both tokenizer libraries agree; other texts take the slower one.
_PLAIN = re.compile("[^\x00-ɏ -⁯]")


class Encoder:
    """Ids of the byte-level BPE. The ranks give the same ids several times faster; texts with the special token's own string, or
    with characters outside the Latin blocks, go through the tokenizer file itself."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        out = np.empty(len(found) + 1, "<u4")
        out[:-1] = found
        out[-1] = END_ID
        return out


class Packer:
    """Packs the documents of one task; `rows` holds finished pieces."""

    def __init__(self, number: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.step_tokens, self.pool_tokens = tiers, step_tokens, pool_tokens
        self.base = number << 40
        self.sequences = 0
        self.pools: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held = 0
        self.steps: dict[int, list[int]] = {}
        self.next_step = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        whole = n - n % top
        for at in range(0, whole, top):
            self._emit([(doc_id, at, ids[at : at + top], n)], top)
        if whole < n:
            self._route((doc_id, whole, ids[whole:].copy(), n))
            if self.held >= self.pool_tokens:
                self.pack()

    def _route(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pools[min(t for t in self.tiers if t >= n)].append(piece)
        self.held += n

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        step = self.steps.get(tier)
        if step is None or step[1] + tier > self.step_tokens:
            step = self.steps[tier] = [self.next_step, 0]
            self.next_step += 1
        step[1] += tier
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.base + self.sequences, offset, tier, self.base + step[0]))
            offset += len(ids)
        self.sequences += 1

    def pack(self) -> None:
        """Packs the pools; windows that shorter tiers could not fill go back to the longest tier's pool."""
        left: list[tuple] = []
        for k, tier in enumerate(self.tiers):
            windows = best_fit(self.pools[tier], tier)
            self.pools[tier] = []
            shorter = [deque(sorted(self.pools[t], key=lambda p: len(p[2]))) for t in self.tiers[k + 1 :]]
            for pieces, gap in windows:
                while gap:
                    pool = next((q for t, q in zip(self.tiers[k + 1 :], shorter, strict=True) if q), None)
                    if pool is None:
                        break
                    doc_id, start, ids, n = pool.pop()
                    if len(ids) > gap:
                        rest = ids[gap:]
                        later = next(q for t, q in reversed(list(zip(self.tiers[k + 1 :], shorter, strict=True))) if t >= len(rest))
                        later.append((doc_id, start + gap, rest, n))
                        ids = ids[:gap]
                    pieces.append((doc_id, start, ids, n))
                    gap -= len(ids)
                if gap:
                    left.extend(pieces)
                else:
                    self._emit(pieces, tier)
            for t, q in zip(self.tiers[k + 1 :], shorter, strict=True):
                self.pools[t] = list(q)
        # full windows out of what is left, so that the pool shrinks for certain
        left = self._cut(left, self.tiers[0])
        self.held = 0
        for piece in left:
            self._route(piece)

    def _cut(self, pieces: list[tuple], size: int) -> list[tuple]:
        """Sequences of exactly `size` tokens from the pieces in order; returns what remains, less than `size`."""
        window: list[tuple] = []
        have = 0
        for doc_id, start, ids, n in pieces:
            while have + len(ids) >= size:
                cut = size - have
                self._emit([*window, (doc_id, start, ids[:cut], n)], size)
                window, have, start, ids = [], 0, start + cut, ids[cut:]
            if len(ids):
                window.append((doc_id, start, ids, n))
                have += len(ids)
        return window

    def finish(self) -> None:
        self.pack()
        rest = [p for t in self.tiers for p in self.pools[t]]
        self.pools = {t: [] for t in self.tiers}
        size = self.tiers[0]
        while rest:
            rest = self._cut(rest, size)
            size //= 2


def best_fit(pieces: list[tuple], size: int) -> list[tuple[list[tuple], int]]:
    """Windows (pieces, gap): longest pieces first, each into the fullest window that has room."""
    gaps: list[tuple[int, int]] = []  # (gap, window), sorted
    windows: list[tuple[list[tuple], int]] = []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        n = len(piece[2])
        at = bisect.bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, w = gaps.pop(at)
        else:
            gap, w = size, len(windows)
            windows.append(([], size))
        windows[w][0].append(piece)
        windows[w] = (windows[w][0], gap - n)
        if gap > n:
            bisect.insort(gaps, (gap - n, w))
    return windows


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's length), step_id.

    tiers: powers of two, largest first. ranks_file: the same vocabulary as ranks, for speed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder = Packer(TaskContext.get().partitionId(), tiers), None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            while len(packer.rows) >= ROWS or last and packer.rows:
                now, packer.rows = packer.rows[:ROWS], packer.rows[ROWS:]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*now, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            encoder = encoder or Encoder(tokenizer_file, ranks_file)
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                packer.add(ids[i].as_py(), encoder.ids(texts[i].as_py() or ""))
                yield from out(False)
        packer.finish()
        yield from out(True)

    return dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(work, SCHEMA)
