"""Words of many texts at once, in tasks over Arrow batches.

Which characters make a word, and what their lower case is, is for the JVM to say (`text.tokens`). In ASCII there is no doubt: those
texts come whole and are cut here, by bytes; all others come as the words that the JVM found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletrail.functions.text import tokens

#: Bytes of text that are cut at once; a longer text is cut alone.
SLICE_BYTES = 1 << 21

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES == 95)


def word_columns(text: str) -> list[Column]:
    """What `words_of_batch` needs of a text: itself if it is ASCII, its words otherwise; of a null text, two nulls."""
    plain = F.octet_length(text) == F.length(text)
    return [F.when(plain, F.col(text)).alias("_plain"), F.when(~plain, tokens(F.col(text))).alias("_words")]


def _ascii_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) + 1 - starts, out=ends[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]]))
    return words, np.searchsorted(offsets, starts, side="right") - 1


def words_of_batch(plain: pa.Array, lists: pa.Array) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """(first row, number of rows, words, row of each word counted from the first) of slices of the rows of `word_columns`."""
    plain = plain.fill_null("")
    kind = np.int64 if pa.types.is_large_string(plain.type) else np.int32
    _, at, data = plain.buffers()
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    offsets = np.frombuffer(at, kind)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    # what the listed words take counts too
    sizes = np.diff(offsets) + 8 * np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    reach = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(plain):
        j = max(i + 1, int(np.searchsorted(reach, reach[i] + SLICE_BYTES, side="right")) - 1)
        words, rows = _ascii_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        listed = lists.slice(i, j - i)
        if listed.null_count < len(listed):
            words = pa.concat_arrays([words, listed.flatten().cast(pa.string())])
            rows = np.concatenate([rows, pc.list_parent_indices(listed).to_numpy().astype(np.int64)])
        yield i, j - i, words.dictionary_encode(), rows
        i = j
