"""Marks put between the lines of a script while it is cut into blocks.

Unicode noncharacters, which text in circulation never holds; a stray one becomes U+FFFD, like any broken byte.
A marked script has one "BLOCK start,line HEAD_END" before the first line of each block, so one split gives all
blocks of the file in linear time and without a shuffle.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

BLOCK = "\ufdd0"
NODE = "\ufdd1"
BLANK = "\ufdd2"
HEAD_END = "\ufdd3"
CLOSED = "\ufdd4"
INSIDE = "\ufdd5"
_ALL = BLOCK + NODE + BLANK + HEAD_END + CLOSED + INSIDE


_AS_BROKEN = str.maketrans(_ALL, "\ufffd" * len(_ALL))


def without_marks(text: str) -> str:
    """The same as `unmarked`, for valid text."""
    return text if text.isascii() else text.translate(_AS_BROKEN)


def unmarked(source: Column) -> Column:
    clean = F.is_valid_utf8(source) & ~source.rlike(f"[{_ALL}]")
    return F.when(clean, source).otherwise(F.translate(source, _ALL, "\ufffd" * len(_ALL)))


def lines_of(text: str) -> list[str]:
    """Lines without their line ends; a final line end opens no extra line."""
    return (text[:-1] if text.endswith("\n") else text).split("\n")


def per_text(texts: Column, work: Callable[[str], object], kind: pa.DataType) -> Column:
    """What `work`, a function of a module, gives for each text: a string, or the values of a struct's fields; null for null."""

    def each(batch: pa.Array) -> pa.Array:
        found = [None if text is None else work(text) for text in batch.to_pylist()]
        if not pa.types.is_struct(kind):
            return pa.array(found, kind)
        columns = [pa.array([None if row is None else row[i] for row in found], field.type) for i, field in enumerate(kind)]
        return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array([row is None for row in found], pa.bool_()))

    return F.arrow_udf(each, from_arrow_type(kind))(texts)


def rows_per_text(kinds: Column, texts: Column, work: Callable[[str | None, str | None], list[tuple]], row: pa.StructType) -> Column:
    """An array of `row` structs for each (kind, text): what `work`, a function of a module, gives as a list of tuples."""

    def each(kind_batch: pa.Array, text_batch: pa.Array) -> pa.Array:
        ends, found = [0], []
        for kind, text in zip(kind_batch.to_pylist(), text_batch.to_pylist(), strict=True):
            found.extend(work(kind, text))
            ends.append(len(found))
        columns = zip(*found, strict=True) if found else [()] * row.num_fields
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, row, strict=True)], fields=list(row))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    return F.arrow_udf(each, from_arrow_type(pa.list_(row)))(kinds, texts)


def parts_of(marked: str) -> list[tuple[list[int], str]]:
    """(numbers of the head, body) of each block of a marked script; what precedes the first mark belongs to none."""
    parts = (block.partition(HEAD_END) for block in marked.split(BLOCK))
    return [([int(n) for n in head.split(",")], body) for head, end, body in parts if end]
