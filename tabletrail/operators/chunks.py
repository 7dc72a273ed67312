"""Scripts to chunks: one row per statement, block or command group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.text import stripped_length_is
from tabletrail.operators import marks
from tabletrail.operators.python_blocks import cut_python
from tabletrail.operators.shell_groups import cut_shell
from tabletrail.operators.sql_statements import cut_sql
from tabletrail.sources.scripts import with_file_type

CHUNK_COLUMNS = ["chunk_id", "file_path", "file_type", "chunk_type", "raw_text", "line_start", "line_end"]


_CUT = {"sql": cut_sql, "python": cut_python, "shell": cut_shell}
_PIECE = pa.struct(
    [("ord", pa.int32()), ("chunk_type", pa.string()), ("raw_text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]
)


def _cut(file_type: str | None, source: str | None) -> list[tuple]:
    if source is None or file_type not in _CUT:
        return []
    return _CUT[file_type](source if file_type == "sql" else marks.without_marks(source))


def split_scripts(files: DataFrame) -> DataFrame:
    """Chunks of (file_path, source) rows; files of other kinds give none.

    Every file is cut inside its own row, in Arrow batches, so this is one pass over the texts with no shuffle.
    """
    typed = files if "file_type" in files.columns else with_file_type(files)
    # Tasks read texts as UTF-8: broken bytes become U+FFFD.
    pieces = marks.rows_per_text(F.col("file_type"), F.make_valid_utf8("source"), _cut, _PIECE)
    cut = typed.select("file_path", "file_type", pieces.alias("_pieces"))
    # The outer form: from a plain inline Spark infers a filter that would compute the pieces twice.
    rows = cut.select("file_path", "file_type", F.inline_outer("_pieces")).where("ord IS NOT NULL")
    return rows.withColumn("chunk_id", chunk_key()).select(*CHUNK_COLUMNS)


def chunk_key() -> Column:
    """Path, lines and the position in the file, so that no two chunks share a key."""
    return F.concat("file_path", F.lit("::"), "line_start", F.lit("-"), "line_end", F.lit("#"), "ord")


def caption() -> Column:
    return F.format_string(
        "[%s] %s lines %d-%d (%s)", F.upper("file_type"), "file_path", "line_start", "line_end", "chunk_type"
    )


def is_extractable(least: int = settings.MIN_CHUNK_CHARS) -> Column:
    """Shorter chunks are indexed, but not searched for table names."""
    return stripped_length_is(F.col("raw_text"), least)
