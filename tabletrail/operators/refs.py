"""Table references in chunks, found with patterns."""

from __future__ import annotations

import re
import string
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.joins import lookup_join
from tabletrail.functions.text import PLAIN_NAME, WORD, empty_strings, find_all, strip
from tabletrail.operators import marks
from tabletrail.operators.chunks import is_extractable

REF = "struct<ord:int,raw:string,canonical:string,ref_type:string,confidence:string>"

# --- Fixed values: where a table name stands in each language. ---------------

_EDGE = rf"(?<!{WORD})"
_DOTTED = r"[\p{L}\p{N}_.]+"
_QUOTED_SQL = rf'[`"\[]?{_DOTTED}[`"\]]?'
_SQL_NAME = rf"({_QUOTED_SQL}(?:\.{_QUOTED_SQL})*)"
_QUOTED_PY = rf"""[`"']?{_DOTTED}[`"']?"""
_PY_NAME = rf"({_QUOTED_PY}(?:\.{_QUOTED_PY})*)"
_BARE_NAME = rf"({_DOTTED})"
_STRING = r"""["']([^"']+)["']"""

# (word that must occur, pattern whose first group is the name)
SQL_READ = [("from", rf"{_EDGE}FROM\s+{_SQL_NAME}"), ("join", rf"{_EDGE}JOIN\s+{_SQL_NAME}")]
SQL_WRITE = [
    ("insert", rf"{_EDGE}INSERT\s+INTO\s+{_SQL_NAME}"),
    ("update", rf"{_EDGE}UPDATE\s+{_SQL_NAME}"),
    ("merge", rf"{_EDGE}MERGE\s+INTO\s+{_SQL_NAME}"),
]
SQL_CREATE = [
    ("create", rf"{_EDGE}CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{_SQL_NAME}")
]
SQL_DROP = [("drop", rf"{_EDGE}DROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?{_SQL_NAME}")]
SQL_COPY = [("copy", rf"{_EDGE}COPY\s+{_SQL_NAME}\s+\("), ("into", rf"{_EDGE}INTO\s+{_SQL_NAME}")]

PY_READ = [
    ("from", rf"{_EDGE}FROM\s+{_PY_NAME}"),
    ("join", rf"{_EDGE}JOIN\s+{_PY_NAME}"),
    ("read_sql", rf"""read_sql\s*\(\s*["'].*?FROM\s+{_BARE_NAME}"""),
    ("table", rf"\.read(?:_|\.)table\s*\(\s*{_STRING}"),
]
PY_WRITE = [
    ("to_sql", rf"\.to_sql\s*\(\s*{_STRING}"),
    ("insertinto", rf"\.insertInto\s*\(\s*{_STRING}"),
    ("saveastable", rf"\.saveAsTable\s*\(\s*{_STRING}"),
    ("insert", rf"{_EDGE}INSERT\s+INTO\s+{_BARE_NAME}"),
]

SHELL = [
    ("copy", rf"{_EDGE}COPY\s+{_BARE_NAME}\s*\("),
    ("from", rf"{_EDGE}FROM\s+{_BARE_NAME}"),
    ("into", rf"{_EDGE}INTO\s+{_BARE_NAME}"),
    ("select", rf"{_EDGE}SELECT\s+COUNT\(\*\)\s+FROM\s+{_BARE_NAME}"),
]

# Families in the order they are read; of two non-READ families naming one table, the later one counts.
FAMILIES = {
    "sql": [("READ", SQL_READ), ("WRITE", SQL_WRITE), ("CREATE", SQL_CREATE), ("DROP", SQL_DROP), ("WRITE", SQL_COPY)],
    "python": [("READ", PY_READ), ("WRITE", PY_WRITE)],
    "shell": [("READ", SHELL)],
}
# The same shell patterns, with COPY and INTO taken as writes.
SHELL_WITH_WRITES = [("READ", SHELL[1:2] + SHELL[3:4]), ("WRITE", SHELL[0:1] + SHELL[2:3])]

_IMPORT_LINE = r"(?<![^\n])[ \t]*from[ \t]+\S+[ \t]+import(?!\S)[^\n]*"
# Names of a chunk that count as few; any number is looked up alike.
_FEW_NAMES = 32


def clean_name(c: Column) -> Column:
    """Last part of a dotted name, lower-cased, without quotes and brackets."""
    bare = strip(F.translate(c, "`\"'[]", ""))
    return F.when(c.rlike(PLAIN_NAME), c).otherwise(F.lower(F.element_at(F.split(bare, r"\."), -1)))


def table_names(text: Column, patterns: list[tuple[str, str]], low: Column | None = None) -> Column:
    """Distinct table names the patterns find, in pattern order, then in text order.

    A plain substring test comes first: it is far cheaper than a pattern, and most chunks lack most of the words. low: a column of the
    lower-cased text, for callers that look for several families.
    """
    low = F.lower(text) if low is None else low
    found = [
        F.when(F.contains(low, F.lit(word)), find_all(text, "(?i)" + pattern, 1)).otherwise(empty_strings())
        for word, pattern in patterns
    ]
    # A set of literals is hashed once, a list taken off with array_except once per chunk.
    kept = lambda name: (F.length(name) >= 2) & ~name.isin(settings.STOP_WORDS) & ~name.rlike(r"^\p{Nd}+$")
    names = F.array_distinct(F.filter(F.transform(found[0] if len(found) == 1 else F.flatten(F.array(*found)), clean_name), kept))
    some = F.lit(False)
    for word, _ in patterns:
        some = some | F.contains(low, F.lit(word))
    return F.when(some, names).otherwise(empty_strings())


def _walked(pattern: str) -> re.Pattern:
    """The pattern for text whose A-Z are lower-cased, as Python writes it: \\s and . mean in Java what is spelled out here."""
    local = pattern.replace(r"\p{L}\p{N}_", r"\w").replace(r"\s", r"[ \t\n\x0b\f\r]").replace(".*?", r"[^\n\r\x85\u2028\u2029]*?")
    # The look behind comes after the word, so that the search runs from word to word.
    return re.compile(re.sub(r"^\(\?<!\[\\w\]\)([a-z]+)", r"\1(?<!\\w\1)", local.lower()))


def _compiled(families: dict) -> dict:
    return {language: [(kind, [(word, _walked(pattern)) for word, pattern in patterns]) for kind, patterns in members] for language, members in families.items()}


_WALKED = _compiled(FAMILIES)
_WALKED_WITH_WRITES = _compiled(FAMILIES | {"shell": SHELL_WITH_WRITES})
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_UNQUOTED = str.maketrans("", "", "`\"'[]")
_STOPS = frozenset(settings.STOP_WORDS)
_REF = pa.struct([("ord", pa.int32()), *((name, pa.string()) for name in ("raw", "canonical", "ref_type", "confidence"))])


def _found(shell_writes: bool, least: int, file_type: str | None, text: str | None) -> list[tuple]:
    """The references of one chunk: names in the order in which the families find them, each with the type of the last one that does.
    A text that is shorter than `least` when stripped has none."""
    types = {}
    walked = _WALKED_WITH_WRITES if shell_writes else _WALKED
    if text and file_type in walked and len(text.strip()) >= least:
        plain, low = text.isascii(), text.lower()
        if not plain and (len(low) != len(text) or "\u212a" in text):
            # Places would move, or the Kelvin sign be taken for a k: only A-Z change. Names are taken from the text itself.
            low = text.translate(_LOWER)
        for kind, patterns in walked[file_type]:
            for word, pattern in patterns:
                if word in low:
                    raws = pattern.findall(low) if plain else (text[slice(*match.span(1))] for match in pattern.finditer(low))
                    for raw in dict.fromkeys(raws):
                        name = raw if plain and raw.isidentifier() else raw.translate(_UNQUOTED).strip().rpartition(".")[2].lower()
                        if len(name) >= 2 and name not in _STOPS and not name.isdecimal():
                            types[name] = kind
    return [(i, name, name, kind, "medium") for i, (name, kind) in enumerate(types.items())]


def add_refs(chunks: DataFrame, shell_writes: bool = False, skip_imports: bool = False) -> DataFrame:
    """Add refs, an array of one reference per table name, to each chunk.

    All of it happens inside the chunk's row, in Arrow batches. Chunks too short to name a table get an empty array.

    shell_writes: COPY and INTO in shell text count as WRITE instead of READ.
    skip_imports: `from x import y` lines of Python are not searched.
    """
    text, least = F.col("raw_text"), settings.MIN_CHUNK_CHARS
    if skip_imports:
        # The length that counts is that of the whole text.
        text = F.when(F.col("file_type") == "python", F.regexp_replace(text, _IMPORT_LINE, "")).otherwise(text)
        text, least = F.when(is_extractable(), text), 0
    refs = marks.rows_per_text(F.col("file_type"), F.make_valid_utf8(text), partial(_found, shell_writes, least), _REF)
    return chunks.withColumn("refs", refs.cast(f"array<{REF}>"))


def ref_rows(chunks_with_refs: DataFrame) -> DataFrame:
    """One row per reference: (chunk_id, file_path, line_start, ord, raw, canonical, ref_type, confidence).

    The outer form on purpose, here and elsewhere: from a plain explode Spark infers a filter on the array and pushes
    it down, which computes the whole array twice.
    """
    rows = chunks_with_refs.select("chunk_id", "file_path", "line_start", F.inline_outer("refs"))
    return rows.where("raw IS NOT NULL")


def name_aliases(chunks_with_refs: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Set canonical from alias rules such as [("rd_old", "reading")]: a short list works inside the row; a long one, or a
    rules(alias, canonical) table, by a join."""
    if isinstance(rules, DataFrame):
        return _name_many(chunks_with_refs, rules)
    if not rules:
        return chunks_with_refs
    if len(rules) > settings.INLINE_RULES:
        return _name_many(chunks_with_refs, chunks_with_refs.sparkSession.createDataFrame(list(dict(rules).items()), "alias string, canonical string"))
    table = F.create_map(*[F.lit(value.lower()) for pair in dict(rules).items() for value in pair])
    canonical = lambda ref: F.coalesce(F.try_element_at(table, ref["raw"]), ref["canonical"])
    return chunks_with_refs.withColumn(
        "refs", F.transform("refs", lambda ref: ref.withField("canonical", canonical(ref)))
    )


def _name_many(chunks_with_refs: DataFrame, rules: DataFrame) -> DataFrame:
    """Names join the rules, and come back to their chunk as an array."""
    named = name_aliases_by_table(chunks_with_refs.select("chunk_id", F.inline_outer("refs")).where("raw IS NOT NULL"), rules)
    fields = F.struct("ord", "raw", "canonical", "ref_type", "confidence")
    grouped = named.groupBy("chunk_id").agg(F.sort_array(F.collect_list(fields)).alias("_refs"))
    joined = chunks_with_refs.join(grouped, "chunk_id", "left")
    return joined.withColumn("refs", F.coalesce(F.col("_refs").cast(f"array<{REF}>"), "refs")).drop("_refs")


def name_aliases_by_table(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for reference rows and a rules(alias, canonical) table of any size."""
    known = rules.select(F.lower("alias").alias("raw"), F.lower("canonical").alias("_canonical"))
    known = known.groupBy("raw").agg(F.max("_canonical").alias("_canonical"))
    joined = lookup_join(refs, known, ["raw"], spread_by="chunk_id", how="left")
    return joined.withColumn("canonical", F.coalesce("_canonical", "canonical")).drop("_canonical")
