"""SQL scripts: one piece per statement."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail.operators import marks

_SPACE = r"[ \t\n\x0b\f\r]"
# Whole literals, quoted names and comments.
_QUOTED = r"""'[^']*+'|"[^"]*+"|`[^`]*+`|\$([A-Za-z0-9_]*+)\$[\s\S]*?\$\1\$"""
_COMMENT = r"""--[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)"""
_STATEMENTS = re.compile(rf"""(?!\Z)(?:[^;'"`\-/$]++|{_QUOTED}|{_COMMENT}|[^;])*+;?""")
_CLOSED = re.compile(rf"""(?:[^'"`\-/$]++|{_QUOTED}|{_COMMENT}|[^'"])*+\Z""")
_LEAD = re.compile(rf"""(?:{_SPACE}++|--[^\n]*+|/\*[\s\S]*?(?:\*/|\Z))*+""")
_HEAD = re.compile(rf"{_SPACE}*(\(|[A-Za-z]+)")
_HIDDEN = re.compile(rf"{_QUOTED}|{_COMMENT}")
_SETS = re.compile(r"\b(?ai:union|intersect|except)\b")
_VERBS = re.compile(r"\(|\)|\b(?ai:select|insert|update|delete|create|merge|union|intersect|except)\b")
_STATEMENT = pa.struct([("type", pa.string()), ("text", pa.string()), ("first", pa.int32()), ("last", pa.int32())])


def _top_level(plain: str) -> tuple[str, bool]:
    """First verb outside brackets, and whether a set operation stands there."""
    depth, verb, sets = 0, "", False
    for word in _VERBS.findall(plain):
        if word == "(":
            depth += 1
        elif word == ")":
            depth -= 1
        elif depth == 0:
            low = word.lower()
            if low in ("union", "intersect", "except"):
                sets = True
            elif not verb:
                verb = low
    return verb, sets


def _statement_type(code: str) -> str:
    """select, write, update, delete, cte or statement for a text without leading comments.

    A leading WITH takes the type of its main verb. Only WITH and SELECT ... UNION need a look at the brackets; literals and comments
    only go there.
    """
    head = _HEAD.match(code)
    verb, sets = head[1].lower() if head else "", False
    if verb == "with":
        verb, sets = _top_level(_HIDDEN.sub("''", code))
        if verb == "":
            return "cte"
    elif verb == "select" and _SETS.search(code):
        sets = _top_level(_HIDDEN.sub("''", code))[1]
    if verb == "select":
        return "statement" if sets else "select"
    return {"insert": "write", "create": "write", "update": "update", "delete": "delete"}.get(verb, "statement")


def _finished(body: str) -> tuple | None:
    """(type, text, line ends before its first line, line ends before its last) of a statement; None if it holds no code."""
    lead = _LEAD.match(body)[0]
    rest = (body[:-1] if body.endswith(";") else body).rstrip()
    code = rest[len(lead) :]
    if not code.strip():
        return None
    return _statement_type(code), rest.lstrip(), lead.count("\n"), rest.count("\n")


def cut_sql(source: str) -> list[tuple]:
    """(ord, type, text, first line, last line) of each statement with code.

    A quote that never closes makes the statement limits unknowable: such a file is cut at every semicolon instead,
    with line numbers that count one line for each cut.
    """
    found, line = [], 1
    if _CLOSED.match(source):
        for i, match in enumerate(_STATEMENTS.finditer(source)):
            statement = _finished(match[0])
            if statement:
                kind, text, first, last = statement
                found.append((i, kind, text, line + first, line + last))
            line += match[0].count("\n")
        return found
    for i, text in enumerate(part for part in map(str.strip, source.split(";")) if part):
        found.append((i, "statement", text, line, line + text.count("\n")))
        line += text.count("\n") + 2
    return found


def finish_statements(pieces: DataFrame) -> DataFrame:
    """Adds type, text and lines to whole statements (body, line); those without code are dropped."""
    out = pieces.withColumn("_done", marks.per_text(F.make_valid_utf8("body"), _finished, _STATEMENT)).where("_done IS NOT NULL")
    return out.withColumns(
        {
            "sql_type": F.col("_done.type"),
            "sql_text": F.col("_done.text"),
            "sql_start": F.col("line") + F.col("_done.first"),
            "sql_end": F.col("line") + F.col("_done.last"),
        }
    ).drop("_done")
