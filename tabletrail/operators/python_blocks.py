"""Python scripts: one piece per top-level function or class, and one per run of other statements."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.folds import let
from tabletrail.functions.text import find_all
from tabletrail.operators import marks

_TRIPLE_DOUBLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
_SHORT = r'''"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+\''''
_TOKEN = re.compile(rf'''{_TRIPLE_DOUBLE}|{_TRIPLE_SINGLE}|{_SHORT}|#[^\n]*+|["']''')
_BLANK_RUN = rf"(?:{marks.BLANK}[^\n]*+\n)++"
_LAST_BLANKS = re.compile(rf"{_BLANK_RUN}\Z")
_BLANKS_BEFORE = re.compile(rf"{_BLANK_RUN}{marks.NODE}")
_MARKS = re.compile(rf"{marks.NODE}[0-9]|{marks.BLANK}")
_BLANK_LINE = re.compile(r"\n[ \t]++(?![^\n])")

_OTHER, _DEF, _CLASS, _DECORATOR = 1, 2, 3, 4

# What the language allows.
_MOST_BRACKETS = 200
_MOST_INDENTS = 100
_TAB = 8
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_PAIR_ROUNDS = 8
_STRAY = re.compile(r"[$?`]|!(?!=)|\\(?!\r?\n|\r?\Z)")

_BODY = re.compile(r"[^\n]+")
_NO_BRACKETS = re.compile(r"[^()\[\]{}]+")
_OPEN_QUOTE = re.compile(f'"(?!{marks.INSIDE})')
_DEF_LINE = re.compile(r"(?:async[ \t\n\x0b\f\r]+)?def\b")
_CLASS_LINE = re.compile(r"class\b")
_STOPS = re.compile(r" {%d}| {0,%d}\t" % (_TAB, _TAB - 1))
# A line that starts so, or is empty, is within something; Java's ^$ also takes a lone line end for an empty line.
_WITHIN = (" ", "\t", "\n", "\x0b", "\f", "\r", marks.INSIDE)
_NO_TEXT = ("", "\x85", "\u2028", "\u2029")
_SCAN = pa.struct([("marked", pa.string()), ("brackets", pa.string()), ("open", pa.bool_()), ("quote", pa.bool_()), ("rest", pa.string())])


def _unpaired(blanked: Column) -> Column:
    """The brackets without pairs that have nothing between them, innermost pairs first. Each round hides one level of depth at most."""
    rest = F.regexp_replace(blanked, r"[^()\[\]{}]++", "")
    for _ in range(_PAIR_ROUNDS):
        rest = F.regexp_replace(rest, r"\(\)|\[\]|\{\}", "")
    return rest


def _bracket_fault(blanked: Column) -> Column:
    """Whether a bracket closes another kind, or none, or too many are open. The brackets awaited are a stack in a string.

    Pairs leave the stack as it was, so only the brackets left without them are followed; all are, if those left are so many that
    too many could be open with the pairs.
    """
    pairs = {"(": ")", "[": "]", "{": "}"}

    def step(before: Column, bracket: Column) -> Column:
        awaited = F.substring(before["awaited"], -1, 1)
        opening = bracket.isin(*pairs)
        bad = before["bad"] | F.when(opening, F.length(before["awaited"]) >= _MOST_BRACKETS).otherwise(awaited != bracket)
        pushed = F.concat(before["awaited"], F.translate(bracket, "".join(pairs), "".join(pairs.values())))
        popped = F.substring(before["awaited"], F.lit(1), F.greatest(F.length(before["awaited"]) - 1, F.lit(0)))
        return F.struct(F.when(bad, before["awaited"]).when(opening, pushed).otherwise(popped).alias("awaited"), bad.alias("bad"))

    zero = F.struct(F.lit("").alias("awaited"), F.lit(False).alias("bad"))

    def bad(text: Column) -> Column:
        return F.aggregate(find_all(text, r"[()\[\]{}]"), zero, step, lambda last: last["bad"])

    def judged(rest: Column) -> Column:
        return F.when(rest == "", False).when(F.length(rest) <= _MOST_BRACKETS - _PAIR_ROUNDS, bad(rest)).otherwise(bad(blanked))

    return let(_unpaired(blanked), judged)


def _indents_fit(heads: list[tuple[bool, str]]) -> bool:
    """Whether the first lines of statements, (opened, indent) each, are indented as those of a program can be.

    An automaton with a stack of open indents: after a line that opens a block the next is deeper; no other is; a line that
    goes back must meet an open indent. Each indent is measured with tabs to every eighth column and with tabs as one, and
    both measures must agree on what is deeper.
    """
    stack, before = [(0, 0)], None
    for opened, indent in heads:
        # A line indented as the one before it cannot change anything, unless a block should begin.
        if not opened and indent == before:
            continue
        before = indent
        wide = len(_STOPS.sub("\t" * _TAB, indent)) if "\t" in indent else len(indent)
        narrow = len(indent)
        if opened:
            if wide <= stack[-1][0] or narrow <= stack[-1][1] or len(stack) >= _MOST_INDENTS:
                return False
            stack.append((wide, narrow))
        else:
            while stack[-1][0] > wide:
                stack.pop()
            if stack[-1] != (wide, narrow):
                return False
    return True


def _blank_token(token: re.Match) -> str:
    """A comment goes; of a string, its first quote and the line ends stay."""
    text = token[0]
    return "" if text[0] == "#" else '"' + _BODY.sub(marks.INSIDE, text[1:])


def _scan_lines(source: str) -> tuple[str, str, bool, bool, str | None]:
    """The lines' states in one walk: (marked text, its brackets, whether one stays open, whether a quote does, other fault).

    String bodies and comments are blanked first, line by line in place; then a line belongs to the top level if it
    starts in column 0, outside brackets and not after a backslash.
    """
    blanked = _TOKEN.sub(_blank_token, source)
    brackets = _NO_BRACKETS.sub("", blanked)
    any_bracket, any_backslash = brackets != "", "\\" in blanked
    marked, heads = [], []
    depth, kind, cont, opens = 0, 0, False, False
    # A comment that ends the text without a line end is no line of the blanked text, and belongs to no block.
    for number, (line, bare) in enumerate(zip(marks.lines_of(source), marks.lines_of(blanked), strict=False), 1):
        text = bare.lstrip(" \t\f")
        empty = text == "" or (text[0] == "\r" and text.strip(" \t\f\r") == "")
        free = depth == 0 and not cont
        if free and not empty and bare[0] != marks.INSIDE:
            # From the last form feed on.
            heads.append((opens, bare[: len(bare) - len(text)].rpartition("\f")[2]))
        if free and not bare.startswith(_WITHIN) and bare not in _NO_TEXT:
            own = _DEF if _DEF_LINE.match(bare) else _CLASS if _CLASS_LINE.match(bare) else _DECORATOR if bare[0] == "@" else _OTHER
            if not (kind == _DECORATOR or (kind == _OTHER and own == _OTHER)):
                marked.append(f"{marks.BLOCK}{number},{number}{marks.HEAD_END}")
            marked.append(f"{marks.NODE}{own}")
            kind = own
        if text == "":
            marked.append(marks.BLANK)
        marked.append(line + "\n")
        after = depth
        if any_bracket:
            after += bare.count("(") + bare.count("[") + bare.count("{") - bare.count(")") - bare.count("]") - bare.count("}")
        if not empty:
            opens = after <= 0 and bare.rstrip(" \t\f\r\\").endswith(":")
        depth = after if after > 0 else 0
        cont = any_backslash and bare.rstrip("\r").endswith("\\")
    # The pattern is tried only where one of its characters is: these tests are far cheaper.
    stray = (any_backslash or any(c in blanked for c in "$?`!")) and _STRAY.search(blanked)
    rest = "character" if stray else None if _indents_fit(heads) else "indent"
    return "".join(marked), brackets, depth > 0, bool(_OPEN_QUOTE.search(blanked)), rest or ("end" if opens or cont else None)


def _scanned(files: DataFrame) -> DataFrame:
    """Adds the source of a Python file, and what keeps it from being a program."""
    is_python = F.col("file_type") == "python"
    out = files.withColumn("_src", F.when(is_python, marks.unmarked(F.col("source"))))
    out = out.withColumn("_scan", marks.per_text(F.col("_src"), _scan_lines, _SCAN))
    fault = (
        F.when(F.col("_scan.quote"), "quote")
        .when(_bracket_fault(F.col("_scan.brackets")) | F.col("_scan.open"), "bracket")
        .otherwise(F.col("_scan.rest"))
    )
    return out.withColumn("_fault", F.when(is_python, fault)).drop("_scan")


def python_faults(files: DataFrame) -> DataFrame:
    """(file_path, fault) of the Python files among (file_path, file_type, source): quote, bracket, character, indent or end; null
    where none is found. A fault named is one; a file without may still be no program, as statements are not parsed."""
    return _scanned(files.where("file_type = 'python'")).select("file_path", F.col("_fault").alias("fault"))


def _brackets_fit(brackets: str) -> bool:
    """Whether each bracket closes the one opened last, and not too many are open: the rule of _bracket_fault."""
    awaited = []
    for bracket in brackets:
        if bracket in _CLOSES:
            if len(awaited) >= _MOST_BRACKETS:
                return False
            awaited.append(_CLOSES[bracket])
        elif not awaited or awaited.pop() != bracket:
            return False
    return True


def _statement_rows(marked: str) -> list[tuple]:
    """Rows of the marked blocks: functions, classes, and runs of other statements."""
    found = []
    for i, ((start, _), body) in enumerate(marks.parts_of(marked)):
        # A run of blank and comment lines before the next statement, or at the end, belongs to no statement.
        kept = _LAST_BLANKS.sub("", body)
        text = _MARKS.sub("", _BLANKS_BEFORE.sub(marks.NODE, kept)).rstrip("\n")
        # Removing the indent all lines share: the first line starts in column 0, so only blank lines change.
        text = _BLANK_LINE.sub("\n", text)
        kind = "function" if f"{marks.NODE}{_DEF}" in kept else "class" if f"{marks.NODE}{_CLASS}" in kept else "module_preamble"
        found.append((i, kind, text, start, start + kept.count("\n") - 1))
    return found


def cut_python(source: str) -> list[tuple]:
    """(ord, type, text, first line, last line) of each statement block of a source without marks.

    A fault that keeps the file from being a program, or no statement at all, leaves fixed blocks of lines.
    """
    marked, brackets, is_open, quote, rest = _scan_lines(source)
    fits = not quote and not is_open and rest is None and _brackets_fit(brackets)
    found = _statement_rows(marked) if fits else []
    if found or source == "":
        return found
    lines, step = marks.lines_of(source), settings.BLOCK_LINES
    blocks = (lines[at : at + step] for at in range(0, len(lines), step))
    return [(i, "block", "\n".join(block), i * step + 1, i * step + len(block)) for i, block in enumerate(blocks)]
