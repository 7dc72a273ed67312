"""Shell scripts: one piece per function and per run of commands between comment lines."""

from __future__ import annotations

import re

from tabletrail.operators import marks

_FUNCTION = re.compile(r"(?:function[ \t\n\x0b\f\r]+)?\w+[ \t\n\x0b\f\r]*\([ \t\n\x0b\f\r]*\)")


def _mark_groups(source: str) -> str:
    """The script with a mark before each group and after each function, in one walk over its lines; lines outside groups go.

    A comment line or a function head opens a new group when one is open; a function ends on the first later line that brings its
    braces back to zero.
    """
    marked, start, depth, inside, open_ = [], 1, 0, False, False
    for number, line in enumerate(marks.lines_of(source), 1):
        text = line.strip()
        if text == "":
            if open_:
                marked.append(line + "\n")
            continue
        name = "(" in text and _FUNCTION.match(text) is not None
        section = not inside and open_ and not name and text[0] == "#"
        if name or section:
            start = number
        if name or section or not open_:
            marked.append(f"{marks.BLOCK}{start},{number}{marks.HEAD_END}")
        marked.append(line + "\n")
        delta = text.count("{") - text.count("}")
        closes = False
        if name:
            depth, inside = delta, True
        elif inside:
            depth += delta
            closes = depth <= 0
        if closes:
            marked.append(marks.CLOSED)
            start, inside = number + 1, False
        open_ = not closes
    return "".join(marked)


def cut_shell(source: str) -> list[tuple]:
    """(ord, type, text, first line, last line) of each group of a script without marks; a script with no group is one piece."""
    groups = marks.parts_of(_mark_groups(source))
    if not groups:
        return [(0, "script", source, 1, source.count("\n") + (source != "" and source[-1] != "\n"))]
    return [
        (i, "function" if marks.CLOSED in body else "command_group", body.replace(marks.CLOSED, "").strip(), start, line + body.count("\n") - 1)
        for i, ((start, line), body) in enumerate(groups)
    ]
