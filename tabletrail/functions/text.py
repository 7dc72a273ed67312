"""String helpers as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() removes. Spark's trim() alone removes spaces only.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
)

# One word character as Python's Unicode \w sees it; Java and RE2 read it alike.
WORD = r"[\p{L}\p{N}_]"

# A name that cleaning and lower-casing leave as it is.
PLAIN_NAME = r"\A[a-z0-9_]+\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def stripped_length_is(c: Column, least: int) -> Column:
    """Whether at least `least` characters stay when the text is stripped; reads no further than it must."""
    if least < 2:
        return F.length(strip(c)) >= least
    solid = f"[^{WHITESPACE}]"
    return c.rlike(solid + r"[\s\S]{%d,}?" % (least - 2) + solid)


def count_of(c: Column, piece: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))


def newlines(c: Column) -> Column:
    return count_of(c, "\n")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(c: Column) -> Column:
    """Lower-cased words. An underscore joins, so cust_tab is one token."""
    return find_all(F.lower(c), WORD + "+")


def clean_query(c: Column, chars: int | None = None) -> Column:
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-.]", "")
    return strip(kept if chars is None else F.substring(kept, 1, chars))


def folder_list(c: Column) -> Column:
    """Names in a comma or newline separated list."""
    parts = F.transform(F.split(c, r"[,\n]+"), strip)
    return F.filter(parts, lambda x: x != "")


def name_key(c: Column) -> Column:
    """The form in which table names are compared."""
    return F.when(c.rlike(PLAIN_NAME), c).otherwise(strip(F.lower(c)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unfence(c: Column) -> Column:
    """A model reply without its code fence."""
    text = strip(c)
    body = F.element_at(F.split(text, "```"), 2)
    body = strip(F.when(F.startswith(body, F.lit("json")), F.substring(body, 5, 2**31 - 1)).otherwise(body))
    return F.when(F.startswith(text, F.lit("```")), body).otherwise(text)


def encode_list(c: Column) -> Column:
    return F.to_json(c)


_JSON_STRING = r'"(?:[^"\\]|\\[\s\S])*+"'
_JSON_SCALAR = rf"^(?:{_JSON_STRING}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)$"


def is_json_group(c: Column) -> Column:
    """True for text that is one JSON array or object and nothing more. Spark's parser stops after the first value,
    so the brackets outside strings are followed: they must come back to depth zero once, at the end."""
    marks = F.regexp_replace(F.regexp_replace(c, _JSON_STRING, ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))

    def step(acc: Column, mark: Column) -> Column:
        depth = acc["depth"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (acc["ends"] + F.when(depth == 0, 1).otherwise(0)).alias("ends"))

    closed = F.aggregate(
        find_all(marks, r"[\[\]{}]"), start, step, lambda acc: (acc["ends"] == 1) & (acc["depth"] == 0)
    )
    return c.rlike(r"^[\[{][\s\S]*[\]}]\z") & F.try_parse_json(c).isNotNull() & closed


def decode_list(c: Column) -> Column:
    """A stored list: JSON array, a single JSON value, or the older a|b form."""
    text = strip(c)
    scalar = (
        F.when(text == "true", "True")
        .when(text == "false", "False")
        .when(text == "null", "None")
        .when(F.startswith(text, F.lit('"')), F.try_variant_get(F.try_parse_json(text), "$", "string"))
        .otherwise(text)
    )
    piped = F.filter(F.transform(F.split(c, r"\|"), strip), lambda x: x != "")
    return (
        F.when(c.isNull() | (c == ""), empty_strings())
        .when(text.rlike(_JSON_SCALAR), F.array(scalar))
        .when(is_json_group(text), F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text)))
        .otherwise(piped)
    )


def code_of(document_text: Column) -> Column:
    """The code part of an enriched document text; a missing text gives an empty one."""
    before = F.substring_index(document_text, "[ENTITIES]", 1)
    return F.coalesce(strip(F.replace(before, F.lit("[CODE]"), F.lit(""))), F.lit(""))
