"""SQL scripts too long for one task: statements of files that come as segments.

A segment is some whole lines of a file, so quotes, dollar quotes and block comments are all that can reach over its end. What
a segment does to the lexer is a map from the state at its start to the state at its end, and such maps compose: first within
blocks of `BLOCK` segments, then over the blocks, then down again. So only small maps are gathered, never texts, and every
segment is cut by a task of its own. Statements that reach over segments are put together at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrail.functions.folds import let, running
from tabletrail.functions.text import find_all, newlines
from tabletrail.operators.chunks import CHUNK_COLUMNS, chunk_key, split_scripts
from tabletrail.operators.sql_statements import finish_statements
from tabletrail.sources.scratch import written

BLOCK = 1000
_CODE = ""
_STATES = [_CODE, "'", '"', "`", "/*"]
_TAG = r"\$\w*+\$"
_WHOLE = r"""'[^']*+'|"[^"]*+"|`[^`]*+`|\$(\w*+)\$[\s\S]*?\$\1\$|--[^\n]*+|/\*[\s\S]*?\*/"""
_LAST_STATE = rf"""\A(?:{_WHOLE}|[^'"`\-/$]++|-(?!-)|/(?!\*)|\$(?!\w*+\$))*+(['"`]|/\*|{_TAG}|\z)"""
_OPEN = r"""'[^']*+\z|"[^"]*+\z|`[^`]*+\z|/\*[\s\S]*+|\$\w*+\$[\s\S]*+"""
_PIECE = rf"""(?:{_WHOLE}|{_OPEN}|[^;'"`\-/$]++|[^;])*+"""
_PIECES = rf"{_PIECE};|(?!\z){_PIECE}"


def _closed_at(text: Column, state: Column) -> Column:
    """How many characters of a segment that starts in `state` belong to what is open; null: all do."""
    closer = F.when(state == "/*", "*/").otherwise(state)
    return F.when(state == _CODE, 0).when(F.contains(text, closer), F.position(closer, text) - 1 + F.length(closer))


def _state_after(text: Column, state: Column) -> Column:
    def of(at: Column) -> Column:
        return F.when(at.isNull(), state).otherwise(F.regexp_extract(F.substring(text, at + 1, F.length(text)), _LAST_STATE, 2))

    return let(_closed_at(text, state), of)


def _mapped(ends: Column, state: Column) -> Column:
    """The state that a map, the ends beside `states`, leads to."""
    return F.element_at(ends, F.array_position("states", state).cast("int"))


def _run(maps: Column, state: Column) -> Column:
    return F.aggregate(maps, state, lambda before, ends: _mapped(ends, before))


def _maps_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct(order, "ends")))
    return rows.groupBy(*keys).agg(gathered.alias("of"), F.first("states").alias("states")).withColumn("maps", F.col("of.ends"))


def start_states(segments: DataFrame) -> DataFrame:
    """(file_path, part, state, after): what is open where each segment starts and where it ends; nothing: an empty string."""
    tags = segments.select("file_path", F.explode(F.array_distinct(find_all(F.col("text"), _TAG))).alias("tag")).distinct()
    tags = tags.groupBy("file_path").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    # Tags come to the narrow keys first: a file's texts are never one task's.
    known = segments.join(segments.select("file_path", "part").join(tags, "file_path"), ["file_path", "part"], "left")
    base = F.array(*(F.lit(s) for s in _STATES))
    known = known.withColumn("states", F.concat(base, F.coalesce("tags", F.array().cast("array<string>"))))
    ends = F.transform("states", lambda state: _state_after(F.col("text"), state))
    maps = known.select("file_path", "part", "states", ends.alias("ends")).withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = _maps_in_order(maps, ["file_path", "block"], "part")
    composed = blocks.withColumn("ends", F.transform("states", lambda state: _run(F.col("maps"), state)))
    files = _maps_in_order(composed.select("file_path", "block", "states", "ends"), ["file_path"], "block")

    def starts(zero: Column) -> Column:
        """Each map with the state before it and the one after it."""
        grown = F.aggregate("maps", F.array(zero), lambda before, ends: F.array_append(before, _mapped(ends, F.element_at(before, -1))))
        return let(grown, lambda all_: F.transform("of", lambda one, i: F.struct(one.alias("of"), F.get(all_, i).alias("state"), F.get(all_, i + 1).alias("after"))))

    of_block = files.select("file_path", F.explode(starts(F.lit(_CODE))).alias("x")).select("file_path", F.col("x.of.block").alias("block"), F.col("x.state").alias("zero"))
    of_part = blocks.join(of_block, ["file_path", "block"]).select("file_path", F.explode(starts(F.col("zero"))).alias("x"))
    return of_part.select("file_path", F.col("x.of.part").alias("part"), F.col("x.state").alias("state"), F.col("x.after").alias("after"))


def split_segments(segments: DataFrame) -> DataFrame:
    """Chunks of SQL files given as (file_path, part, text), the same as `split_scripts` gives for the whole files.

    Parts rise from any number on, each once; each text but the last of a file ends with a line end. A file whose last quote never closes
    is put together and cut as a whole, since then what was read as quoted is not.
    """
    rows = segments.select("file_path", F.col("part").cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text")).where("file_path IS NOT NULL")
    states = start_states(rows)
    states = written(states.withColumn("unclosed", ~F.last("after").over(Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).isin(_CODE, "/*")), "lexer_states")
    cut = rows.join(states.where("NOT unclosed").select("file_path", "part", "state"), ["file_path", "part"])
    cut = cut.withColumn("held", F.coalesce(_closed_at(F.col("text"), F.col("state")), F.length("text")))
    cut = cut.withColumn("found", find_all(F.substring(F.col("text"), F.col("held") + 1, F.length("text")), _PIECES))
    carried = F.substring(F.col("text"), F.lit(1), F.col("held"))
    first = F.concat(carried, F.coalesce(F.get("found", F.lit(0)), F.lit("")))
    others = F.slice("found", F.lit(2), F.greatest(F.size("found"), F.lit(1)))
    whole = F.when(first == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(first), others))
    ended = F.size(F.filter("pieces", lambda piece: F.endswith(piece, F.lit(";"))))
    # A carried text that ends with ';' is still open if nothing of the segment follows it.
    cut = cut.withColumn("pieces", whole).withColumn("open", F.size("found") == 0).withColumn("ended", F.when(F.col("open"), 0).otherwise(ended))
    before = Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.select("file_path", "part", "ended", newlines(F.col("text")).alias("lines"))
    sums = sums.select("file_path", "part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ("ended", "lines")))
    pieces = cut.select("file_path", "part", "pieces").join(sums, ["file_path", "part"])
    pieces = pieces.withColumn("gone", F.transform("pieces", newlines))
    pieces = pieces.withColumn("after", running(F.col("gone"), F.lit(0), lambda total, step: total + step, "int"))
    lined = F.arrays_zip(F.col("pieces").alias("body"), F.col("gone").alias("gone"), F.col("after").alias("after"))
    pieces = pieces.select("file_path", "part", "ended_before", "lines_before", F.size("pieces").alias("n"), F.posexplode(lined).alias("at", "piece"))
    pieces = pieces.select(
        "file_path", "part", (F.col("ended_before") + F.col("at")).alias("ord"), "piece.body",
        (F.col("lines_before") + 1 + F.col("piece.after") - F.col("piece.gone")).alias("line"),
        ((F.col("at") > 0) & (F.col("at") < F.col("n") - 1)).alias("inner"),
    )
    joined = pieces.where("NOT inner").groupBy("file_path", "ord").agg(F.array_sort(F.collect_list(F.struct("part", "body", "line"))).alias("of"))
    joined = joined.select("file_path", "ord", F.array_join("of.body", "").alias("body"), F.col("of")[0]["line"].alias("line"))
    pieces = pieces.where("inner").select("file_path", "ord", "body", "line").union(joined).withColumn("mode", F.lit("statement"))
    out = finish_statements(pieces).select(
        "file_path", F.lit("sql").alias("file_type"), F.col("ord").cast("int").alias("ord"), F.col("sql_type").alias("chunk_type"), F.col("sql_text").alias("raw_text"),
        F.col("sql_start").cast("int").alias("line_start"), F.col("sql_end").cast("int").alias("line_end"),
    )
    out = out.withColumn("chunk_id", chunk_key()).select(*CHUNK_COLUMNS)
    parts = rows.join(states.where("unclosed").select("file_path", "part"), ["file_path", "part"]).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("of"))
    whole_files = parts.select("file_path", F.lit("sql").alias("file_type"), F.array_join("of.text", "").alias("source"))
    return out.union(split_scripts(whole_files))
