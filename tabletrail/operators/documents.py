"""Chunks with their tables, names and operations woven into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail.functions.text import name_key
from tabletrail.operators.refs import REF

LISTS = ["canonical_tables", "aliases_used", "operations"]
_USED = "array<struct<canonical:string,raw:string,op:string>>"
DOCUMENT_COLUMNS = [
    "chunk_id", "file_path", "file_type", "chunk_type", "line_start", "line_end", "raw_text", *LISTS, "embedding_text",
]


def attach_refs(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Bring reference rows from elsewhere, such as model replies, to their chunks; a chunk without any keeps an
    empty array. Only the references are grouped, one reply at a time; the texts are joined once."""
    grouped = refs.groupBy("chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "raw", "canonical", "ref_type", "confidence"))).alias("_refs")
    )
    joined = chunks.drop("refs").join(grouped, "chunk_id", "left")
    return joined.withColumn("refs", F.coalesce("_refs", F.array().cast(f"array<{REF}>"))).drop("_refs")


def add_lists(chunks_with_refs: DataFrame) -> DataFrame:
    """Add canonical_tables, aliases_used and operations: distinct, in order of first use, without columns."""
    used = F.filter("refs", lambda r: r["canonical"].isNotNull() & (r["ref_type"] != "COLUMN"))
    keyed = F.transform(
        used,
        lambda r: F.struct(
            name_key(r["canonical"]).alias("canonical"), name_key(r["raw"]).alias("raw"), r["ref_type"].alias("op")
        ),
    )
    out = chunks_with_refs.withColumn("_used", F.when(F.size("refs") == 0, F.array().cast(_USED)).otherwise(keyed))

    def listed(keep, field: str) -> Column:
        return F.array_distinct(F.transform(F.filter("_used", keep), lambda r: r[field]))

    return out.withColumns(
        {
            "canonical_tables": listed(lambda r: r["canonical"] != "", "canonical"),
            "aliases_used": listed(lambda r: (r["raw"] != "") & (r["raw"] != r["canonical"]), "raw"),
            "operations": listed(lambda r: r["op"] != "", "op"),
        }
    ).drop("_used")


def document_text() -> Column:
    def line(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label + ": "), F.array_join(column, ", ")))

    entities = F.concat_ws(
        "\n",
        line("Tables referenced", "canonical_tables"),
        line("Aliases used in code", "aliases_used"),
        line("Operations", "operations"),
        F.concat(F.lit("File: "), "file_path", F.lit(", lines "), "line_start", F.lit("-"), "line_end"),
        F.concat(F.lit("Language: "), "file_type", F.lit(", block type: "), "chunk_type"),
    )
    return F.concat(F.lit("[CODE]\n"), F.col("raw_text"), F.lit("\n\n[ENTITIES]\n"), entities)


def build_documents(chunks_with_refs: DataFrame) -> DataFrame:
    """One document per chunk, inside its own row. The lists stay arrays; refs come last."""
    out = add_lists(chunks_with_refs)
    return out.withColumn("embedding_text", document_text()).select(*DOCUMENT_COLUMNS, "refs")
