"""Results as one row per script, and as detail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrail.functions.text import base_name, strip


def group_by_file(results: DataFrame) -> DataFrame:
    """(query, file_path) groups: operations, best score, way of matching, names used, chunks by line."""
    chunk = F.struct("line_start", (-F.col("final_score")).alias("_by"), "chunk_id", "line_end", "operation", "final_score")
    grouped = results.groupBy("query", "file_path").agg(
        F.min("file_type").alias("file_type"),
        F.sort_array(F.collect_set("operation")).alias("operations"),
        F.greatest(F.max("final_score"), F.lit(0.0)).alias("best_score"),
        F.max(F.when(F.col("matched_via") == "alias", 1).otherwise(0)).alias("_alias"),
        F.array_distinct(F.flatten(F.collect_set("aliases_used"))).alias("_aliases"),
        F.sort_array(F.collect_list(chunk)).alias("chunks"),
    )
    names = F.filter(F.transform("_aliases", strip), lambda a: a != "")
    return grouped.select(
        "query",
        "file_path",
        base_name(F.col("file_path")).alias("file_name"),
        "file_type",
        "operations",
        "best_score",
        F.when(F.col("_alias") == 1, "alias").otherwise("direct").alias("matched_via"),
        F.sort_array(names).alias("aliases_used"),
        "chunks",
    )


def summary(groups: DataFrame) -> DataFrame:
    """The rows a reader sees and downloads, best script first when ordered by query, relevance and path."""
    names = F.array_join("aliases_used", ", ")
    return groups.select(
        "query",
        F.col("file_name").alias("script"),
        F.array_join("operations", " + ").alias("operations"),
        "matched_via",
        F.when(names == "", "—").otherwise(names).alias("aliases_used"),
        F.round("best_score", 3).alias("relevance_score"),
        F.col("file_path").alias("full_path"),
    )


def banner(results: DataFrame) -> DataFrame:
    """Per query: the table, its other names and how many scripts refer to it."""
    other = F.array_remove(F.col("matched_aliases"), F.col("matched_canonical"))
    return (
        results.groupBy("query", "matched_canonical", other.alias("other_names"))
        .agg(F.countDistinct("file_path").alias("script_count"))
    )


def _first(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def details(results: DataFrame, explanation_chars: int | None = None, code_chars: int | None = None) -> DataFrame:
    """One row per chunk: operation, lines, explanation and code, both whole unless a length is given."""
    language = (
        F.when(F.col("file_type") == "shell", "bash")
        .when(F.col("file_type").isin("python", "sql"), F.col("file_type"))
        .otherwise("text")
    )
    return results.select(
        "query",
        "file_path",
        "chunk_id",
        "operation",
        F.concat(F.lit("lines "), "line_start", F.lit("–"), "line_end").alias("lines"),
        _first(F.col("explanation"), explanation_chars).alias("explanation"),
        _first(strip(F.col("raw_text")), code_chars).alias("code"),
        language.alias("language"),
    )


def write_csv(summary_rows: DataFrame, path: str) -> None:
    summary_rows.orderBy("query", F.desc("relevance_score"), "full_path").write.mode("overwrite").option(
        "header", True
    ).csv(path)
