"""Tables and scripts as a directed graph: two frames, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.text import base_name


def _ends(results: DataFrame, by_path: bool) -> DataFrame:
    name = F.col("file_path") if by_path else base_name(F.col("file_path"))
    return results.select(
        "*",
        F.concat(F.lit("table:"), "matched_canonical").alias("table_id"),
        F.concat(F.lit("file:"), name).alias("file_id"),
        F.struct("query", (-F.col("final_score")).alias("_by"), "chunk_id").alias("_order"),
    )


def nodes(results: DataFrame, by_path: bool = False) -> DataFrame:
    """(id, node_type, label, full_path, file_type). Scripts of one base name share a node, with the first one's
    path; `by_path` keeps them apart."""
    ends = _ends(results, by_path)
    tables = ends.select(
        F.col("table_id").alias("id"), F.lit("table").alias("node_type"), F.col("matched_canonical").alias("label"),
        F.lit(None).cast("string").alias("full_path"), F.lit(None).cast("string").alias("file_type"),
    ).distinct()
    first = ends.groupBy(F.col("file_id").alias("id")).agg(
        F.min_by(F.struct("file_path", "file_type"), "_order").alias("_first")
    )
    files = first.select(
        "id", F.lit("file").alias("node_type"), base_name(F.col("_first.file_path")).alias("label"),
        F.col("_first.file_path").alias("full_path"), F.col("_first.file_type").alias("file_type"),
    )
    return tables.unionByName(files)


def edges(results: DataFrame, by_path: bool = False) -> DataFrame:
    """(src, dst, operation, lines, score): script to table for writes, table to script otherwise.

    Two ends have one edge each way; the last result between them gives its attributes. With `by_path`, ends are
    told apart by path and every operation keeps its own edge.
    """
    writes = F.col("operation").isin(settings.WRITE_OPERATIONS)
    keys = ["src", "dst", "operation"] if by_path else ["src", "dst"]
    directed = _ends(results, by_path).select(
        F.when(writes, F.col("file_id")).otherwise(F.col("table_id")).alias("src"),
        F.when(writes, F.col("table_id")).otherwise(F.col("file_id")).alias("dst"),
        "operation",
        "_order",
        F.struct(
            F.col("operation").alias("op"),
            F.concat("line_start", F.lit("-"), "line_end").alias("lines"),
            F.col("final_score").alias("score"),
        ).alias("_edge"),
    )
    last = directed.groupBy(*keys).agg(F.max_by("_edge", "_order").alias("_edge"))
    return last.select("src", "dst", F.col("_edge.op").alias("operation"), "_edge.lines", "_edge.score")


def table_summary(edge_rows: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(canonical, operation, entry) rows for all tables, or those in tables(canonical).

    What leaves a table counts as READ, whatever the edge says; what enters it counts by its operation.
    """
    out_of = F.startswith("src", F.lit("table:"))
    rows = edge_rows.select(
        F.substring(F.when(out_of, F.col("src")).otherwise(F.col("dst")), 7, 2**31 - 1).alias("canonical"),
        F.when(out_of, "READ").otherwise(F.col("operation")).alias("operation"),
        F.concat(
            base_name(F.substring(F.when(out_of, F.col("dst")).otherwise(F.col("src")), 6, 2**31 - 1)),
            F.lit(" (lines "), "lines", F.lit(")"),
        ).alias("entry"),
    )
    return rows if tables is None else rows.join(tables.select("canonical"), "canonical", "left_semi")


def size(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    counts = node_rows.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edge_rows.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count")
    )


def export(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """Node and edge files for a graph viewer: JSON lines under path/nodes and path/edges."""
    title = F.concat("node_type", F.lit(": "), F.coalesce("full_path", "label"))
    node_rows.select("id", "label", F.col("node_type").alias("type"), title.alias("title")).write.mode(
        "overwrite"
    ).json(f"{path}/nodes")
    edge_title = F.concat("operation", F.lit(" (lines "), "lines", F.lit(")"))
    edge_rows.select(
        F.col("src").alias("from"), F.col("dst").alias("to"), F.col("operation").alias("label"), "lines",
        edge_title.alias("title"),
    ).write.mode("overwrite").json(f"{path}/edges")
