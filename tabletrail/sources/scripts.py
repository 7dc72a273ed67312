"""Script files as rows: one row per file, with its whole text."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.sources.scratch import written

# Rows of one batch of a listing.
LISTED_ROWS = 10_000
SCRIPT_SCHEMA = "file_path string, source string"


def file_type(path: Column) -> Column:
    """sql, python or shell by extension in any case; null for all other files."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for extension, name in settings.FILE_TYPES.items():
        kind = F.when(suffix == extension, name).otherwise(kind)
    return kind


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`; a path elsewhere stays whole."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def is_excluded(path: Column, root: str, excluded: Iterable[str]) -> Column:
    """True if any part of the path below `root`, the file name included, is one of `excluded`."""
    names = F.array(*[F.lit(name) for name in excluded]).cast("array<string>")
    return F.arrays_overlap(F.split(relative_path(path, root), "/"), names)


def plain_path(uri: Column) -> Column:
    """A local file: URI as a path; other schemes keep theirs."""
    local = F.regexp_replace(F.regexp_replace(uri, r"^file:/+", "/"), r"\+", "%2B")
    return F.when(F.startswith(uri, F.lit("file:")), F.url_decode(local)).otherwise(uri)


def with_file_type(files: DataFrame) -> DataFrame:
    """Add file_type and drop files of other kinds."""
    return files.withColumn("file_type", file_type(F.col("file_path"))).where("file_type IS NOT NULL")


def read_scripts(spark: SparkSession, root: str, excluded: Iterable[str] = (), include_hidden: bool = False) -> DataFrame:
    """All .sql, .py and .sh files below `root` as (file_path, source). A missing root gives no rows.

    The exclusion only reads the file's path, so Spark applies it to the file listing. Spark never lists names that
    start with "_" or ".", and has no row for an empty file; `include_hidden` reads those too, on folders every executor can open
    as files.
    """
    local = "://" not in root
    root = os.path.abspath(root) if local else root.rstrip("/")
    excluded = list(excluded)
    if include_hidden:
        files = _read_listed(spark, root)
    else:
        try:
            files = (
                spark.read.option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.{" + ",".join(settings.FILE_TYPES) + "}")
                .text(root, wholetext=True)
                .select(plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("source"))
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], SCRIPT_SCHEMA)
    if excluded:
        files = files.where(~is_excluded(F.col("file_path"), root, excluded))
    return files.withColumn("source", F.regexp_replace("source", "\r\n?", "\n"))


def _read_listed(spark: SparkSession, root: str, part_bytes: int = settings.LISTED_BYTES) -> DataFrame:
    """Files below a shared folder, listed and read in tasks: folders level by level, then files in parts of about equal size.

    Only the number of folders of a level comes to the driver. A level's folders are dealt out, so neither a broad nor a deep tree is one
    task's work. A link to a folder is not followed.
    """
    extensions = tuple("." + extension for extension in settings.FILE_TYPES)
    cores = spark.sparkContext.defaultParallelism

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as entries:
                    found = [(e.path, e.is_dir(follow_symlinks=False), e) for e in entries]
                rows = [(path, True, 0) for path, is_folder, _ in found if is_folder]
                rows += [(path, False, e.stat().st_size) for path, is_folder, e in found if not is_folder and path.endswith(extensions) and e.is_file()]
                for at in range(0, len(rows), LISTED_ROWS):
                    names = list(zip(*rows[at : at + LISTED_ROWS], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(names, (pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["path", "is_folder", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, encoding="utf-8", errors="replace", newline="") as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()])], names=["file_path", "source"])

    folders, levels = spark.createDataFrame([(root,)] if os.path.isdir(root) else [], "path string"), []
    while not folders.isEmpty():
        level = written(folders.repartition(cores * 4, "path").mapInArrow(listing, "path string, is_folder boolean, size long"), "listed")
        levels.append(level.where("NOT is_folder"))
        folders = level.where("is_folder").select("path")
    if not levels:
        return spark.createDataFrame([], SCRIPT_SCHEMA)
    files = reduce(lambda a, b: a.unionByName(b), levels)
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(cores, -(-total // part_bytes))
    return files.repartition(parts, F.xxhash64("path")).select("path").mapInArrow(read, SCRIPT_SCHEMA)
