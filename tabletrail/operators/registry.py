"""Names of tables: which names mean which table, and which files use it.

A registry is three narrow frames, one fact per row, so that a table named by a third of all files is many rows and
never one long list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.functions.joins import lookup_join
from tabletrail.functions.text import name_key
from tabletrail.sources.scratch import written


@dataclass(frozen=True)
class Registry:
    names: DataFrame  # canonical, alias
    files: DataFrame  # canonical, file_path
    current: DataFrame  # alias, canonical, run: the one table a name stands for


def build_registry(refs: DataFrame, run: int = 1) -> Registry:
    """Registry of reference rows. Columns and references without a table are left out.

    If a name stands for several tables, the last reference in (file, line, position) order decides.
    """
    kept = refs.where("canonical IS NOT NULL AND ref_type <> 'COLUMN'").select(
        name_key(F.col("canonical")).alias("canonical"),
        name_key(F.col("raw")).alias("raw"),
        "file_path",
        (F.col("line_start").cast("long") * 2**31 + F.col("ord")).alias("at"),
    )
    kept = kept.where("canonical <> '' AND raw <> ''")
    # Places are numbers, which a hash aggregation can hold; paths are not. So a file's last reference comes first, then files get
    # numbers in the order of their paths, and only these rows, one per pair and file, are compared by path.
    last = written(kept.groupBy("canonical", "raw", "file_path").agg(F.max("at").alias("at")), "references")
    files = written(last.select("file_path").distinct().sort("file_path").withColumn("_file", F.monotonically_increasing_id()), "files")
    place = F.col("_file").cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)") + F.col("at")
    pairs = last.join(files, "file_path").groupBy("canonical", "raw").agg(F.max(place.cast("decimal(38,0)")).alias("place"))
    names = pairs.select("canonical", F.explode(F.array("canonical", "raw")).alias("alias"), "place")
    newest = names.groupBy("alias").agg(F.max("place").alias("place"))
    return Registry(
        names=names.select("canonical", "alias").distinct(),
        files=last.select("canonical", "file_path").distinct(),
        current=names.join(newest, ["alias", "place"]).select("alias", "canonical").distinct().withColumn("run", F.lit(run)),
    )


def merge_registries(stored: Registry, new: Registry) -> Registry:
    """Union of both; where they disagree about a name, the later run decides. Nothing is forgotten."""
    return Registry(
        names=stored.names.unionByName(new.names).distinct(),
        files=stored.files.unionByName(new.files).distinct(),
        current=stored.current.unionByName(new.current)
        .groupBy("alias")
        .agg(F.max_by("canonical", F.struct("run", "canonical")).alias("canonical"), F.max("run").alias("run")),
    )


def _lookup(few: DataFrame, many: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join of a few rows with a large table: the large side is cut to the wanted keys before it moves."""
    return few.join(lookup_join(many, few.select(key).distinct(), [key], spread_by), key, "left")


def resolve(queries: DataFrame, registry: Registry) -> DataFrame:
    """Add canonical to (query) rows; an unknown name stands for itself."""
    keyed = queries.withColumn("alias", name_key(F.col("query")))
    found = _lookup(keyed, registry.current.select("alias", F.col("canonical").alias("_canonical")), "alias", "alias")
    return found.withColumn("canonical", F.coalesce("_canonical", "alias")).drop("_canonical", "alias")


def aliases_of(queries: DataFrame, registry: Registry) -> DataFrame:
    """(query, canonical, alias) rows, one per name of the table; an unknown name is its own only alias.

    A query that is itself a table's name means that table, even if it is also another table's alias.
    """
    keyed = resolve(queries.select("query"), registry).withColumn("own", name_key(F.col("query")))
    tables = registry.names.select(F.col("canonical").alias("own"), F.lit(True).alias("_is_table")).distinct()
    chosen = _lookup(keyed, tables, "own", "own").select(
        "query", F.when(F.col("_is_table"), F.col("own")).otherwise(F.col("canonical")).alias("canonical")
    )
    return _lookup(chosen, registry.names, "canonical", "alias").select(
        "query", "canonical", F.coalesce("alias", "canonical").alias("alias")
    )


def expand(queries: DataFrame, registry: Registry) -> DataFrame:
    """(query, canonical, alias) rows for searching: resolve first, then all names of that table."""
    resolved = resolve(queries.select("query"), registry)
    return _lookup(resolved, registry.names, "canonical", "alias").select(
        "query", "canonical", F.coalesce("alias", "canonical").alias("alias")
    )


def files_of(queries: DataFrame, registry: Registry) -> DataFrame:
    """(query, canonical, file_path) rows; an unknown table has none."""
    resolved = resolve(queries.select("query"), registry)
    return lookup_join(registry.files, resolved, ["canonical"], "file_path").select("query", "canonical", "file_path")


def all_tables(registry: Registry) -> DataFrame:
    return registry.names.select("canonical").distinct()


def report(registry: Registry) -> DataFrame:
    """Per table: its other names, and the number of files that use it."""
    counts = registry.files.groupBy("canonical").agg(F.count("*").alias("file_count"))
    others = registry.names.groupBy("canonical").agg(
        F.sort_array(F.collect_set(F.when(F.col("alias") != F.col("canonical"), F.col("alias")))).alias("other_names")
    )
    return others.join(counts, "canonical", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def known_tables(registry: Registry, limit: int = settings.KNOWN_TABLES) -> DataFrame:
    """The first tables by name, each with its other names."""
    first = all_tables(registry).orderBy("canonical").limit(limit)
    names = _lookup(first, registry.names.where("alias <> canonical"), "canonical", "alias")
    return names.groupBy("canonical").agg(F.sort_array(F.collect_set("alias")).alias("other_names"))
