"""Joins and cuts that stay spread out when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrail import settings


def is_few(rows: DataFrame, limit: int = settings.BROADCAST_ROWS) -> bool:
    """Whether a frame has at most `limit` rows; reads no more than needed to know."""
    return rows.limit(limit + 1).count() <= limit


def lookup_join(large: DataFrame, lookup: DataFrame, keys: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Join with a lookup side that is broadcast if its row count proves small, and salted otherwise.

    The check runs the lookup side once, so it suits sides that are cheap to make.
    """
    if is_few(lookup):
        return large.join(F.broadcast(lookup), keys, how)
    return salted_join(large, lookup, keys, spread_by, how)


def salted_join(
    large: DataFrame, lookup: DataFrame, keys: list[str], spread_by: str, how: str = "inner", salts: int = settings.SALTS
) -> DataFrame:
    """Equi-join of a side that may crowd on few keys with a lookup side that has few rows per key.

    Rows of one key are dealt to `salts` parts by a hash of `spread_by`; the lookup side is repeated per part.
    """
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group, numbered from 1.

    Spark cuts to k rows per group and input partition before the shuffle (WindowGroupLimit), so a crowded group
    arrives as k rows per partition. That holds up to spark.sql.optimizer.windowGroupLimitThreshold; above it the
    same two steps are spelled out.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(settings.SALTS * settings.SALTS)))
        rows = rows.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k).drop("_part", "_place")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
