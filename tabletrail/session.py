"""A session with the settings the jobs assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app_name: str = "tabletrail", **conf: str) -> SparkSession:
    """Session for local runs; on a cluster pass the master's own settings through spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    return builder.getOrCreate()
