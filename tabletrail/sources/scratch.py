"""Intermediate tables, written once and read by several later steps.

They go to the folder that the cluster names in `spark.checkpoint.dir`, so that every executor can read them and a lost
executor costs nothing already written. A session whose executors live in the driver's own process shares the driver's
disk, and may do without the setting; any other session must have it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

SETTING = "spark.checkpoint.dir"


class NoSharedFolder(RuntimeError):
    pass


def _setting(spark: SparkSession) -> str | None:
    given = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not given:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = held.get() if held.isDefined() else None
    return given


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    given = _setting(spark)
    if not given:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder(f"set {SETTING} to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tabletrail-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.conf.set(SETTING, given)
    return f"{given.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def compact(writer: DataFrameWriter) -> DataFrameWriter:
    """The writer with encodings that store only what differs from the row before, compressed well; for rows that take much disk."""
    return writer.option("parquet.writer.version", "v2").option("compression", "zstd")


def written(frame: DataFrame, name: str, by: str | None = None, small: bool = False) -> DataFrame:
    """The frame as a table in the shared folder, read back: later jobs start from it, whatever executors are lost.

    by: a column of few values to lay the table out by; crowded values are split over several files. small: in less disk, for a
    little more time.
    """
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        (compact(frame.write) if small else frame.write).parquet(path)
    else:
        frame.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return frame.sparkSession.read.parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Results that still read them must have been consumed."""
    if not _setting(spark):
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
