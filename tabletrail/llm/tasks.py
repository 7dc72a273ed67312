"""How the operators of this subpackage read their tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch. Rows hold whole texts or sets of shingles, so a batch of the session's default of 10,000 can take
#: hundreds of megabytes on both sides of the pipe.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def dealt(rows: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores is dealt out before per-row work; a larger one is not moved."""
    _small_batches(rows.sparkSession)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * 2) if rows.rdd.getNumPartitions() < cores else rows


def by_batch(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` on each Arrow batch, in tasks; a batch has at most BATCH_ROWS rows."""

    _small_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return rows.mapInArrow(each, schema)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among `ids` (one column); rows without doc_id stay. No name can clash."""
    name = "id"
    while name in docs.columns:
        name += "_"
    gone = ids.toDF(name).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
