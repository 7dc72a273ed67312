"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a table that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, in their order and with their types:

1. quality_rules drops what the weakly supervised rules reject (null texts have no words and go).
2. near_copies keeps of each group of near copies the document with the least doc_id. Rows without doc_id stay.
3. repeats removes passages of 100 bytes or more that occur earlier, whole characters only; n_chars is counted anew.
4. decontaminate drops documents that contain a benchmark item.
5. pack returns the pieces of documents in sequences. Documents left empty by stage 3 have their end id alone.

Rows that repeat a doc_id are one document to stages 2 to 4 and should be copies of one row. Columns beyond documents' own are
carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabletrail.llm import containment, near_copies, packing, quality, repeats
from tabletrail.llm.tasks import without_ids
from tabletrail.sources.scratch import written

#: Similarity of near copies in percent; the 85 of op5_minhash_near_copies is that query's own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.kept_documents(docs, NEAR_PERCENT)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_ids(docs, containment.contained(docs, items).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No SQL: stages estimate, hash, sort suffixes and tokenise. tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
