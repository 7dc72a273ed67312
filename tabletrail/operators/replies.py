"""What a user's model is asked, and what it answered, as tables.

No model is called here. A user brings a function, or a table of replies made elsewhere.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrail.functions.text import is_json_group, strip, unfence
from tabletrail.operators.chunks import is_extractable
from tabletrail.sources.scratch import written

REPLY_SCHEMA = "chunk_id string, reply string, error string"


def _items(reply: Column, fields: str) -> Column:
    """The objects of a JSON array; null for anything that is not a JSON array."""
    text = unfence(reply)
    valid = F.startswith(text, F.lit("[")) & is_json_group(text)
    return F.when(valid, F.from_json(text, f"array<struct<{fields}>>"))


def extraction_inputs(chunks: DataFrame, code_chars: int | None = None) -> DataFrame:
    """(chunk_id, prompt) for chunks long enough to name a table; with `code_chars` the code is cut to that length."""
    code = F.col("raw_text") if code_chars is None else F.substring("raw_text", 1, code_chars)
    prompt = F.concat(
        F.lit("File: "), "file_path", F.lit("\nType: "), "file_type",
        F.lit("\nLines: "), "line_start", F.lit("-"), "line_end",
        F.lit("\n\nCode:\n"), code,
    )
    return chunks.where(is_extractable()).select("chunk_id", prompt.alias("prompt"))


def call_model(
    inputs: DataFrame, answer: Callable[[str], str], workers: int | None = None, store: str | None = None, at_once: int = 1
) -> DataFrame:
    """(chunk_id, reply, error): a user function applied to every prompt, as many at a time as there are partitions.

    A prompt whose call fails keeps its row, with the error and no reply. With `store`, a folder that all workers can open, calls are
    resumable, as in resumable_calls.
    """
    if store is not None:
        return resumable_calls(inputs, answer, store, workers, at_once)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch["prompt"]:
                reply = error = None
                try:
                    reply = answer(prompt)
                except Exception as failure:  # noqa: BLE001 - any failure of the user's function is a result
                    error = f"{type(failure).__name__}: {failure}"
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "reply": replies, "error": errors})

    spread = inputs.repartition(workers, "chunk_id") if workers else inputs
    return spread.mapInPandas(run, REPLY_SCHEMA)


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """(key, reply) of all replies ever stored; key is the prompt's SHA-256. A line cut off by a lost worker is left out."""
    try:
        rows = spark.read.schema("key string, reply string").json(f"{store.rstrip('/')}/*/*.jsonl")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "key string, reply string")
    return rows.where("key IS NOT NULL AND reply IS NOT NULL").dropDuplicates(["key"])


def resumable_calls(inputs: DataFrame, answer: Callable[[str], str], store: str, workers: int | None = None, at_once: int = 1) -> DataFrame:
    """(chunk_id, reply, error), asking for each distinct prompt once over all runs with this store.

    A worker appends each reply to its partition's file as soon as it has it. A task that runs again reads what its earlier attempts
    stored and asks for the rest; a later run leaves out all prompts that are stored. `workers` tasks have `at_once` calls open each.
    Failed calls are not stored: they have a row with the error, and the next run asks again. Only calls that were open when a worker was
    lost, or that run in two attempts at once, can be asked twice.
    """
    folder = re.sub(r"^file:/+", "/", store.rstrip("/"))
    if "://" in folder:
        raise ValueError(f"{store} is no folder that workers can open")
    spark = inputs.sparkSession
    keyed = inputs.select("chunk_id", "prompt", F.sha2("prompt", 256).alias("key"))
    missing = keyed.select("key", "prompt").dropDuplicates(["key"]).join(stored_replies(spark, store).select("key"), "key", "left_anti")
    run = f"{folder}/run-{uuid.uuid4().hex}"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = f"p{context.partitionId():06d}"
        os.makedirs(run, exist_ok=True)
        known = {}
        for name in sorted(n for n in os.listdir(run) if n.startswith(part)):
            with open(f"{run}/{name}", encoding="utf-8") as file:
                for line in file:
                    if line.endswith("\n"):
                        entry = json.loads(line)
                        known[entry["key"]] = entry["reply"]

        def one(key: str, prompt: str) -> tuple[str, str | None, str | None]:
            try:
                return key, answer(prompt), None
            except Exception as failure:  # noqa: BLE001 - any failure of the user's function is a result
                return key, None, f"{type(failure).__name__}: {failure}"

        name = f"{run}/{part}-{context.taskAttemptId()}.jsonl"
        with open(name, "a", encoding="utf-8") as file, ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                asked = [(k, p) for k, p in zip(batch["key"], batch["prompt"], strict=True) if k not in known]
                rows = [(k, known[k], None) for k in batch["key"] if k in known]
                for start in range(0, len(asked), at_once):
                    for key, reply, error in pool.map(lambda kp: one(*kp), asked[start : start + at_once]):
                        if reply is not None:
                            file.write(json.dumps({"key": key, "reply": reply}) + "\n")
                            file.flush()
                        rows.append((key, reply, error))
                yield pd.DataFrame(rows, columns=["key", "reply", "error"], dtype=object)

    spread = missing.repartition(workers or spark.sparkContext.defaultParallelism, "key")
    asked = written(spread.mapInPandas(ask, "key string, reply string, error string"), "asked_prompts")
    failed = asked.where("reply IS NULL").select("key", "error")
    return keyed.drop("prompt").join(stored_replies(spark, store), "key", "left").join(failed, "key", "left").select("chunk_id", "reply", "error")


def parse_references(replies: DataFrame) -> DataFrame:
    """(chunk_id, ord, raw, canonical, ref_type, confidence) rows of (chunk_id, reply).

    Text that is no JSON array gives no rows, and neither do items without a name.
    """
    fields = "raw:string,canonical:string,type:string,confidence:string"
    items = replies.select("chunk_id", F.posexplode_outer(_items(F.col("reply"), fields)))
    return items.where("col.raw IS NOT NULL").select(
        "chunk_id",
        F.col("pos").alias("ord"),
        "col.raw",
        "col.canonical",
        F.coalesce("col.type", F.lit("UNKNOWN")).alias("ref_type"),
        F.coalesce("col.confidence", F.lit("low")).alias("confidence"),
    )


def refs_with_fallback(replies: DataFrame, chunks_with_refs: DataFrame) -> DataFrame:
    """Reference rows from replies; chunks whose call failed keep the references found by patterns.

    Replies are read for both, so they are stored: a lazy table of calls would ask the model twice.
    """
    replies = written(replies, "replies")
    failed = replies.where("error IS NOT NULL").select("chunk_id")
    by_pattern = (
        chunks_with_refs.select("chunk_id", "refs")
        .join(failed, "chunk_id", "left_semi")
        .select("chunk_id", F.inline_outer("refs"))
        .where("raw IS NOT NULL")
    )
    return parse_references(replies.where("error IS NULL")).unionByName(by_pattern)


def judgement_inputs(hits: DataFrame, limit: int | None = None, code_chars: int | None = None) -> DataFrame:
    """(query, snippets): the ranked hits of each query, at most `limit` if given, as one JSON text. Their code is whole
    unless `code_chars` is given."""
    code = strip(F.col("raw_text"))
    snippet = F.struct(
        "rank",
        F.struct(
            F.col("chunk_id"),
            F.col("file_path").alias("file"),
            F.concat("line_start", F.lit("-"), "line_end").alias("lines"),
            F.col("file_type").alias("type"),
            (code if code_chars is None else F.substring(code, 1, code_chars)).alias("code_excerpt"),
        ).alias("item"),
    )
    first = hits if limit is None else hits.where(F.col("rank") <= limit)
    listed = first.groupBy("query").agg(F.sort_array(F.collect_list(snippet)).alias("_all"))
    return listed.select("query", F.to_json(F.transform("_all", lambda s: s["item"])).alias("snippets"))


def parse_judgements(replies: DataFrame) -> DataFrame:
    """(query, chunk_id, relevance_score, operation, explanation, matched_via) rows of (query, reply).

    Items need a chunk_id; if two name the same chunk, the later one counts.
    """
    fields = "chunk_id:string,relevance_score:string,operation:string,explanation:string,matched_via:string"
    items = replies.select("query", F.posexplode_outer(_items(F.col("reply"), fields))).where("col.chunk_id IS NOT NULL")
    last = items.groupBy("query", "col.chunk_id").agg(F.max_by("col", "pos").alias("last"))
    return last.select(
        "query",
        "chunk_id",
        F.coalesce(F.col("last.relevance_score").try_cast("double"), F.lit(0.0)).alias("relevance_score"),
        "last.operation",
        "last.explanation",
        "last.matched_via",
    )
