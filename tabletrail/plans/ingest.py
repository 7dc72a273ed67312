"""From scripts to a published index."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tabletrail import settings
from tabletrail.operators import bm25, vectors
from tabletrail.operators.chunks import split_scripts
from tabletrail.operators.documents import attach_refs, build_documents
from tabletrail.operators.refs import add_refs, name_aliases, ref_rows
from tabletrail.operators.registry import build_registry
from tabletrail.operators.replies import call_model, extraction_inputs, refs_with_fallback
from tabletrail.sources import snapshots
from tabletrail.sources.scripts import read_scripts


def ingest(
    spark: SparkSession,
    scripts: str | DataFrame,
    index_root: str,
    excluded: Iterable[str] = (),
    rules: Iterable[tuple[str, str]] | DataFrame = (),
    answer: Callable[[str], str] | None = None,
    workers: int | None = None,
    replies_at: str | None = None,
    rebuild: bool = False,
    keep_stored: bool = False,
    include_hidden: bool = False,
    shell_writes: bool = False,
    skip_imports: bool = False,
    features: int = 256,
    buckets: int = settings.STORE_BUCKETS,
    max_segments: int = settings.MAX_SEGMENTS,
) -> str | None:
    """Split, extract and publish; the path of the new snapshot, or None if there was nothing to index.

    scripts: a folder, or a table of (file_path, source), which suits very many small files. `excluded` and `include_hidden`
    apply to a folder. With `answer`, a user function from prompt to reply, references come from its replies, and from
    patterns where a call failed. Without it all come from patterns, with `rules` (a list, or a table of alias and canonical)
    naming aliases; `replies_at` is a folder that keeps the replies, so that a run after one that died asks only for what is
    missing. `shell_writes` and `skip_imports` as in add_refs. `rebuild` starts a new registry instead of adding to the
    stored one. `keep_stored` adds to the stored index: files that came again replace their stored chunks, others stay, and only what
    is new is written. Beyond `max_segments` such runs the index is merged into one segment. `buckets` is the number of folders
    documents and postings are laid out in; thousands suit very large indexes. It and `features` stay as they are in an index
    that is added to.

    Documents are written first and read back for everything after them, so lost executors cost one stage and the texts are
    split once. With a model the chunks are written before that: prompts, fallback and documents read them back.
    """
    files = scripts if isinstance(scripts, DataFrame) else read_scripts(spark, scripts, excluded, include_hidden)
    if files.isEmpty():
        return None
    staging = snapshots.begin(spark, index_root, buckets)
    found = add_refs(split_scripts(files), shell_writes=shell_writes, skip_imports=skip_imports)
    chunks = name_aliases(found, rules if isinstance(rules, DataFrame) else list(rules))
    if answer is not None:
        chunks.write.parquet(f"{staging.path}/chunks")
        chunks = spark.read.parquet(f"{staging.path}/chunks")
        replies = f"{staging.path}/replies"
        call_model(extraction_inputs(chunks), answer, workers, replies_at).write.parquet(replies)
        chunks = attach_refs(chunks, refs_with_fallback(spark.read.parquet(replies), chunks))
    staging.write_documents(build_documents(chunks))
    documents = spark.read.parquet(f"{staging.path}/documents")

    staging.write_postings(bm25.postings_of(documents))
    staging.write_blocks(bm25.blocks_of(spark.read.parquet(f"{staging.path}/postings"), buckets))
    staging.write_vectors(vectors.text_counts(documents.select("chunk_id", "canonical_tables", "embedding_text"), features=features, keep_text=False))

    if rebuild and keep_stored and snapshots.current_path(spark, index_root):
        stored = snapshots.read_documents(spark, index_root)
        documents = stored.join(documents.select("file_path").distinct(), "file_path", "left_anti").unionByName(documents)
    staging.write_registry(build_registry(ref_rows(documents), run=staging.number))
    path = staging.commit(add=keep_stored, rebuild=rebuild, features=features)
    if keep_stored and len(snapshots.current_version(spark, index_root).segments) > max_segments:
        path = snapshots.merge(spark, index_root)
    return path
