"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from tabletrail.llm import compact_windows, containment, html_text, language_model, lexical_search, near_copies, packing, quality, repeats, secret_spans, token_counts, toxicity, variants
from tabletrail.llm.check_sql import ORACLES  # noqa: F401 - registered with the queries
from tabletrail.llm.tasks import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_compact_windows(spark, sf_dir) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


@query
def op2_kneser_ney(spark, sf_dir) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark, sf_dir) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"
    )


def bpe_files() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op4_html_text(spark, sf_dir) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op5_minhash_near_copies(spark, sf_dir) -> DataFrame:
    return near_copies.linked(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_containment(spark, sf_dir) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_token_counts(spark, sf_dir) -> DataFrame:
    vocabulary = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.counted(table(spark, sf_dir, "documents"), vocabulary)


@query
def op8_packing(spark, sf_dir) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *bpe_files())


@query
def op9_suffix_repeats(spark, sf_dir) -> DataFrame:
    return repeats.summaries(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_secret_spans(spark, sf_dir) -> DataFrame:
    return secret_spans.scanned(table(spark, sf_dir, "documents"))


@query
def op12_variant_groups(spark, sf_dir) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark, sf_dir) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
