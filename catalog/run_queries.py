"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.corpus import ALIAS_RULES
from tabletrail.functions import text as T
from tabletrail.operators import bm25, chunks as C, documents as D, graph, long_scripts, refs as R, registry as G, replies, report, rerank, search
from tabletrail.operators import python_blocks as P
from tabletrail.operators import vectors as V
from tabletrail.sources import scripts as S
from tabletrail.sources import snapshots
from tabletrail.sources.scratch import shared_folder, written
from tabletrail.sources.snapshots import upsert

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- Sources -----------------------------------------------------------------


@query
def exclude_dirs(spark, sf) -> DataFrame:
    kept = ~S.is_excluded(F.col("file_path"), "/repo", ["archive", "team3"])
    return I.scripts(spark, sf).where(kept).select("file_path", S.relative_path(F.col("file_path"), "/repo").alias("rel_path"))


@query
def ext_dispatch(spark, sf) -> DataFrame:
    return S.with_file_type(I.scripts(spark, sf)).select("file_path", "file_type")


@query
def folder_lists(spark, sf) -> DataFrame:
    typed = F.concat(
        F.lit(" archive , "), "source", F.lit("\n\n, tmp"), F.col("doc_id").cast("string"), F.lit(",, \n")
    )
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", T.folder_list(typed).alias("folders")).select(
        "doc_id", F.array_join("folders", "|").alias("folders"), F.size("folders").cast("bigint").alias("n")
    )


# --- Segmentation ------------------------------------------------------------


def _chunk_rows(spark, sf, kind: str) -> DataFrame:
    return I.chunks(spark, sf).where(F.col("file_type") == kind).select(
        "chunk_id", "chunk_type", "raw_text", F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"),
    )


@query
def sql_statements(spark, sf) -> DataFrame:
    return _chunk_rows(spark, sf, "sql")


@query
def python_blocks(spark, sf) -> DataFrame:
    return _chunk_rows(spark, sf, "python")


@query
def shell_groups(spark, sf) -> DataFrame:
    return _chunk_rows(spark, sf, "shell")


def open_quote(text: Column) -> Column:
    """What to append so that a quote stays open: nothing if the text leaves one open itself."""
    rest = F.regexp_replace(text, r"""\$\$[\s\S]*?\$\$|"[^"]*"|'[^']*'|`[^`]*`""", "")
    return F.when(rest.rlike("[\"'`]"), "").otherwise("'")


@query
def semicolon_split(spark, sf) -> DataFrame:
    """Documents as SQL files with a quote left open: all of them are cut at semicolons."""
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("file_path"),
        F.concat("text", F.lit(" ; ;\n\nend"), open_quote(F.col("text"))).alias("source"),
    )
    return C.split_scripts(docs).select(
        "file_path", "chunk_type", "raw_text", F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"),
    )


@query
def line_blocks(spark, sf) -> DataFrame:
    """Documents as Python files with a bracket left open: all become blocks of 30 lines."""
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat("text", F.lit("\n(")).alias("source"),
    )
    return C.split_scripts(docs).select(
        "file_path", "chunk_type", "raw_text", F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"),
    )


@query
def python_faults(spark, sf) -> DataFrame:
    """What keeps each file from being a Python program."""
    return P.python_faults(I.faulty_scripts(spark, sf)).select("file_path", F.coalesce("fault", F.lit("")).alias("fault"))


@query
def faulty_blocks(spark, sf) -> DataFrame:
    """Chunks of the same files: blocks of 30 lines where a fault is found, statements elsewhere."""
    return C.split_scripts(I.faulty_scripts(spark, sf)).select(
        "file_path", "chunk_type", "raw_text", F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"),
    )


@query
def long_sql(spark, sf) -> DataFrame:
    """Statements of long files that come in segments."""
    return long_scripts.split_segments(I.dump_segments(spark, sf)).select(
        "file_path", "chunk_type", "raw_text", F.col("line_start").cast("bigint").alias("line_start"),
        F.col("line_end").cast("bigint").alias("line_end"),
    )


@query
def chunk_captions(spark, sf) -> DataFrame:
    return I.chunks(spark, sf).select("chunk_id", C.caption().alias("caption"))


@query
def tiny_chunks(spark, sf) -> DataFrame:
    return I.chunks(spark, sf).where(~C.is_extractable()).select("chunk_id", "raw_text")


@query
def chunk_type_counts(spark, sf) -> DataFrame:
    return I.chunks(spark, sf).groupBy("file_type", "chunk_type").agg(F.count("*").alias("n"))


# --- References --------------------------------------------------------------


def _refs(spark, sf, kind: str) -> DataFrame:
    rows = I.chunks_with_refs(spark, sf).where(F.col("file_type") == kind)
    return R.ref_rows(rows).select("chunk_id", F.col("ord").cast("bigint").alias("ord"), "raw", "ref_type", "confidence")


@query
def refs_sql(spark, sf) -> DataFrame:
    return _refs(spark, sf, "sql")


@query
def refs_python(spark, sf) -> DataFrame:
    return _refs(spark, sf, "python")


@query
def refs_shell(spark, sf) -> DataFrame:
    return _refs(spark, sf, "shell")


@query
def refs_shell_writes(spark, sf) -> DataFrame:
    shell = I.chunks(spark, sf).where("file_type = 'shell'")
    return R.ref_rows(R.add_refs(shell, shell_writes=True)).select("chunk_id", "raw", "ref_type")


@query
def refs_python_no_imports(spark, sf) -> DataFrame:
    python = I.chunks(spark, sf).where("file_type = 'python'")
    return R.ref_rows(R.add_refs(python, skip_imports=True)).select("chunk_id", "raw", "ref_type")


def _family(spark, sf, patterns) -> DataFrame:
    rows = I.chunks(spark, sf).where((F.col("file_type") == "sql") & C.is_extractable())
    names = R.table_names(F.col("raw_text"), patterns)
    return rows.select("chunk_id", F.posexplode_outer(names).alias("ord", "name")).where("name IS NOT NULL").select(
        "chunk_id", F.col("ord").cast("bigint").alias("ord"), "name"
    )


@query
def refs_sql_read(spark, sf) -> DataFrame:
    return _family(spark, sf, R.SQL_READ)


@query
def refs_sql_write(spark, sf) -> DataFrame:
    return _family(spark, sf, R.SQL_WRITE)


@query
def refs_sql_create(spark, sf) -> DataFrame:
    return _family(spark, sf, R.SQL_CREATE)


@query
def refs_sql_drop(spark, sf) -> DataFrame:
    return _family(spark, sf, R.SQL_DROP)


@query
def refs_copy_into(spark, sf) -> DataFrame:
    return _family(spark, sf, R.SQL_COPY)


@query
def prose_refs(spark, sf) -> DataFrame:
    """The SQL patterns over prose: keywords inside text of four languages."""
    docs = I.spread(I.table(spark, sf, "documents"))
    text = F.concat("text", F.lit(" from "), "lang", F.lit(' join "X".['), "source", F.lit("]"))
    return docs.select("doc_id", F.posexplode(R.table_names(text, R.SQL_READ)).alias("ord", "name")).select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "name"
    )


@query
def ident_clean(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    raw = F.concat(F.lit(" `"), "lang", F.lit('`."'), "source", F.lit("'.["), F.upper(F.col("doc_id").cast("string")), F.lit("_T] \n"))
    return docs.select("doc_id", R.clean_name(raw).alias("name"))


@query
def alias_rules(spark, sf) -> DataFrame:
    rows = R.ref_rows(I.aliased(spark, sf))
    return rows.groupBy("raw", "canonical", "ref_type").agg(F.count("*").alias("n"))


@query
def alias_rules_by_table(spark, sf) -> DataFrame:
    rules = spark.createDataFrame(ALIAS_RULES, "alias string, canonical string")
    rows = R.name_aliases_by_table(R.ref_rows(I.chunks_with_refs(spark, sf)), rules)
    return rows.groupBy("raw", "canonical", "ref_type").agg(F.count("*").alias("n"))


# --- Model replies -----------------------------------------------------------


@query
def prompt_inputs(spark, sf) -> DataFrame:
    return replies.extraction_inputs(I.chunks(spark, sf)).select("chunk_id", F.md5("prompt").alias("prompt_md5"))


def _replies(spark, sf) -> DataFrame:
    rows = I.chunks_with_refs(spark, sf)
    full = F.to_json(
        F.transform(
            "refs",
            lambda r: F.struct(
                r["raw"].alias("raw"),
                F.when(r["ref_type"] != "DROP", F.concat(F.lit("c_"), r["raw"])).alias("canonical"),
                r["ref_type"].alias("type"),
                F.lit("high").alias("confidence"),
            ),
        )
    )
    bare = F.to_json(F.transform("refs", lambda r: F.struct(r["raw"].alias("raw"))))
    kind = F.pmod(F.length("raw_text"), F.lit(6))
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(full, F.lit("]")))
        .when(kind == 3, F.lit('{"raw": "x", "canonical": "y"}'))
        .when(kind == 4, bare)
        .otherwise("no tables here")
    )
    return rows.select("chunk_id", reply.alias("reply"))


@query
def reply_parse(spark, sf) -> DataFrame:
    return replies.parse_references(_replies(spark, sf)).withColumn("ord", F.col("ord").cast("bigint"))


@query
def reply_documents(spark, sf) -> DataFrame:
    parsed = replies.parse_references(_replies(spark, sf))
    docs = D.add_lists(D.attach_refs(I.chunks(spark, sf), parsed))
    return docs.select("chunk_id", *[F.array_join(c, "|").alias(c) for c in D.LISTS])


# --- Registry ----------------------------------------------------------------


@query
def alias_registry(spark, sf) -> DataFrame:
    return I.registry(spark, sf).names


@query
def alias_current(spark, sf) -> DataFrame:
    """Names under rules that differ by folder, so that the last file decides."""
    rows = R.ref_rows(I.aliased(spark, sf))
    moved = F.when(F.col("file_path").contains("/core/"), F.concat(F.col("canonical"), F.lit("_core"))).otherwise(F.col("canonical"))
    return G.build_registry(rows.withColumn("canonical", moved)).current.select("alias", "canonical")


@query
def alias_resolve(spark, sf) -> DataFrame:
    return G.resolve(I.asked(spark, sf), I.registry(spark, sf))


@query
def alias_expand(spark, sf) -> DataFrame:
    return G.aliases_of(I.asked(spark, sf), I.registry(spark, sf))


@query
def files_for_table(spark, sf) -> DataFrame:
    return G.files_of(I.asked(spark, sf), I.registry(spark, sf))


@query
def all_tables(spark, sf) -> DataFrame:
    return G.all_tables(I.registry(spark, sf))


@query
def registry_merge(spark, sf) -> DataFrame:
    """Registry without rules stored first, the one with rules merged in."""
    stored = G.build_registry(R.ref_rows(I.chunks_with_refs(spark, sf)), run=1)
    new = G.build_registry(R.ref_rows(I.aliased(spark, sf)), run=2)
    merged = G.merge_registries(stored, new)
    names = merged.names.groupBy("canonical").agg(F.count("*").alias("name_count"))
    return merged.current.select("alias", "canonical").join(names, "canonical")


@query
def registry_report(spark, sf) -> DataFrame:
    return G.report(I.registry(spark, sf)).select(
        "canonical", F.array_join("other_names", ", ").alias("other_names"), "file_count"
    )


@query
def known_tables(spark, sf) -> DataFrame:
    return G.known_tables(I.registry(spark, sf)).select("canonical", F.array_join("other_names", ", ").alias("other_names"))


# --- Documents ---------------------------------------------------------------


@query
def doc_entities(spark, sf) -> DataFrame:
    return I.documents(spark, sf).select("chunk_id", *[F.array_join(c, "|").alias(c) for c in D.LISTS])


@query
def doc_text(spark, sf) -> DataFrame:
    return I.documents(spark, sf).select("chunk_id", "embedding_text")


@query
def meta_codec(spark, sf) -> DataFrame:
    """Lists written as JSON and read back, and the two older forms."""
    docs = I.table(spark, sf, "documents")
    words = F.array(F.col("lang"), F.concat("source", F.lit("|x")), F.col("text"))
    stored = (
        F.when(F.col("doc_id") % 4 == 0, T.encode_list(words))
        .when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit(" | "), "source", F.lit("||z ")))
        .when(F.col("doc_id") % 4 == 2, F.col("doc_id").cast("string"))
        .otherwise("")
    )
    back = docs.select("doc_id", T.decode_list(stored).alias("v"))
    return back.select("doc_id", F.array_join("v", "~").alias("joined"), F.size("v").cast("bigint").alias("n"))


@query
def code_recovery(spark, sf) -> DataFrame:
    return I.documents(spark, sf).select("chunk_id", T.code_of(F.col("embedding_text")).alias("code"))


@query
def upsert_by_key(spark, sf) -> DataFrame:
    """Stored documents of all scripts, then a run in which scripts below core/ changed and one is new."""
    stored = I.chunks(spark, sf).select("chunk_id", "chunk_type")
    changed = stored.where("chunk_id LIKE '/repo/core/%'").select("chunk_id", F.concat(F.lit("new "), "chunk_type").alias("chunk_type"))
    added = stored.agg(F.concat(F.lit("/repo/new#"), F.count("*").cast("string")).alias("chunk_id"), F.lit("new").alias("chunk_type"))
    return upsert(stored, changed.unionByName(added))


# --- Search ------------------------------------------------------------------


@query
def query_clean(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", T.clean_query(F.concat(F.lit(" ;"), "text")).alias("cleaned"))


@query
def token_counts(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("n"))


@query
def bm25_postings(spark, sf) -> DataFrame:
    rows = bm25.postings_of(I.spread(I.table(spark, sf, "documents")), "text", "doc_id")
    return rows.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


@query
def bm25_terms(spark, sf) -> DataFrame:
    built = bm25.build_index(I.spread(I.table(spark, sf, "documents")), "text", "doc_id")
    return built.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _item_words(spark, sf) -> DataFrame:
    return bm25.query_words(I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("term")))


def _document_scores(spark, sf) -> DataFrame:
    """Each benchmark item's text as a query against all documents."""
    return bm25.scores(I.prose_index(spark, sf), _item_words(spark, sf), "doc_id")


@query
def bm25_scores(spark, sf) -> DataFrame:
    return _document_scores(spark, sf).select("query", "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_normalised(spark, sf) -> DataFrame:
    best = bm25.normalised(_document_scores(spark, sf), "doc_id")
    return best.select("query", "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, sf) -> DataFrame:
    """Without scoring the postings that cannot lead to one of the ten."""
    top = bm25.top_scores(I.prose_index(spark, sf), _item_words(spark, sf), 10, "doc_id")
    return top.select("query", "doc_id", F.round(F.round("score", 8), 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _label_queries(spark, sf) -> DataFrame:
    """One query vector per label: the first vector that bears it."""
    rows = I.table(spark, sf, "embeddings")
    return rows.groupBy(F.col("label").cast("string").alias("query")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


def _near(found: DataFrame) -> DataFrame:
    return found.select("query", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def vector_topk(spark, sf) -> DataFrame:
    return _near(V.nearest(I.table(spark, sf, "embeddings"), _label_queries(spark, sf), 20, key="vec_id"))


@query
def vector_topk_cells(spark, sf) -> DataFrame:
    """The same, exact, from vectors laid out by cells; cells that cannot hold a nearer one are not read."""
    cells = V.build_cells(I.table(spark, sf, "embeddings"), "vec_id")
    return _near(V.nearest_in_cells(cells, _label_queries(spark, sf), 20, "vec_id"))


@query
def vector_topk_label_filter(spark, sf) -> DataFrame:
    """The filter comes before ranking, so 20 of the wanted rows are found."""
    wanted = I.table(spark, sf, "embeddings").where("label % 2 = 1")
    return _near(V.nearest(wanted, _label_queries(spark, sf), 20, key="vec_id"))


@query
def table_filter(spark, sf) -> DataFrame:
    found = I.table_hits(spark, sf)
    return found.select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def table_filter_buckets(spark, sf) -> DataFrame:
    """The same from vectors laid out by table name, of which only the asked names' folders are read."""
    laid_out = written(V.by_table(I.chunk_vectors(spark, sf)), "by_table", by="bucket")
    found = V.with_table_in_buckets(laid_out, I.table_queries(spark, sf), 2 * I.TOP_K)
    return found.select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def semantic_chunks(spark, sf) -> DataFrame:
    found = I.semantic_hits(spark, sf)
    return found.select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def query_words(spark, sf) -> DataFrame:
    return search.search_words(I.expanded(spark, sf))


@query
def bm25_chunks(spark, sf) -> DataFrame:
    return I.word_hits(spark, sf).select("query", "chunk_id", F.round("score", 6).alias("score"))


@query
def hybrid_topk(spark, sf) -> DataFrame:
    return I.ranked(spark, sf).select("query", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "hybrid_score")


@query
def hybrid_hits(spark, sf) -> DataFrame:
    return I.hits(spark, sf).select(
        "query", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "file_path", "matched_canonical",
        F.array_join("matched_aliases", ",").alias("matched_aliases"),
    )


@query
def text_vector_topk(spark, sf) -> DataFrame:
    """Documents nearest to each benchmark item by hashed TF-IDF."""
    docs = I.spread(I.table(spark, sf, "documents").select("doc_id", "text"))
    model = V.fit_text_vectors(docs, "text")
    items = V.text_vectors(model, I.table(spark, sf, "benchmark"), "text")
    found = V.nearest(V.text_vectors(model, docs, "text"), items.select(F.col("item_id").alias("query"), "embedding"), 10, key="doc_id")
    return found.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# --- Stored snapshots: written to the shared folder and read back ---


@lru_cache(maxsize=2)
def _published(spark, sf) -> str:
    """A root with three complete versions and a run that died: all scripts but the archived ones; those of core/ again, changed, with the
    archived ones; those of team3/ again, changed."""
    root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    docs = I.documents(spark, sf)

    def changed(folder: str, word: str) -> DataFrame:
        text = F.concat(F.lit(word + " "), "embedding_text")
        return docs.where(F.col("file_path").startswith(f"/repo/{folder}/")).withColumns({"chunk_type": F.lit(word), "embedding_text": text})

    archived = F.col("file_path").startswith("/repo/archive/")
    registry = I.registry(spark, sf)
    for run, rows in enumerate((docs.where(~archived), changed("core", "rewritten").union(docs.where(archived)), changed("team3", "moved")), 1):
        staging = snapshots.begin(spark, root, buckets=8)
        staging.write_documents(rows)
        stored = spark.read.parquet(f"{staging.path}/documents")
        staging.write_postings(bm25.postings_of(stored))
        staging.write_blocks(bm25.blocks_of(spark.read.parquet(f"{staging.path}/postings"), 8))
        staging.write_vectors(V.text_counts(stored.select("chunk_id", "canonical_tables", "embedding_text"), features=64, keep_text=False))
        staging.write_registry(registry if run == 1 else snapshots.empty_registry(spark))
        staging.commit(add=run > 1, features=64)
    snapshots.begin(spark, root).write_documents(docs.limit(1))
    return root


@query
def published_documents(spark, sf) -> DataFrame:
    """What a reader of the newest complete version sees, and how many chunks it is told there are."""
    root = _published(spark, sf)
    docs = snapshots.read_documents(spark, root)
    md5 = F.conv(F.substring(F.md5(F.col("embedding_text").cast("binary")), 1, 8), 16, 10).cast("bigint")
    kinds = docs.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(md5).alias("text_md5"))
    return kinds.withColumn("total", F.lit(snapshots.document_count(spark, root)).cast("bigint"))


@query
def published_terms(spark, sf) -> DataFrame:
    """The terms' statistics summed over the segments, without what was replaced."""
    index = snapshots.read_index(spark, _published(spark, sf))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def published_scores(spark, sf) -> DataFrame:
    """Scores over three segments, the same as over one index of all."""
    index = snapshots.read_index(spark, _published(spark, sf))
    scored = bm25.scores(index, search.search_words(I.expanded(spark, sf)))
    return scored.select("query", "chunk_id", F.round("score", 6).alias("score"))


@query
def published_topk(spark, sf) -> DataFrame:
    """The ten best of each query over three segments, without scoring what cannot be one of them."""
    index = snapshots.read_index(spark, _published(spark, sf))
    top = bm25.top_scores(index, search.search_words(I.expanded(spark, sf)), 10)
    return top.select("query", "chunk_id", F.round(F.round("score", 8), 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def saved_registry(spark, sf) -> DataFrame:
    """The registry exported as lines and read again: which table each name stands for, and how many files use that."""
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    snapshots.export_registry(I.registry(spark, sf), root)
    loaded = snapshots.import_lines(spark, root)
    used = loaded.files.groupBy("canonical").agg(F.count("*").alias("file_count"))
    known = loaded.names.join(loaded.current, ["alias", "canonical"], "left_semi")
    return known.join(used, "canonical").select("alias", "canonical", "file_count")


@query
def exported_report(spark, sf) -> DataFrame:
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.write_csv(report.summary(report.group_by_file(I.listing_results(spark, sf))), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("query", "script", "operations", "matched_via", "aliases_used", F.col("relevance_score").cast("double").alias("relevance_score"), "full_path")


@query
def exported_graph(spark, sf) -> DataFrame:
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    results = I.listing_results(spark, sf)
    graph.export(graph.nodes(results), graph.edges(results), path)
    return spark.read.schema("`from` string, `to` string, label string, lines string, title string").json(f"{path}/edges").select(
        F.col("from").alias("src"), F.col("to").alias("dst"), F.col("label").alias("operation"), "title"
    )


@query
def model_references(spark, sf) -> DataFrame:
    """A user's function answers each prompt with its first line; prompts of COPY scripts fail and fall back to the patterns."""

    def answer(prompt: str) -> str:
        if "COPY" in prompt:
            raise RuntimeError("no answer")
        return json.dumps([{"raw": prompt.split("\n")[0], "canonical": "file", "type": "READ", "confidence": "high"}])

    # Read for the prompts and again for the failed calls; scripts are cut once.
    found = written(I.chunks_with_refs(spark, sf), "found")
    calls = replies.call_model(replies.extraction_inputs(found), answer)
    return replies.refs_with_fallback(calls, found).groupBy("raw", "canonical", "ref_type", "confidence").agg(F.count("*").alias("n"))


@query
def result_modes(spark, sf) -> DataFrame:
    """The same hits with judgements and without, and which of the two a result came from."""
    hits = I.first_hits(spark, sf)
    judged = rerank.rank_results(hits, replies.parse_judgements(_judge_replies(spark, sf)), min_score=0.25, limit=15)
    columns = ["query", "judged", "operation", "matched_via"]
    both = judged.select(*columns).unionByName(rerank.rank_results(hits).select(*columns))
    return both.groupBy(*columns).agg(F.count("*").alias("n"))


# --- Reranking and reports ---------------------------------------------------


@query
def snippets(spark, sf) -> DataFrame:
    rows = replies.judgement_inputs(I.first_hits(spark, sf), limit=15)
    items = F.from_json("snippets", "array<struct<chunk_id:string,file:string,lines:string,type:string,code_excerpt:string>>")
    return rows.select("query", F.posexplode(items)).select("query", F.col("pos").cast("bigint").alias("pos"), "col.*")


def _judge_replies(spark, sf) -> DataFrame:
    """A reply per query for three of four hits, one chunk judged twice, some fields left out."""
    score = F.pmod(F.col("rank") * 7, F.lit(10)) / 10
    item = F.struct(
        "rank",
        F.to_json(
            F.struct(
                "chunk_id",
                score.alias("relevance_score"),
                F.when(F.col("rank") % 3 > 0, F.col("operation")).alias("operation"),
                F.when(F.col("rank") % 2 > 0, F.concat(F.lit("why "), F.col("file_path"))).alias("explanation"),
                F.when(F.col("rank") % 5 > 0, F.lit("alias")).alias("matched_via"),
            )
        ).alias("json"),
    )
    rows = rerank.unjudged(I.first_hits(spark, sf)).where("rank <= 15 AND rank % 4 <> 0")
    lists = rows.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("all"))
    first = F.concat(F.lit('{"chunk_id": "'), F.get_json_object(F.element_at("all", 1)["json"], "$.chunk_id"), F.lit('", "relevance_score": 1.0}'))
    body = F.array_join(F.concat(F.array(first), F.transform("all", lambda x: x["json"])), ",")
    return lists.select("query", F.concat(F.lit("```json\n["), body, F.lit("]\n```")).alias("reply"))


@query
def judgement_parse(spark, sf) -> DataFrame:
    return replies.parse_judgements(_judge_replies(spark, sf))


@query
def rerank_scores(spark, sf) -> DataFrame:
    return rerank.judged(I.first_hits(spark, sf), replies.parse_judgements(_judge_replies(spark, sf)), min_score=0.25, limit=15).select(
        "query", "chunk_id", "llm_score", "operation", "explanation", "matched_via", "final_score",
        F.col("place").cast("bigint").alias("place"),
    )


@query
def rerank_missing(spark, sf) -> DataFrame:
    """Hits without judgements score 0: at cut 0 they stay."""
    kept = rerank.judged(I.first_hits(spark, sf), replies.parse_judgements(_judge_replies(spark, sf)), min_score=0.0, limit=15)
    return kept.where("llm_score = 0").select("query", "chunk_id", "operation", "matched_via", "final_score")


@query
def fallback_rank(spark, sf) -> DataFrame:
    return I.listing_results(spark, sf).select("query", "chunk_id", "operation", "matched_via", "final_score")


@query
def fallback_rank_per_table(spark, sf) -> DataFrame:
    hits = I.listing_results(spark, sf).drop("llm_score", "operation", "explanation", "matched_via", "final_score")
    return rerank.unjudged(hits, per_table=True).select("query", "chunk_id", "operation", "matched_via")


@query
def file_report(spark, sf) -> DataFrame:
    return report.summary(report.group_by_file(I.listing_results(spark, sf)))


@query
def file_chunks(spark, sf) -> DataFrame:
    groups = report.group_by_file(I.listing_results(spark, sf))
    return groups.select("query", "file_path", F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), "|").alias("chunk_ids"))


@query
def script_count(spark, sf) -> DataFrame:
    return report.banner(I.listing_results(spark, sf)).select(
        "query", "matched_canonical", F.array_join("other_names", ",").alias("other_names"), "script_count"
    )


@query
def chunk_detail(spark, sf) -> DataFrame:
    return report.details(I.listing_results(spark, sf))


@query
def graph_nodes(spark, sf) -> DataFrame:
    return graph.nodes(I.listing_results(spark, sf))


@query
def graph_edges(spark, sf) -> DataFrame:
    return graph.edges(I.listing_results(spark, sf))


@query
def graph_edges_by_path(spark, sf) -> DataFrame:
    return graph.edges(I.listing_results(spark, sf), by_path=True)


@query
def graph_size(spark, sf) -> DataFrame:
    results = I.listing_results(spark, sf)
    return graph.size(graph.nodes(results), graph.edges(results))


@query
def lineage_summary(spark, sf) -> DataFrame:
    return graph.table_summary(graph.edges(I.listing_results(spark, sf)))
