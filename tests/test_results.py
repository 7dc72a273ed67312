import json

import pytest

from tabletrail.operators import bm25, graph, replies, report, rerank, vectors
from tabletrail.operators.chunks import split_scripts
from tabletrail.operators.refs import add_refs, ref_rows
from tabletrail.operators.documents import build_documents
from tabletrail.operators.registry import build_registry
from tabletrail.sources import snapshots

HITS = (
    "query string, rank int, chunk_id string, hybrid_score double, matched_canonical string, matched_aliases array<string>, file_path string,"
    " file_type string, line_start int, line_end int, aliases_used array<string>, operations array<string>, raw_text string"
)


def hits_of(spark, n=25):
    rows = [
        ("customer", i + 1, f"c{i}", round(0.9 - i / 100, 4), "customer", ["cust", "customer"], f"/etl/{'a' if i % 2 else 'b'}/job_{i % 3}.sql",
         "sql", 10 * i + 1, 10 * i + 5, ["cust"] if i == 4 else [], ["WRITE", "READ"] if i % 2 else ["READ"] if i else [], f" SELECT {i}\n")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, HITS)


def test_replies(spark):
    texts = {
        "plain": '[{"raw": "cust_tab", "canonical": "customer", "type": "READ", "confidence": "high"}, {"canonical": "x"}, {"raw": "o"}]',
        "fenced": '```json\n[{"raw": "a", "canonical": null, "type": "COLUMN"}]\n```',
        "broken": "not json", "object": '{"raw": "a"}', "extra": '[{"raw": "a"}] and more', "none": None, "empty": "[]", "twice": "[] []",
    }
    rows = replies.parse_references(spark.createDataFrame(list(texts.items()), "chunk_id string, reply string")).collect()
    assert sorted((r["chunk_id"], r["ord"], r["raw"], r["canonical"], r["ref_type"], r["confidence"]) for r in rows) == [
        ("fenced", 0, "a", None, "COLUMN", "low"), ("plain", 0, "cust_tab", "customer", "READ", "high"), ("plain", 2, "o", None, "UNKNOWN", "low"),
    ]


def test_model_calls_fail_alone(spark):
    files = [("a.sql", "SELECT * FROM cust_tab"), ("b.sql", "SELECT * FROM fails_here"), ("c.sql", "SELECT 1")]
    chunks = add_refs(split_scripts(spark.createDataFrame(files, "file_path string, source string")))

    def answer(prompt):
        if "fails_here" in prompt:
            raise RuntimeError("no service")
        return json.dumps([{"raw": "cust_tab", "canonical": "customer", "type": "READ", "confidence": "high"}])

    calls = replies.call_model(replies.extraction_inputs(chunks), answer, workers=2).collect()
    assert len(calls) == 2 and [c["error"] for c in calls if c["reply"] is None] == ["RuntimeError: no service"]
    table = spark.createDataFrame(calls, replies.REPLY_SCHEMA)
    assert {(r["raw"], r["canonical"]) for r in replies.refs_with_fallback(table, chunks).collect()} == {("cust_tab", "customer"), ("fails_here", "fails_here")}


def test_judged(spark):
    reply = json.dumps([{"chunk_id": f"c{i}", "relevance_score": 1.0 if i < 2 else "bad" if i == 2 else 0.3, "operation": "READ"} for i in range(20)] + [{"chunk_id": "c1", "relevance_score": 0.5, "matched_via": "alias"}, {"x": 1}])
    judgements = replies.parse_judgements(spark.createDataFrame([("customer", f"```json\n{reply}\n```")], "query string, reply string"))
    rows = rerank.rank_results(hits_of(spark), judgements, limit=15).orderBy("place").collect()
    assert len(rows) == 14 and rows[0]["chunk_id"] == "c0" and rows[0]["final_score"] == pytest.approx(0.96)
    second = next(r for r in rows if r["chunk_id"] == "c1")
    assert (second["operation"], second["matched_via"], second["final_score"]) == ("UNKNOWN", "alias", pytest.approx(0.656))
    none = replies.parse_judgements(spark.createDataFrame([("customer", "sorry")], "query string, reply string"))
    assert rerank.judged(hits_of(spark), none).count() == 0
    items = json.loads(replies.judgement_inputs(hits_of(spark), limit=15).first()["snippets"])
    assert len(items) == 15 and items[0] == {"chunk_id": "c0", "file": "/etl/b/job_0.sql", "lines": "1-5", "type": "sql", "code_excerpt": "SELECT 0"}


def test_report_and_graph(spark):
    results = rerank.rank_results(hits_of(spark, 6))
    first = {r["chunk_id"]: (r["operation"], r["matched_via"]) for r in results.collect()}
    assert first["c0"] == ("UNKNOWN", "direct") and first["c1"] == ("WRITE", "direct") and first["c4"] == ("READ", "alias")
    rows = {r["full_path"]: r for r in report.summary(report.group_by_file(results)).collect()}
    assert len(rows) == 6 and rows["/etl/b/job_1.sql"]["aliases_used"] == "cust" and rows["/etl/b/job_0.sql"]["aliases_used"] == "—"
    assert report.banner(results).first()["script_count"] == 6 and report.banner(results).first()["other_names"] == ["cust"]
    nodes = {r["id"]: r["full_path"] for r in graph.nodes(results).collect()}
    assert nodes == {"table:customer": None, "file:job_0.sql": "/etl/b/job_0.sql", "file:job_1.sql": "/etl/a/job_1.sql", "file:job_2.sql": "/etl/b/job_2.sql"}
    edges = graph.edges(results)
    assert {(r["src"], r["dst"], r["operation"], r["lines"]) for r in edges.collect()} == {
        ("table:customer", "file:job_0.sql", "UNKNOWN", "1-5"), ("file:job_1.sql", "table:customer", "WRITE", "11-15"), ("table:customer", "file:job_2.sql", "READ", "21-25"),
        ("file:job_0.sql", "table:customer", "WRITE", "31-35"), ("table:customer", "file:job_1.sql", "READ", "41-45"), ("file:job_2.sql", "table:customer", "WRITE", "51-55"),
    }
    entries = {(r["operation"], r["entry"]) for r in graph.table_summary(edges).collect()}
    assert ("READ", "job_0.sql (lines 1-5)") in entries and ("WRITE", "job_2.sql (lines 51-55)") in entries and len(entries) == 6
    assert tuple(graph.size(graph.nodes(results), edges).first()) == (4, 6)
    assert graph.nodes(results, by_path=True).count() == 7


def test_unfinished_snapshot_stays_unseen(spark, tmp_path):
    root = str(tmp_path / "index")
    chunks = add_refs(split_scripts(spark.createDataFrame([("a.sql", "SELECT * FROM old_one")], "file_path string, source string")))
    first = snapshots.begin(spark, root)
    first.write_documents(build_documents(chunks))
    with pytest.raises(ValueError):
        first.commit()
    assert not snapshots.has_index(spark, root)
    first = snapshots.begin(spark, root)
    first.write_documents(build_documents(chunks))
    first.write_registry(build_registry(ref_rows(chunks)))
    first.write_postings(bm25.postings_of(build_documents(chunks)))
    first.write_blocks(bm25.build_index(build_documents(chunks)).blocks)
    with pytest.raises(ValueError, match="vectors"):
        first.commit()
    first.write_vectors(vectors.text_counts(build_documents(chunks).select("chunk_id", "canonical_tables", "embedding_text")))
    first.commit()
    dead = snapshots.begin(spark, root)
    dead.write_documents(build_documents(chunks).limit(0))
    assert snapshots.read_documents(spark, root).count() == 1
    assert snapshots.begin(spark, root).number > dead.number and (tmp_path / "index" / "segments" / dead.path.rsplit("/", 1)[1]).exists()
    again = snapshots.begin(spark, root, stale_hours=0)
    assert again.number > dead.number and not (tmp_path / "index" / "segments" / dead.path.rsplit("/", 1)[1]).exists()
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int")
    assert sorted(map(tuple, snapshots.upsert(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
