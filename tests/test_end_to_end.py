import pytest
from pyspark.sql import functions as F

from tabletrail.operators import graph, report
from tabletrail.plans.ingest import ingest
from tabletrail.plans.lookup import find, open_index, query_rows, trace
from tabletrail.sources import scratch, snapshots

RULES = [("rd_old", "reading"), ("rd_raw", "reading"), ("gauge_tbl", "gauge"), ("stn_tab", "station")]


def ends(rows):
    return {r["file_path"].rsplit("/", 1)[1] for r in rows}


def test_from_files_to_report(spark, script_folder, tmp_path):
    root = str(tmp_path / "index")
    assert not snapshots.has_index(spark, root)
    first = ingest(spark, str(script_folder), root, excluded=["retired"], rules=RULES)
    assert first and snapshots.has_index(spark, root)
    index = open_index(spark, root)
    assert index.documents.count() == snapshots.document_count(spark, root) > 5
    queries = query_rows(spark, ["RD_old", "gauge?", "station", "no_such_table_77"])

    hits = find(index, queries, top_k=10).cache()
    of = {q: hits.where(F.col("query") == q).orderBy("rank").collect() for q in ("RD_old", "gauge", "station")}
    assert {r["matched_canonical"] for r in of["RD_old"]} == {"reading"} and ends(of["RD_old"][:4]) >= {"hourly.sql", "nightly.sh"}
    assert ends(of["gauge"][:1]) == {"gauges.py"} and "gauge_tbl" in of["gauge"][0]["matched_aliases"]
    assert ends(of["station"][:2]) == {"stations.sql", "gauges.py"}
    assert not [r for r in hits.where("query LIKE 'no_such%'").collect() if r["hybrid_score"] > 0.8]
    assert "levels.py" not in ends(hits.collect())

    results = trace(index, queries).cache()
    assert not results.where("judged").count()
    own = trace(index, queries, per_table=True).where("query = 'gauge' AND file_path LIKE '%gauges.py'").first()
    assert own["operation"] == "READ" and own["matched_via"] == "alias"
    with pytest.raises(TypeError):
        trace(index, queries, nonsense=1)
    groups = report.group_by_file(results)
    rows = {r["script"]: r for r in report.summary(groups).where("query = 'station'").collect()}
    assert rows["stations.sql"]["aliases_used"] == "stn_tab" and rows["stations.sql"]["operations"] == "WRITE"
    report.write_csv(report.summary(groups), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == groups.count()
    nodes, edges = graph.nodes(results), graph.edges(results)
    assert nodes.where("id = 'table:station'").count() == 1
    graph.export(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph" / "edges")).count() == edges.count()

    (script_folder / "extra.sql").write_text("SELECT * FROM rd_raw JOIN basin ON 1 = 1;")
    (script_folder / "stations.sql").unlink()
    second = ingest(spark, str(script_folder), root, excluded=["retired"], rules=RULES)
    assert second != first and snapshots.current_path(spark, root) == second
    names = {tuple(r) for r in snapshots.read_registry(spark, root).names.collect()}
    assert {("reading", "rd_raw"), ("station", "stn_tab")} <= names
    assert snapshots.read_documents(spark, root).where("file_path LIKE '%stations.sql'").count() == 0


def test_ingest_from_a_table_with_many_rules(spark, tmp_path):
    """1,201 rules, options of the patterns, bucket count, and an upsert into the stored snapshot."""
    root = str(tmp_path / "index")
    files = spark.createDataFrame(
        [("/t/a.sh", 'psql -c "COPY name_7 (a) FROM s3"'), ("/t/b.py", "from lib.flow import x\ny = 'SELECT * FROM name_1200'\n")],
        "file_path string, source string",
    )
    rules = spark.createDataFrame([(f"name_{i}", f"table_{i}") for i in range(1201)], "alias string, canonical string")
    ingest(spark, files, root, rules=rules, shell_writes=True, skip_imports=True, buckets=3)
    docs = {r["file_path"]: r for r in snapshots.read_documents(spark, root).collect()}
    assert "table_7" in docs["/t/a.sh"]["canonical_tables"] and "WRITE" in docs["/t/a.sh"]["operations"]
    assert docs["/t/b.py"]["canonical_tables"] == ["table_1200"]
    index = open_index(spark, root)
    assert index.documents.select("bucket").where("bucket > 2").count() == 0
    assert [r["file_path"] for r in find(index, query_rows(spark, ["name_7"]), top_k=1).collect()] == ["/t/a.sh"]
    changed = spark.createDataFrame([("/t/a.sh", 'psql -c "SELECT * FROM name_9"'), ("/t/c.sql", "SELECT * FROM name_7")], "file_path string, source string")
    ingest(spark, changed, root, rules=[(f"name_{i}", f"table_{i}") for i in range(1201)], buckets=3, keep_stored=True)
    docs = {r["file_path"]: r["canonical_tables"] for r in snapshots.read_documents(spark, root).collect()}
    assert docs == {"/t/a.sh": ["table_9"], "/t/b.py": ["table_1200"], "/t/c.sql": ["table_7"]}


def test_writers_do_not_disturb_each_other(spark, tmp_path):
    root = str(tmp_path / "index")
    one, two = snapshots.begin(spark, root), snapshots.begin(spark, root)
    assert one.path != two.path
    spark.range(1).write.parquet(f"{one.path}/documents")
    snapshots.begin(spark, root)
    assert spark.read.parquet(f"{one.path}/documents").count() == 1
    with pytest.raises(ValueError, match="postings"):
        one.commit()
    assert snapshots.current_path(spark, root) is None


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_setting", lambda session: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    with pytest.raises(scratch.NoSharedFolder, match="spark.checkpoint.dir"):
        scratch.shared_folder(spark)
