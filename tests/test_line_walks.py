"""The walks over a script's lines, and references of chunks with few and with many names."""

import pytest
from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.operators import python_blocks, refs, shell_groups
from tabletrail.operators.chunks import is_extractable, split_scripts
from tabletrail.operators.marks import BLANK, BLOCK, CLOSED, HEAD_END, NODE, lines_of
from tabletrail.operators.refs import add_refs


def test_lines_end_as_in_spark():
    assert [lines_of(t) for t in ("", "\n", "a", "a\n", "a\n\n", "a\r\nb")] == [[""], [""], ["a"], ["a"], ["a", ""], ["a\r", "b"]]


def test_shell_groups_are_marked():
    marked = shell_groups._mark_groups("\na\n# b\nf ( ) {\n\n{ x; }\n}\n\nc")
    group = lambda start, line: f"{BLOCK}{start},{line}{HEAD_END}"
    assert marked == group(1, 2) + "a\n" + group(3, 3) + "# b\n" + group(4, 4) + "f ( ) {\n\n{ x; }\n}\n" + CLOSED + group(8, 9) + "c\n"


def test_python_lines_are_marked():
    marked, brackets, is_open, quote, rest = python_blocks._scan_lines("x = '(' # [\n\n@d\ndef f(a):\n    return {\n1}\n# end")
    block = lambda line, kind: f"{BLOCK}{line},{line}{HEAD_END}{NODE}{kind}"
    # A comment without a line end is no line of the text that is walked over.
    assert marked == block(1, 1) + f"x = '(' # [\n{BLANK}\n" + block(3, 4) + f"@d\n{NODE}2def f(a):\n    return {{\n1}}\n"
    assert (brackets, is_open, quote, rest) == ("(){}", False, False, None)


def test_python_and_shell_lines_are_walked_in_batches(spark):
    """One pass through Python for both languages, not a fold of Spark expressions per line."""
    rows = spark.createDataFrame([("/a.py", "x = 1\n"), ("/b.sh", "ls\n"), ("/c.sh", None)], "file_path string, source string")
    found = split_scripts(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["file_path"], r["raw_text"]) for r in found.collect()) == [("/a.py", "x = 1"), ("/b.sh", "ls")]


@pytest.mark.parametrize("few", [0, refs._FEW_NAMES, 10**6])
def test_references_do_not_depend_on_how_many_are_few(spark, monkeypatch, few):
    monkeypatch.setattr(refs, "_FEW_NAMES", few)
    text = "INSERT INTO b SELECT * FROM t1 JOIN T2 JOIN d.t3 JOIN t1; DROP TABLE t3; COPY t2 (x); CREATE VIEW IF NOT EXISTS t2 AS"
    text = text.replace(" b ", " bb ") + "".join(f" JOIN n{i}" for i in range(refs._FEW_NAMES if few else 40))
    rows = spark.createDataFrame([("c", "sql", text), ("d", "sql", "SELECT 1 + 1 AS one")], "chunk_id string, file_type string, raw_text string")
    found = {r["chunk_id"]: [(x["ord"], x["raw"], x["ref_type"]) for x in r["refs"]] for r in add_refs(rows).collect()}
    assert found["c"][:4] == [(0, "t1", "READ"), (1, "t2", "WRITE"), (2, "t3", "DROP"), (3, "n0", "READ")]
    assert found["c"][-1][1:] == ("bb", "WRITE") and [o for o, _, _ in found["c"]] == list(range(len(found["c"])))
    assert found["d"] == []


def test_extractable_is_the_stripped_length(spark):
    texts = ["", " ", "123456789", " 123456789 ", "1234567890", "　 12345 7890\n", "1        0", "1         0", "é" * 9 + "\x85", "é" * 10, None, "\U0001f600" * 9, "\U0001f600" * 10]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    for least in (settings.MIN_CHUNK_CHARS, 2, 1, 0):
        got = [r["x"] for r in rows.select("i", is_extractable(least).alias("x")).orderBy("i").collect()]
        assert got == [None if t is None else len(t.strip()) >= least for t in texts], least
    assert rows.where(F.col("raw_text").isNull() & is_extractable()).count() == 0
