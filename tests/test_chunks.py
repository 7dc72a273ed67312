import pytest

from tabletrail.operators.chunks import caption, split_scripts
from tabletrail.sources.scripts import read_scripts

BAD_PYTHON = "total = sum([\n" + "    1,\n" * 38 + "pass\n"
SCRIPTS = [
    ("bad.py", BAD_PYTHON),
    ("empty.py", ""),
    ("notes.sql", "-- only\n/* comments */"),
    ("empty.sh", ""),
    ("blank.sh", "\n \n"),
    ("open.sql", "select 'a; b;\nc"),
    (
        "kinds.sql",
        "with a as (select 1 union select 2) select * from a; (select 1); select 1 union select 2;\n\n"
        "update t set a = 1; delete from t; merge into t using s; with x as (select 1) insert into t select 1;"
        " create view v as select 1; select $$a;b$$, `c;d`",
    ),
    ("fun.sh", "f() { a; }\nb\nfunction g() {\n x\n}\n\n\ny\nz() {\n q\n"),
    (
        "top.py",
        "@dec\ndef f():\n    x = '''\nabc\n'''\n\n# comment\nclass A:\n  pass\nx = [\n1,\n2]\ny = 3 \\\n+ 4\n# c\nz=1\n"
        "if z:\n    pass\nelse:\n    pass\n# end\n",
    ),
    ("data.csv", "a,b"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = split_scripts(spark.createDataFrame(SCRIPTS, "file_path string, source string")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], int(r["chunk_id"].split("#")[1]))):
        out.setdefault(r["file_path"], []).append((r["chunk_type"], r["line_start"], r["line_end"], r["raw_text"]))
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    return out


def test_sql(chunks):
    kinds = [c[0] for c in chunks["kinds.sql"]]
    assert kinds == ["select", "statement", "statement", "update", "delete", "statement", "write", "write", "select"]
    assert chunks["kinds.sql"][-1][3] == "select $$a;b$$, `c;d`"
    assert chunks["kinds.sql"][3][1:3] == (3, 3)
    assert "notes.sql" not in chunks


def test_sql_with_open_quote_is_cut_at_semicolons(chunks):
    assert [c[:3] for c in chunks["open.sql"]] == [("statement", 1, 1), ("statement", 3, 3), ("statement", 5, 5)]
    assert [c[3] for c in chunks["open.sql"]] == ["select 'a", "b", "c"]


def test_python(chunks):
    assert [c[:3] for c in chunks["top.py"]] == [("function", 1, 5), ("class", 8, 9), ("module_preamble", 10, 20)]
    assert chunks["top.py"][2][3] == "x = [\n1,\n2]\ny = 3 \\\n+ 4\nz=1\nif z:\n    pass\nelse:\n    pass"
    assert [c[:3] for c in chunks["bad.py"]] == [("block", 1, 30), ("block", 31, 40)]
    assert "empty.py" not in chunks and "data.csv" not in chunks


def test_shell(chunks):
    assert [c[:3] for c in chunks["fun.sh"]] == [
        ("function", 1, 2), ("function", 3, 5), ("command_group", 6, 8), ("command_group", 9, 10),
    ]
    assert chunks["empty.sh"] == [("script", 1, 0, "")]
    assert chunks["blank.sh"] == [("script", 1, 2, "\n \n")]


def test_long_scripts_keep_their_lines(spark):
    """Longer than one fold block: states carry over."""
    n = 700
    python = "".join(f"def f{i}():\n    return (\n{i})\n\n" for i in range(n))
    shell = "".join(f"# step {i}\nrun {i}\n" for i in range(n))
    sql = "".join(f"SELECT {i}\nFROM t;\n" for i in range(n))
    files = spark.createDataFrame([("a.py", python), ("a.sh", shell), ("a.sql", sql)], "file_path string, source string")
    rows = split_scripts(files).collect()
    starts = {kind: sorted((r["line_start"], r["line_end"]) for r in rows if r["file_type"] == kind) for kind in ("python", "shell", "sql")}
    assert starts["python"] == [(4 * i + 1, 4 * i + 3) for i in range(n)]
    assert starts["shell"] == [(2 * i + 1, 2 * i + 2) for i in range(n)]
    assert starts["sql"] == [(2 * i + 1, 2 * i + 2) for i in range(n)]


def test_scan(spark, script_folder):
    def names(**options):
        return {r["file_path"].removeprefix(f"{script_folder}/") for r in read_scripts(spark, str(script_folder), **options).collect()}

    (script_folder / "a b+c").mkdir()
    (script_folder / "a b+c" / "two.sql").write_text("SELECT 1 FROM one;\r\nSELECT 2;")
    (script_folder / "levels" / "table.txt").write_text("FROM x\n")
    (script_folder / "_draft.sh").write_text("true\n")
    every = {"levels/hourly.sql", "levels/gauges.py", "nightly.sh", "stations.sql", "retired/2009/levels.py", "a b+c/two.sql"}
    assert names() == every
    assert names(excluded=["retired", "a b+c", "stations.sql"]) == {"levels/hourly.sql", "levels/gauges.py", "nightly.sh"}
    assert names(excluded=["2009"]) == every - {"retired/2009/levels.py"}
    assert names(include_hidden=True) == every | {"_draft.sh"}
    assert read_scripts(spark, str(script_folder / "nowhere")).count() == 0
    chunk = split_scripts(read_scripts(spark, str(script_folder))).where("file_path LIKE '%two.sql' AND line_start = 2")
    row = chunk.select("line_end", caption().alias("c")).first()
    assert row["line_end"] == 2 and row["c"].endswith("two.sql lines 2-2 (select)") and row["c"].startswith("[SQL] ")
