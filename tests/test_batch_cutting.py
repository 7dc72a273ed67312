"""Scripts are cut and searched in Arrow batches, by small walks that keep the rules of the column expressions."""

import random

from pyspark.sql import functions as F

from tabletrail import settings
from tabletrail.operators import python_blocks, refs, sql_statements
from tabletrail.operators.chunks import split_scripts
from tabletrail.operators.refs import add_refs, table_names

PIECES = [
    "select * from ", "FROM\t", "join\n", "insert into ", "merge into ", "update ", "copy ", "into ", "drop view ", "create or replace table ", "a1", "Dwh.T2", '"X".[y]', "`q`.r", "été",
    "ΑΣ", "İx", "K", "²", "٣٤", "12", ".", ";", "\n", " ", "(", ")", "'", '"', "pd.read_sql('", ".saveAsTable('F')", " ", "\xa0", "as", "x",
]


def texts(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_no_expression_walks_over_a_script(spark):
    """Regex lists and folds over arrays, evaluated expression by expression, cost several times what a batch does."""
    rows = spark.createDataFrame([("/a.sql", "select 1 from tt")], "file_path string, source string")
    plan = add_refs(split_scripts(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert [word for word in ("regexp_extract_all", "aggregate(", "transform(", "filter(") if word in plan] == []
    assert plan.count("ArrowEvalPython") == 2


def test_references_are_those_of_the_patterns(spark):
    """The walk finds what the column expressions find, in their order, and the last family gives the type."""
    found = texts(800)
    rows = spark.createDataFrame([(i, kind, t) for i, t in enumerate(found) for kind in refs.FAMILIES], "i int, file_type string, raw_text string")
    searched = rows.where(F.length(F.trim("raw_text")) >= 2 * settings.MIN_CHUNK_CHARS).cache()
    got = {(r["i"], r["file_type"]): [(x["raw"], x["ref_type"]) for x in r["refs"]] for r in add_refs(searched).collect()}
    expected = {}
    for kind, members in refs.FAMILIES.items():
        columns = [table_names(F.col("raw_text"), patterns).alias(f"n{i}") for i, (_, patterns) in enumerate(members)]
        for r in searched.where(F.col("file_type") == kind).select("i", *columns).collect():
            types = {}
            for i, (family, _) in enumerate(members):
                types.update(dict.fromkeys(r[f"n{i}"], family))
            expected[r["i"], kind] = list(types.items())
    assert got == expected and sum(map(len, got.values())) > 300


def test_brackets_follow_the_rule_of_the_faults(spark):
    rng = random.Random(3)
    cases = ["".join(rng.choice("()[]{}") for _ in range(rng.randrange(8))) for _ in range(300)]
    cases += ["(" * n + ")" * n for n in (199, 200, 201)] + ["(" * 195 + "[" * 6, "([{}])" * 100]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    bad = [r["bad"] for r in rows.select("i", python_blocks._bracket_fault(F.col("t")).alias("bad")).sort("i").collect()]
    assert [not python_blocks._brackets_fit(t) for t in cases] == bad and any(bad) and not all(bad)


def test_long_texts_are_cut_in_linear_steps():
    many = "insert into t select 'a;b', $$x;y$$ from s; -- é\n" * 20_000
    found = sql_statements.cut_sql(many)
    assert len(found) == 20_000 and found[-1][0] == 19_999 and found[-1][3:] == (20_000, 20_000)
    assert sql_statements.cut_sql("delete from t where id in (0" + ", 1" * 500_000 + ");")[0][1] == "delete"


def test_broken_bytes_do_not_end_the_job(spark):
    rows = spark.range(3).selectExpr(
        "concat('/f', element_at(array('.sql', '.py', '.sh'), cast(id as int) + 1)) file_path", "cast(concat(cast('x = 1 from tt' as binary), X'FF') as string) source"
    )
    assert sorted(r["raw_text"] for r in add_refs(split_scripts(rows)).collect()) == ["x = 1 from tt�"] * 3
