import random

import pytest

from tabletrail.operators import long_scripts
from tabletrail.operators.chunks import split_scripts

PARTS = [
    "select 1;\n", "insert into t values ('a; b\n", "c');\n", "-- note; '\n", "/* long;\n", "more '; */ update t\n", "set a = 1;\n", "\n", "create f as $$ a;\n", "b; $$;\n", "$body$\n", "x; '\n",
    "$body$ select 2;\n", 'select "a;\n', 'b" from t; delete from u\n', "where c = 'x'';\n", "y'; `q;\n", "r` ;;\n", "with a as (select 1)\n", "select * from a;\n", "select 3 / 2 - 1, $1;\n", "café;\n",
]


def scripts(seed: int, n: int) -> dict[str, list[str]]:
    rng = random.Random(seed)
    out = {f"/s/{i}.sql": [rng.choice(PARTS) for _ in range(rng.randrange(1, 40))] for i in range(n)}
    out["/s/last.sql"] = [*PARTS, "select 5 -- end;"]
    out["/s/comment.sql"] = ["select 1;\n", "/* open;\n", "select 2;\n"]
    out["/s/open.sql"] = ["select 'a;\n", "b;\n", "c"]
    out["/s/tick.sql"] = ["select `a;\n", "b;\n", "$x$ c;\n"]
    out["/s/empty.sql"] = [""]
    return out


def rows_of(frame):
    return sorted((r["chunk_id"], r["file_type"], r["chunk_type"], r["raw_text"], r["line_start"], r["line_end"]) for r in frame.collect())


@pytest.mark.parametrize("block", [2, 1000])
def test_segments_give_the_chunks_of_whole_files(spark, monkeypatch, block):
    monkeypatch.setattr(long_scripts, "BLOCK", block)
    rng = random.Random(block)
    files = scripts(block, 60)
    cuts = []
    for path, lines in files.items():
        part, held = rng.randrange(5), ""
        for line in lines:
            held += line
            if rng.random() < 0.6:
                cuts.append((path, part, held))
                part, held = part + 1, ""
        cuts.append((path, part, held))
    rng.shuffle(cuts)
    whole = spark.createDataFrame([(p, "".join(t)) for p, t in files.items()], "file_path string, source string")
    found = rows_of(long_scripts.split_segments(spark.createDataFrame(cuts, "file_path string, part int, text string")))
    expected = rows_of(split_scripts(whole))
    assert len(expected) > 300 and found == expected
    closed = {r["file_path"] for r in long_scripts.start_states(spark.createDataFrame(cuts, "file_path string, part long, text string")).where("state = '$body$'").collect()}
    assert closed


def test_no_segments(spark):
    nothing = spark.createDataFrame([], "file_path string, part int, text string")
    assert long_scripts.split_segments(nothing).count() == 0
    odd = spark.createDataFrame([(None, 1, "select 1;"), ("/a.sql", 1, None), ("/b.sql", 1, "select 1;\n")], "file_path string, part int, text string")
    assert [r["raw_text"] for r in long_scripts.split_segments(odd).collect()] == ["select 1"]
