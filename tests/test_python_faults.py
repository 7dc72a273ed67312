"""Files that cannot be Python programs, held against the interpreter's own parser."""

import ast
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tabletrail.operators import python_blocks as P
from tabletrail.operators.chunks import split_scripts
from tabletrail.operators.python_blocks import python_faults
from tabletrail.sources.scripts import with_file_type

FAULTS = {
    "quote": ["x = 'a\ny = 1\n", 'def f():\n    """open\n    return 1\n'],
    "bracket": ["x = (1]\n", "x = 1)\n", "x = {'a': [1, 2}\n", "f(\n", "x = " + "(" * 201 + ")" * 201 + "\n", "if a:\n    b[(1])\n"],
    "character": ["x = $HOME\n", "a ? b\n", "!ls\n", "x = `y`\n", "x = 1 \\ \n+ 2\n", "if a ! = b:\n    pass\n"],
    "indent": [
        " x = 1\n", "x = 1\n  y = 2\n", "if a:\nb = 1\n", "if a:\n    if b:\n        c\n  d\n", "def f():\n    # only\nx = 1\n",
        "if a:\n        x\n\ty\n", "if a:\n\tx\n        y\n", "if a:\n    x = (1,\n2)\n   y = 1\n", "for i in x:\n    '''\n text\n'''\n     y = 1\n",
        "if a: \\\n  b\n  c\n", "".join(" " * i + "if a:\n" for i in range(101)) + " " * 101 + "b\n", "\tx\n",
    ],
    "end": ["def f():\n", "x = 1\nif x:\n    # nothing\n\n", "x = 1 \\\n", "class A:"],
}
FINE = [
    "if a:\n    b\n  # odd\n    c\nelse:\n  d\n", "x = [\n1,\n      2]\ny = {\n'a': (1,\n  2)}\n", "if a:\n\tif b:\n\t    c\n\td\ne\n", "if a:\r\n    b\r\n\r\nc = 1 \\\r\n  + 2\r\n",
    "if a: \\\n  b\nc\n", "def f():\n    '''\nx\n  y:\n'''\n    return 1\n", "x = 1 # (\ny = ')'\nz = a != b\n", "f = lambda: \\\n    0\n", "if a:\n    b\n\n\n   \t\n    c\n", "x = '''\n  '''; y = 1\n",
    "if (a and\nb):\n  c\n", "x = " + "(" * 100 + ")" * 100 + "\n", "@d\nclass A:\n  x: int\n  def f(self): return {1: 2}[1:]\n", "\fdef f():\n  return 1\n", "if a:\n    b", "x: dict = {1:\n2}\n", "if '''\n''':\n   x\ny\n",
    "".join(" " * i + "if a:\n" for i in range(90)) + " " * 90 + "b\n", "s = f\"{d['k']:>{w}}\"\n", "x = 'a\\\n  b'\n",
]


def is_program(source: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source)
        except SyntaxError:
            return False
    return True


def faults(spark, sources: list[str]) -> list[str | None]:
    rows = spark.createDataFrame([(f"/s/{i}.py", s) for i, s in enumerate(sources)], "file_path string, source string")
    found = {r["file_path"]: r["fault"] for r in python_faults(with_file_type(rows)).collect()}
    return [found[f"/s/{i}.py"] for i in range(len(sources))]


def test_each_fault_is_named(spark):
    cases = [(kind, source) for kind, sources in FAULTS.items() for source in sources]
    assert not [source for _, source in cases if is_program(source)]
    got = faults(spark, [source for _, source in cases])
    assert [(k, s, g) for (k, s), g in zip(cases, got, strict=True) if k != g] == []


def test_only_unpaired_brackets_are_followed(spark):
    """Pairs go before the fold; what is left decides the same, also near the limit of open brackets."""
    texts = ["x = {'a': [1, (2)]}\n" * 50, "a(]b)", "((x)", "[(])" + "()" * 9, "(" * 200 + ")" * 200, "(" * 201 + ")" * 201, "(" * 195 + "[" * 6 + "]" * 6 + "(", "(" * 190 + "[]" * 30 + ")" * 190]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", P._unpaired(F.col("t")).alias("rest"), P._bracket_fault(F.col("t")).alias("bad")).sort("i").collect()
    assert [r["rest"] for r in got][:4] == ["", "(])", "(", "[(])"]
    assert [r["bad"] for r in got] == [False, True, False, True, False, True, True, False]


def test_programs_have_no_fault(spark):
    assert [s for s in FINE if not is_program(s)] == []
    assert [(s, g) for s, g in zip(FINE, faults(spark, FINE), strict=True) if g] == []


def test_what_is_rejected_is_no_program(spark):
    """Random edits of a program: a fault is only named where the parser finds one too, and most that move lines are found."""
    base = (
        "import os\n\n@task\ndef read(a, b=(1, 2)):\n    '''Text: (\n odd\n    '''\n    if a:\n        x = [i for i in b\n             if i]\n    else:\n        return {'k': a}\n"
        "    # note\n    return x\n\nclass W:\n    def go(self):\n        for i in range(3):\n            print(i)\n\nif True: \\\n   W()\n"
    )
    rng = random.Random(4)
    sources, moved = [], []
    for _ in range(600):
        lines = base.split("\n")
        at = rng.randrange(len(lines))
        kind = rng.randrange(4)
        if kind == 0:
            lines[at] = rng.choice([" ", "  ", "\t", "    "]) + lines[at]
        elif kind == 1:
            lines[at] = lines[at][rng.randrange(1, 5) :]
        elif kind == 2:
            del lines[at]
        else:
            place = rng.randrange(len(lines[at]) + 1)
            lines[at] = lines[at][:place] + rng.choice("()[]{}:\\$!?'\"# \t\f") + lines[at][place:]
        sources.append("\n".join(lines))
        moved.append(kind == 0)
    got, fine = faults(spark, sources), [is_program(s) for s in sources]
    assert [s for s, fault, program in zip(sources, got, fine, strict=True) if fault and program] == []
    bad = [fault for fault, program, m in zip(got, fine, moved, strict=True) if m and not program]
    assert len(bad) > 50 and sum(f is not None for f in bad) >= 0.95 * len(bad)


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_faulty_files_become_blocks(spark, fault):
    source = FAULTS[fault][0] + "\n" * 40
    rows = split_scripts(spark.createDataFrame([("/s/a.py", source)], "file_path string, source string")).collect()
    assert sorted((r["chunk_type"], r["line_start"]) for r in rows) == [("block", 1), ("block", 31)]


def test_faults_of_other_and_empty_files(spark):
    rows = [("/a.sql", "x = ("), ("/b.py", ""), ("/c.py", None), ("/d.py", "\n \n"), ("/e.csv", "(")]
    found = python_faults(with_file_type(spark.createDataFrame(rows, "file_path string, source string"))).collect()
    assert {r["file_path"]: r["fault"] for r in found} == {"/b.py": None, "/c.py": None, "/d.py": None}
