"""One script per row of `orders`, written as SQL text that Spark and DuckDB both run.

The driver's tables hold no code, so the scripts are derived from them: order key and customer key pick language,
layout, folder and table names. `reading` and its other names come up far more often than the rest, and one folder
holds a third of all scripts. Some scripts go on for hundreds of statements, some statements for thousands of characters;
comments and strings hold accents and semicolons.
"""

from __future__ import annotations

NAMES = ["reading", "rd_old", "station", "reading", "rd_raw", "gauge_tbl", "RDG", "reading", "stn_tab", "basin_dim", "reading", "buffer_9"]
ALIAS_RULES = [
    ("rd_old", "reading"),
    ("rd_raw", "reading"),
    ("rdg", "reading"),
    ("stn_tab", "station"),
    ("stations_v1", "station"),
    ("gauge_tbl", "gauge"),
    ("lvl_hourly", "level"),
]


def _name(key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(NAMES))
    return f"CASE MOD({key}, {len(NAMES)}) {cases} END"


def _text(template: str) -> str:
    """SQL for a text in which {s}, {t}, {j}, {k} stand for columns and line ends for chr(10)."""
    parts: list[str] = []
    for n, line in enumerate(template.split("\n")):
        if n:
            parts.append("chr(10)")
        rest = line
        while rest:
            at = min((rest.find(f"{{{v}}}") for v in "stjk" if f"{{{v}}}" in rest), default=-1)
            head = rest if at < 0 else rest[:at]
            if head:
                parts.append("'" + head.replace("'", "' || chr(39) || '") + "'")
            if at < 0:
                break
            parts.append(rest[at + 1])
            rest = rest[at + 3 :]
    return " || ".join(parts) or "''"


_SQL = [
    """-- Load {t} from {s}
INSERT INTO {t} (id, v)
SELECT id, 'a;b' FROM {s} WHERE ts > (SELECT MAX(ts) FROM {t});

/* report; one
   row each */
SELECT c.id FROM {j} c JOIN {s} o ON c.id = o.id;
""",
    """WITH recent AS (
  SELECT * FROM {s}
)
SELECT * FROM recent;
SELECT 1 FROM {j} UNION ALL SELECT 2 FROM {s}; UPDATE {t} SET v = 1;
DELETE FROM {t} WHERE id = 3;
""",
    """CREATE OR REPLACE TABLE dwh.{t} AS
SELECT * FROM raw.{s};

DROP TABLE IF EXISTS {j};
MERGE INTO {t} USING {s} ON 1 = 1;
COPY {j} (id) FROM stage_{k}""",
    """SELECT 'oops FROM {s};
INSERT INTO {t} VALUES (1);
;
-- end
""",
]
_PYTHON = [
    '''"""Load {t}."""
import os
from lib import x

# taken from legacy
@task
def read_{k}(spark):
    df = spark.sql("""
        SELECT * FROM {s} s
        JOIN {j} j ON s.id = j.id
    """)
    return df

class Writer:
    def go(self, df):

        df.write.saveAsTable("dwh.{t}")

if __name__ == "__main__":
    Writer()
''',
    """RULES = [
"a",
"b",
]

# between
TEXT = '''x
def fake():
'''
async def pull(engine):
    return pd.read_sql("SELECT * FROM {s}", engine)

def push(df, engine):
    df.to_sql("{t}", engine)
# end
""",
    "def broken(\n    x\nSELECT * FROM {s}\n" + "x = 1\n" * 33 + "INSERT INTO {t}\n",
    """# from {s} only

# end
""",
]
_SHELL = [
    """#!/usr/bin/env bash
# load {t}
set -e

psql -c "COPY {t} (id) FROM s3"

load_{k}() {
  psql -c "INSERT INTO {t} SELECT * FROM {s}"
  if true; then { echo x; }; fi
}

echo done
""",
    """one() { echo a; }
psql -c "SELECT COUNT(*) FROM {s}"

function two() {
# c
}
# next
bq query "SELECT 1 FROM {j}\"""",
    """

echo from {s}
f() {
  g() {
    psql -c "select 1 from {s}"
  }
}
""",
    """
   
""",
]


_QUOTE = "chr(39)"
_MORE = {
    0: f""" || repeat(chr(10) || 'INSERT INTO ' || t || ' SELECT * FROM ' || s || ' WHERE note = ' || {_QUOTE} || 'déjà; vu' || {_QUOTE} || ' -- Größe;'
      || chr(10) || ';', more)""",
    3: """ || 'DELETE FROM ' || t || ' WHERE id IN (0' || repeat(', 12345', more * 25) || ');'""",
    4: """ || chr(10) || repeat(chr(10) || 'def more(x):' || chr(10) || '    return x' || chr(10), more)""",
}


def corpus_sql(orders: str = "orders") -> str:
    """SELECT of (file_path, source)."""
    shapes = []
    for shape in range(12):
        text = (_SQL, _PYTHON, _SHELL)[shape % 3][shape // 3]
        shapes.append(f"WHEN {shape} THEN {_text(text)}{_MORE.get(shape, '')}")
    return f"""
SELECT '/repo/' || folder || 'job_' || k || extension AS file_path,
       CASE shape {' '.join(shapes)} END AS source
FROM (
  SELECT CAST(o_orderkey AS STRING) AS k, CAST(CASE WHEN MOD(o_custkey, 80) = 0 THEN 150 ELSE MOD(o_custkey, 5) END AS INT) AS more, MOD(o_orderkey, 12) AS shape,
         {_name('o_orderkey + o_custkey')} AS s, {_name('o_custkey')} AS t, {_name('o_custkey + 5')} AS j,
         CASE WHEN MOD(o_orderkey, 7) = 0 THEN 'archive/' WHEN MOD(o_custkey, 3) = 0 THEN 'core/'
              ELSE 'team' || CAST(MOD(o_custkey, 40) AS STRING) || '/etl/' END AS folder,
         CASE WHEN MOD(o_orderkey, 50) = 49 THEN '.csv' WHEN MOD(o_orderkey, 60) = 0 THEN '.SQL'
              WHEN MOD(o_orderkey, 3) = 0 THEN '.sql' WHEN MOD(o_orderkey, 3) = 1 THEN '.py' ELSE '.sh' END AS extension
  FROM {orders}
) AS keys"""


_FAULTY = [
    "import os\n{x}if a:\n    for i in b:\n        {s}(i)\n    c\nelse:\n  d\nwith {t}() as t:\n    pass\n",
    "def {s}():\n    if a:\n        b = 1\n{x}      c = 2\n    return b\n",
    "{x}a = 1\n  {s} = 2\nb = 3\n",
    "{x}def {s}(x):\n# to do\n\nreturn {t}\n",
    "{x}a = [{s}(1, 2]\nb = (3)\n",
    "{x}a = {s}(1)\nb = (2))\nc = (\n",
    "{x}a = {s}\necho $HOME\n",
    "{x}if {s}:\n        a = 1\n\tb = 2\n",
    "{x}a = 1\nclass {t}:\n    # {s}\n",
    "{x}a = {\n1: [2,\n        3],\n}\nb = 1 + \\\n      2\n  # note: (\ntext = \"\"\"\n      {s}(\n\"\"\"\ndef {t}():\n\tif a:\n\t\treturn a\n\treturn b\n",
]


def faulty_sql(orders: str = "orders") -> str:
    """SELECT of (file_path, file_type, source): Python files, eight of ten with a fault, after more or fewer sound lines."""
    shapes = []
    for shape, text in enumerate(_FAULTY):
        rest = text.replace("'", "''").replace("\\", "' || chr(92) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
        for name, column in (("{x}", "sound"), ("{s}", "s"), ("{t}", "t")):
            rest = rest.replace(name, f"' || {column} || '")
        shapes.append(f"WHEN {shape} THEN '{rest}'")
    return f"""
SELECT '/repo/' || k || '.py' AS file_path, 'python' AS file_type, CASE shape {' '.join(shapes)} END AS source
FROM (SELECT CAST(o_orderkey AS STRING) AS k, MOD(o_orderkey + o_custkey, 10) AS shape, {_name('o_orderkey + o_custkey')} AS s, {_name('o_custkey')} AS t,
        repeat(CASE WHEN MOD(o_orderkey + o_custkey, 10) = 1 THEN '        z = (1)' || chr(10) ELSE 'z = {{"a": [1]}}' || chr(10) END,
          CAST(MOD(o_custkey, 45) AS INT)) AS sound
      FROM {orders}) AS keys"""
