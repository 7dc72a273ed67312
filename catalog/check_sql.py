"""The same results in DuckDB SQL, reached another way: by unnesting, windows and recursion over rows."""

from __future__ import annotations

import re

from catalog.corpus import ALIAS_RULES, corpus_sql, faulty_sql
from catalog.inputs import TOP_K, target_names_sql
from tabletrail import settings

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def _lines(c: str) -> str:
    return f"(length({c}) - length(replace({c}, {NL}, '')))"


def _strip(c: str) -> str:
    return f"trim({c}, {WS})"


STOP = ", ".join(f"'{word}'" for word in settings.STOP_WORDS)
CLEAN = "lower(list_extract(string_split(" + _strip("translate(raw, '`\"[]' || chr(39), '')") + ", '.'), -1))"
CANONICAL = "CASE raw " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIAS_RULES) + " ELSE raw END"

CTES: dict[str, str] = {}

CTES["files"] = f"""
SELECT * FROM (
  SELECT file_path, source,
         CASE lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1))
           WHEN 'sql' THEN 'sql' WHEN 'py' THEN 'python' WHEN 'sh' THEN 'shell' END AS file_type
  FROM ({corpus_sql()}) AS c) AS typed
WHERE file_type IS NOT NULL"""

# --- SQL: tokens, running counts, statements ---------------------------------

CTES["sql_tokens"] = r"""
SELECT file_path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
  SELECT file_path, regexp_extract_all(source,
    '''[^'']*''|"[^"]*"|--[^\n]*|/\*(?s:.*?)\*/|;|[^;''"/-]+|(?s:.)') AS toks
  FROM files WHERE file_type = 'sql') AS t"""
CTES["sql_open"] = """SELECT DISTINCT file_path FROM sql_tokens WHERE tok IN ('''', '"')"""
CTES["sql_counted"] = f"""
SELECT *, coalesce(sum(CASE WHEN tok = ';' THEN 1 ELSE 0 END) OVER w, 0) AS stmt, 1 + coalesce(sum({_lines('tok')}) OVER w, 0) AS line,
  (tok LIKE '--%' OR tok LIKE '/*%' OR tok = ';' OR {_strip('tok')} = '') AS idle
FROM sql_tokens WHERE file_path NOT IN (SELECT file_path FROM sql_open)
WINDOW w AS (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
CTES["sql_grouped"] = f"""
SELECT file_path, stmt, string_agg(tok, '' ORDER BY i) FILTER (tok <> ';') AS body, min(line) AS first_line,
  arg_min(line + {_lines("tok[1:length(tok) - length(ltrim(tok, " + WS + "))]")}, i) FILTER (NOT idle) AS code_line,
  string_agg(CASE WHEN tok LIKE '--%' OR tok LIKE '/*%' THEN ' ' ELSE tok END, '' ORDER BY i) AS code
FROM sql_counted GROUP BY file_path, stmt HAVING count(*) FILTER (NOT idle) > 0"""
CTES["sql_chunks"] = f"""
SELECT file_path, 'sql' AS file_type,
  CASE regexp_extract(lower({_strip('code')}), '^[a-z]+')
    WHEN 'select' THEN CASE WHEN lower(code) LIKE '% union %' THEN 'statement' ELSE 'select' END
    WHEN 'with' THEN 'select' WHEN 'insert' THEN 'write' WHEN 'create' THEN 'write'
    WHEN 'update' THEN 'update' WHEN 'delete' THEN 'delete' ELSE 'statement' END AS chunk_type,
  {_strip('body')} AS raw_text, code_line AS line_start,
  first_line + {_lines("rtrim(body, " + WS + ")")} AS line_end, stmt AS ord
FROM sql_grouped
UNION ALL
SELECT file_path, 'sql', 'statement', part, line_start, line_start + {_lines('part')}, i - 1 FROM (
  SELECT *, 1 + coalesce(sum({_lines('part')} + 2) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
  FROM (SELECT file_path, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
    SELECT file_path, list_filter(list_transform(string_split(source, ';'), lambda x: {_strip('x')}), lambda x: x <> '') AS parts
    FROM files WHERE file_path IN (SELECT file_path FROM sql_open)) AS p) AS q) AS r"""

CTES["ls_files"] = f"""
SELECT file_path, 'sql' AS file_type, string_agg(source || {NL}, '' ORDER BY key) AS source
FROM (SELECT source, key, '/dumps/' || CASE WHEN key % 7 < 3 THEN 0 ELSE key % 40 END || '.sql' AS file_path
      FROM (SELECT source, CAST(regexp_extract(file_path, 'job_([0-9]+)', 1) AS BIGINT) AS key FROM files
            WHERE file_type = 'sql' AND source NOT LIKE '%oops%') AS k) AS d
GROUP BY file_path"""
for _name in ("sql_tokens", "sql_open", "sql_counted", "sql_grouped", "sql_chunks"):
    CTES["ls" + _name[3:]] = CTES[_name].replace("sql_", "ls_").replace("FROM files", "FROM ls_files")

# --- Python: blank out strings and comments, then windows over lines ----------

CTES["py_tokens"] = r"""
SELECT file_path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
  SELECT file_path, regexp_extract_all(source,
    '"{3}(?s:.*?)"{3}|''{3}(?s:.*?)''{3}|"(?:[^"\\\n]|\\(?s:.))*"|''(?:[^''\\\n]|\\(?s:.))*''|#[^\n]*|[^"''#]+|(?s:.)') AS toks
  FROM files WHERE file_type = 'python') AS t"""
CTES["py_masked"] = r"""
SELECT file_path, string_agg(CASE WHEN tok LIKE '#%' THEN '' WHEN tok[1] IN ('"', '''')
    THEN '"' || regexp_replace(substr(tok, 2), '[^\n]', '~', 'g') ELSE tok END, '' ORDER BY i) AS masked
FROM py_tokens GROUP BY file_path"""
CTES["py_lines"] = f"""
SELECT file_path, unnest(string_split(source, {NL})) AS line, unnest(string_split(masked, {NL})) AS m,
  generate_subscripts(string_split(source, {NL}), 1) AS i
FROM files JOIN py_masked USING (file_path)"""
CTES["py_depth"] = r"""
SELECT *, coalesce(sum(delta) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
  sum(delta) OVER (PARTITION BY file_path) AS final_depth
FROM (SELECT *, length(regexp_replace(m, '[)\]}]', '', 'g')) - length(regexp_replace(m, '[(\[{]', '', 'g')) AS delta FROM py_lines) AS d"""
CTES["py_nodes"] = r"""
SELECT *, sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY i) AS node FROM (
  SELECT *, depth = 0 AND regexp_matches(m, '^[^\s~]') AS top,
    CASE WHEN regexp_matches(m, '^(async\s+)?def\b') THEN 'function' WHEN regexp_matches(m, '^class\b') THEN 'class'
         WHEN m LIKE '@%' THEN '@' ELSE 'other' END AS kind
  FROM py_depth) AS n"""
CTES["py_grouped"] = f"""
SELECT file_path, node, min(i) AS first_i, max(i) FILTER ({_strip('m')} <> '') AS last_i, arg_min(kind, i) AS kind, max(final_depth) AS final_depth
FROM py_nodes WHERE node > 0 GROUP BY file_path, node"""
CTES["py_blocks"] = """
SELECT *, sum(CASE WHEN (before = 'other' AND kind = 'other') OR before = '@' THEN 0 ELSE 1 END)
  OVER (PARTITION BY file_path ORDER BY node) AS block
FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY file_path ORDER BY node), '') AS before FROM py_grouped WHERE final_depth = 0) AS b"""
CTES["python_chunks"] = f"""
SELECT b.file_path, 'python' AS file_type,
  CASE WHEN bool_or(b.kind = 'function') THEN 'function' WHEN bool_or(b.kind = 'class') THEN 'class' ELSE 'module_preamble' END AS chunk_type,
  string_agg(l.line, {NL} ORDER BY l.i) AS raw_text, min(l.i) AS line_start, max(l.i) AS line_end, b.block - 1 AS ord
FROM py_blocks b JOIN py_lines l ON l.file_path = b.file_path AND l.i BETWEEN b.first_i AND b.last_i
GROUP BY b.file_path, b.block
UNION ALL
SELECT file_path, 'python', 'block', string_agg(line, {NL} ORDER BY i), min(i), max(i), (i - 1) // 30
FROM (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM py_lines) AS l
WHERE file_path NOT IN (SELECT file_path FROM py_blocks) AND NOT (i = n AND line = '')
GROUP BY file_path, (i - 1) // 30"""

# --- Python that is none: each bracket beside the last of its depth, each indent beside the nearest that is not deeper

CTES["fp_files"] = faulty_sql()
for _name in ("py_tokens", "py_masked", "py_lines", "py_depth"):
    CTES["fp" + _name[2:]] = CTES[_name].replace("py_", "fp_").replace("FROM files", "FROM fp_files")
CTES["fp_brackets"] = r"""
SELECT *, lag(c) OVER (PARTITION BY file_path, level ORDER BY i) AS other FROM (
  SELECT *, sum(up) OVER (PARTITION BY file_path ORDER BY i) + CASE WHEN up < 0 THEN 1 ELSE 0 END AS level FROM (
    SELECT *, CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END AS up FROM (
      SELECT file_path, unnest(found) AS c, generate_subscripts(found, 1) AS i
      FROM (SELECT file_path, regexp_extract_all(masked, '[\[\](){}]') AS found FROM fp_masked) AS f) AS b) AS u) AS l"""
CTES["fp_heads"] = r"""
SELECT *, lag(wide, 1, 0) OVER (PARTITION BY file_path ORDER BY i) AS before_wide, lag(narrow, 1, 0) OVER (PARTITION BY file_path ORDER BY i) AS before_narrow FROM (
  SELECT *, length(replace(indent, chr(9), repeat(' ', 8))) AS wide, length(indent) AS narrow FROM (
    SELECT *, regexp_extract(m, '^[ \t]*') AS indent, coalesce(lag(m LIKE '%:' AND depth + delta = 0) OVER (PARTITION BY file_path ORDER BY i), false) AS opened,
      lead(i) OVER (PARTITION BY file_path ORDER BY i) IS NULL AND m LIKE '%:' AS ends
    FROM (SELECT *, coalesce(lag(m) OVER (PARTITION BY file_path ORDER BY i), '') AS line_before FROM fp_depth) AS p WHERE regexp_matches(m, '[^ \t]')) AS h
  WHERE depth = 0 AND m NOT LIKE '~%' AND NOT ends_with(line_before, chr(92))) AS w"""
CTES["fp_faults"] = r"""
SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM fp_brackets WHERE up < 0 AND (level < 1 OR other || c NOT IN ('()', '[]', '{}')))
    OR file_path IN (SELECT file_path FROM fp_depth WHERE final_depth > 0) THEN 'bracket'
  WHEN regexp_matches(masked, '[$?`]') THEN 'character'
  WHEN file_path IN (SELECT h.file_path FROM fp_heads h WHERE CASE WHEN opened THEN wide <= before_wide OR narrow <= before_narrow
      WHEN wide >= before_wide THEN wide > before_wide OR narrow <> before_narrow
      ELSE (SELECT arg_max(o.wide, o.i) FROM fp_heads o WHERE o.file_path = h.file_path AND o.i < h.i AND o.wide <= h.wide) <> wide END) THEN 'indent'
  WHEN file_path IN (SELECT file_path FROM fp_heads WHERE ends) THEN 'end' ELSE '' END AS fault
FROM fp_masked"""
for _name in ("py_nodes", "py_grouped", "py_blocks", "python_chunks"):
    CTES["fp_chunks" if _name == "python_chunks" else "fp" + _name[2:]] = (
        CTES[_name].replace("py_", "fp_").replace("WHERE final_depth = 0", "WHERE file_path IN (SELECT file_path FROM fp_faults WHERE fault = '')")
    )

# --- Shell: a recursion that reads one line of every file at a time -----------

CTES["sh_lines"] = f"""
SELECT *, CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, '^(function\\s+)?\\w+\\s*\\(\\s*\\)') THEN 2 WHEN t LIKE '#%' THEN 1 ELSE 3 END AS kind,
  length(replace(t, '}}', '')) - length(replace(t, '{{', '')) AS delta
FROM (SELECT file_path, line, {_strip('line')} AS t, i FROM (
  SELECT file_path, unnest(string_split(source, {NL})) AS line, generate_subscripts(string_split(source, {NL}), 1) AS i,
    length(string_split(source, {NL})) AS n
  FROM files WHERE file_type = 'shell') AS s WHERE NOT (i = n AND line = '')) AS l"""
CTES["sh_states"] = """
SELECT file_path, 0::BIGINT AS i, 1::BIGINT AS start_line, 0::BIGINT AS depth, false AS inside, false AS is_open, false AS begins, false AS kept, false AS closes
FROM files WHERE file_type = 'shell'
UNION ALL
SELECT l.file_path, l.i,
  CASE WHEN l.kind = 2 OR (l.kind = 1 AND NOT s.inside AND s.is_open) THEN l.i
       WHEN s.inside AND l.kind IN (1, 3) AND s.depth + l.delta <= 0 THEN l.i + 1 ELSE s.start_line END,
  CASE WHEN l.kind = 2 THEN l.delta WHEN s.inside AND l.kind IN (1, 3) THEN s.depth + l.delta ELSE s.depth END,
  CASE WHEN l.kind = 2 THEN true WHEN l.kind = 0 THEN s.inside ELSE s.inside AND s.depth + l.delta > 0 END,
  CASE WHEN l.kind = 0 THEN s.is_open WHEN l.kind = 2 THEN true ELSE NOT (s.inside AND s.depth + l.delta <= 0) END,
  l.kind <> 0 AND (l.kind = 2 OR NOT s.is_open OR (l.kind = 1 AND NOT s.inside)),
  l.kind <> 0 OR s.is_open,
  l.kind IN (1, 3) AND s.inside AND s.depth + l.delta <= 0
FROM sh_states s JOIN sh_lines l ON l.file_path = s.file_path AND l.i = s.i + 1"""
CTES["sh_blocks"] = """
SELECT s.*, l.line, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY s.file_path ORDER BY s.i) AS block
FROM sh_states s JOIN sh_lines l ON l.file_path = s.file_path AND l.i = s.i WHERE kept"""
CTES["shell_chunks"] = f"""
SELECT file_path, 'shell' AS file_type, CASE WHEN bool_or(closes) THEN 'function' ELSE 'command_group' END AS chunk_type,
  {_strip(f"string_agg(line, {NL} ORDER BY i)")} AS raw_text, max(CASE WHEN begins THEN start_line END) AS line_start, max(i) AS line_end,
  block - 1 AS ord
FROM sh_blocks GROUP BY file_path, block
UNION ALL
SELECT file_path, 'shell', 'script', source, 1, (SELECT count(*) FROM sh_lines l WHERE l.file_path = f.file_path), 0
FROM files f WHERE file_type = 'shell' AND file_path NOT IN (SELECT file_path FROM sh_blocks)"""

CTES["chunks"] = """
SELECT file_path || '::' || line_start || '-' || line_end || '#' || ord AS chunk_id, file_path, file_type, chunk_type, raw_text,
  CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end
FROM (SELECT * FROM sql_chunks UNION ALL SELECT * FROM python_chunks UNION ALL SELECT * FROM shell_chunks) AS u"""

# --- References ---------------------------------------------------------------

_W = r"[\p{L}\p{N}_.]+"
_Q = rf'[`"\[]?{_W}[`"\]]?'
_SQ = rf"({_Q}(?:\.{_Q})*)"
_P = "[`\"'']?" + _W + "[`\"'']?"
_PQ = rf"({_P}(?:\.{_P})*)"
_S = "[\"'']([^\"'']+)[\"'']"
FOUND = {
    ("sql", 0): ("READ", [rf"\bFROM\s+{_SQ}", rf"\bJOIN\s+{_SQ}"]),
    ("sql", 1): ("WRITE", [rf"\bINSERT\s+INTO\s+{_SQ}", rf"\bUPDATE\s+{_SQ}", rf"\bMERGE\s+INTO\s+{_SQ}"]),
    ("sql", 2): ("CREATE", [rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{_SQ}"]),
    ("sql", 3): ("DROP", [rf"\bDROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?{_SQ}"]),
    ("sql", 4): ("WRITE", [rf"\bCOPY\s+{_SQ}\s+\(", rf"\bINTO\s+{_SQ}"]),
    ("python", 0): ("READ", [rf"\bFROM\s+{_PQ}", rf"\bJOIN\s+{_PQ}", r"read_sql\s*\(\s*[" + chr(34) + r"''].*?FROM\s+(" + _W + ")", rf"\.read[_.]table\s*\(\s*{_S}"]),
    ("python", 1): ("WRITE", [rf"\.to_sql\s*\(\s*{_S}", rf"\.insertInto\s*\(\s*{_S}", rf"\.saveAsTable\s*\(\s*{_S}", rf"\bINSERT\s+INTO\s+({_W})"]),
    ("shell", 0): ("READ", [rf"\bCOPY\s+({_W})\s*\(", rf"\bFROM\s+({_W})", rf"\bINTO\s+({_W})", rf"\bSELECT\s+COUNT\(\*\)\s+FROM\s+({_W})"]),
}
SHELL_WRITES = {("shell", 0): ("READ", [FOUND["shell", 0][1][1], FOUND["shell", 0][1][3]]), ("shell", 1): ("WRITE", [FOUND["shell", 0][1][0], FOUND["shell", 0][1][2]])}


def _found(found: dict, text: str = "raw_text", key: str = "chunk_id", source: str = "chunks", gate: bool = True) -> str:
    parts = []
    for (kind, family), (ref_type, patterns) in found.items():
        for p, pattern in enumerate(patterns):
            where = f"WHERE file_type = '{kind}' AND length({_strip('raw_text')}) >= 10" if gate else ""
            parts.append(
                f"SELECT {key}, {family * 10 + p} AS pat, '{ref_type}' AS ref_type, unnest(hits) AS raw, generate_subscripts(hits, 1) AS pos "
                f"FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}', 1, 'i') AS hits FROM {source} {where}) AS h"
            )
    return " UNION ALL ".join(parts)


def _named(found: str, key: str = "chunk_id") -> str:
    return f"""SELECT * FROM (SELECT {key}, pat, ref_type, pos, {CLEAN} AS name FROM ({found}) AS f) AS g
WHERE length(name) >= 2 AND NOT regexp_matches(name, '^\\d+$') AND name NOT IN ({STOP})"""


def _deduped(named: str) -> str:
    return f"""
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY first_at) - 1 AS ord, raw, ref_type FROM (
  SELECT chunk_id, name AS raw, min(pat * 1000000 + pos) AS first_at,
    coalesce(arg_max(ref_type, pat * 1000000 + pos) FILTER (ref_type <> 'READ'), 'READ') AS ref_type
  FROM ({named}) AS n GROUP BY chunk_id, name) AS d"""


CTES["refs"] = _deduped(_named(_found(FOUND)))
CTES["aliased"] = f"SELECT r.*, {CANONICAL} AS canonical, c.file_path, c.line_start FROM refs r JOIN chunks c USING (chunk_id)"
CTES["chunk_lists"] = """
SELECT c.*, coalesce(tables, []) AS canonical_tables, coalesce(names, []) AS aliases_used, coalesce(ops, []) AS operations
FROM chunks c LEFT JOIN (
  SELECT chunk_id, list(canonical ORDER BY ord) FILTER (new_table) AS tables, list(raw ORDER BY ord) FILTER (raw <> canonical) AS names,
    list(ref_type ORDER BY ord) FILTER (new_op) AS ops
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, canonical ORDER BY ord) = 1 AS new_table,
          row_number() OVER (PARTITION BY chunk_id, ref_type ORDER BY ord) = 1 AS new_op FROM aliased) AS a
  GROUP BY chunk_id) AS l USING (chunk_id)"""
CTES["docs"] = f"""
SELECT *, '[CODE]' || {NL} || raw_text || {NL} || {NL} || '[ENTITIES]' || {NL}
  || CASE WHEN len(canonical_tables) > 0 THEN 'Tables referenced: ' || array_to_string(canonical_tables, ', ') || {NL} ELSE '' END
  || CASE WHEN len(aliases_used) > 0 THEN 'Aliases used in code: ' || array_to_string(aliases_used, ', ') || {NL} ELSE '' END
  || CASE WHEN len(operations) > 0 THEN 'Operations: ' || array_to_string(operations, ', ') || {NL} ELSE '' END
  || 'File: ' || file_path || ', lines ' || line_start || '-' || line_end || {NL}
  || 'Language: ' || file_type || ', block type: ' || chunk_type AS embedding_text
FROM chunk_lists"""

# --- Registry and search ------------------------------------------------------

CTES["names"] = "SELECT DISTINCT canonical, alias FROM (SELECT canonical, raw AS alias FROM aliased UNION ALL SELECT canonical, canonical FROM aliased) AS n"
CTES["newest"] = """
SELECT alias, arg_max(canonical, place) AS canonical FROM (
  SELECT raw AS alias, canonical, (file_path, line_start, ord) AS place FROM aliased
  UNION ALL SELECT canonical, canonical, (file_path, line_start, ord) FROM aliased) AS n GROUP BY alias"""
CTES["asked"] = f"WITH t AS ({target_names_sql('orders')}) SELECT query FROM t UNION ALL SELECT 'unknown_' || count(*) FROM t"
CTES["resolved"] = f"""
SELECT a.query, coalesce(n.canonical, {_strip('lower(a.query)')}) AS canonical
FROM asked a LEFT JOIN newest n ON n.alias = {_strip('lower(a.query)')}"""
CTES["expanded"] = "SELECT r.query, r.canonical, coalesce(n.alias, r.canonical) AS alias FROM resolved r LEFT JOIN names n USING (canonical)"
CTES["vec"] = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
CTES["chunk_vec"] = """
SELECT d.chunk_id, d.canonical_tables, v.v FROM docs d LEFT JOIN vec v
ON v.vec_id = CAST('0x' || substr(md5(d.chunk_id), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"""
CTES["semantic"] = f"""
SELECT query, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query, c.chunk_id, round(list_cosine_similarity(c.v, q.v), 12) AS score FROM chunk_vec c, (
      SELECT r.query, v.v FROM resolved r JOIN vec v
      ON v.vec_id = length(r.query || ' ' || r.canonical || ' table references') * 7 % (SELECT count(*) FROM embeddings)) AS q
    WHERE c.v IS NOT NULL) AS s) AS t
WHERE rank <= {2 * TOP_K}"""
CTES["named"] = f"""
SELECT query, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query, c.chunk_id, coalesce(round(list_cosine_similarity(c.v, q.v), 12), 0) AS score
    FROM chunk_vec c JOIN (
      SELECT r.query, r.canonical, v.v FROM resolved r LEFT JOIN vec v
      ON v.vec_id = length(r.canonical) * 3 % (SELECT count(*) FROM embeddings)) AS q
    ON list_contains(c.canonical_tables, q.canonical)) AS s) AS t
WHERE rank <= {2 * TOP_K}"""
CTES["words"] = r"""
SELECT query, term, count(*) AS times FROM (
  SELECT query, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}_]+')) AS term FROM (
    SELECT query, lower(query) AS name FROM expanded UNION SELECT query, canonical FROM expanded UNION SELECT query, alias FROM expanded) AS n) AS w
GROUP BY query, term"""


def _bm25(prefix: str, texts: str, key: str, words: str) -> None:
    CTES[f"{prefix}_toks"] = rf"SELECT {key}, regexp_extract_all(lower(txt), '[\p{{L}}\p{{N}}_]+') AS toks FROM ({texts}) AS x"
    CTES[f"{prefix}_tf"] = f"SELECT term, {key}, count(*) AS tf, max(dl) AS dl FROM (SELECT {key}, len(toks) AS dl, unnest(toks) AS term FROM {prefix}_toks) AS t GROUP BY term, {key}"
    CTES[f"{prefix}_stats"] = f"SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {prefix}_toks"
    CTES[f"{prefix}_raw"] = f"SELECT term, df, ln((SELECT n FROM {prefix}_stats) - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term) AS d"
    CTES[f"{prefix}_idf"] = f"SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {prefix}_raw) ELSE idf END AS idf FROM {prefix}_raw"
    CTES[f"{prefix}_scores"] = f"""
SELECT query, {key}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM {prefix}_stats)))) AS score
FROM ({words}) AS w JOIN {prefix}_idf USING (term) JOIN {prefix}_tf USING (term) GROUP BY query, {key}"""
    CTES[f"{prefix}_norm"] = f"""
SELECT query, {key}, share AS score FROM (
  SELECT *, score / CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN max(score) OVER (PARTITION BY query) ELSE 1 END AS share
  FROM {prefix}_scores) AS s WHERE share > 0.01"""


_bm25("c", "SELECT chunk_id, embedding_text AS txt FROM docs", "chunk_id", "SELECT * FROM words")
_bm25(
    "d",
    "SELECT doc_id, text AS txt FROM documents",
    "doc_id",
    r"SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) AS b GROUP BY item_id, term",
)
CTES["replied"] = "SELECT chunk_id, ord, raw, ref_type FROM refs WHERE ref_type <> 'DROP' AND chunk_id IN (SELECT chunk_id FROM chunks WHERE length(raw_text) % 6 < 2)"
CTES["pub_docs"] = """
SELECT chunk_id, CASE WHEN file_path LIKE '/repo/core/%' THEN 'rewritten' WHEN file_path LIKE '/repo/team3/%' THEN 'moved' ELSE chunk_type END AS chunk_type,
  CASE WHEN file_path LIKE '/repo/core/%' THEN 'rewritten ' WHEN file_path LIKE '/repo/team3/%' THEN 'moved ' ELSE '' END || embedding_text AS embedding_text
FROM docs"""
_bm25("p", "SELECT chunk_id, embedding_text AS txt FROM pub_docs", "chunk_id", "SELECT * FROM words")
# Hashed TF-IDF: a word's feature is in its MD5; a feature weighs by how many documents hold it.
CTES["v_words"] = r"""
SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents
UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) FROM benchmark"""
CTES["v_counts"] = """
SELECT kind, id, f, count(*) AS n FROM v_words JOIN (SELECT term, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS f FROM (SELECT DISTINCT term FROM v_words) AS t) AS h USING (term)
GROUP BY kind, id, f"""
CTES["v_idf"] = "SELECT f, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS w FROM v_counts WHERE kind = 'd' GROUP BY f"
CTES["v_unit"] = """
SELECT kind, id, f, x / sqrt(sum(x * x) OVER (PARTITION BY kind, id)) AS x FROM (
  SELECT kind, id, f, n * coalesce(w, ln((SELECT count(*) FROM documents) + 1)) AS x FROM v_counts LEFT JOIN v_idf USING (f)) AS v WHERE x > 0"""
CTES["v_near"] = """
SELECT q.id AS query, d.id AS doc_id, sum(q.x * d.x) AS score FROM v_unit q JOIN v_unit d USING (f) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY q.id, d.id"""
CTES["fused"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query, chunk_id, round(sum(part), 10) AS score FROM (
    SELECT query, chunk_id, 0.6 * score AS part FROM semantic UNION ALL SELECT query, chunk_id, 0.15 FROM named
    UNION ALL SELECT query, chunk_id, 0.25 * score FROM c_norm) AS p GROUP BY query, chunk_id) AS s) AS t WHERE rank <= {TOP_K}"""

# --- Results ------------------------------------------------------------------

CTES["listed"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hybrid_score DESC, chunk_id) AS rank FROM (
  SELECT r.query, r.canonical AS matched_canonical, d.*, round(1.0 / (length(raw_text) + line_start), 4) AS hybrid_score
  FROM docs d JOIN resolved r ON list_contains(d.canonical_tables, r.canonical)) AS l) AS m"""
CTES["results"] = """
SELECT *, CASE WHEN len(operations) > 0 THEN operations[1] ELSE 'UNKNOWN' END AS operation,
  CASE WHEN len(aliases_used) > 0 THEN 'alias' ELSE 'direct' END AS matched_via, hybrid_score AS final_score, rank AS place,
  list_extract(string_split(file_path, '/'), -1) AS file_name
FROM listed"""
CTES["judged"] = """
SELECT query, chunk_id,
  ((rank * 7) % 10) / 10.0 AS relevance_score,
  CASE WHEN rank % 3 > 0 THEN operation END AS operation,
  CASE WHEN rank % 2 > 0 THEN 'why ' || file_path END AS explanation,
  CASE WHEN rank % 5 > 0 THEN 'alias' END AS matched_via
FROM results WHERE rank <= 15 AND rank % 4 <> 0"""
CTES["edges"] = """
SELECT src, dst, arg_max(operation, (query, -final_score, chunk_id)) AS operation, arg_max(lines, (query, -final_score, chunk_id)) AS lines, arg_max(final_score, (query, -final_score, chunk_id)) AS score FROM (
  SELECT *, CASE WHEN operation IN ('WRITE', 'CREATE', 'INSERT', 'UPDATE', 'DELETE', 'DROP') THEN 'file:' || file_name ELSE 'table:' || matched_canonical END AS src,
    CASE WHEN operation IN ('WRITE', 'CREATE', 'INSERT', 'UPDATE', 'DELETE', 'DROP') THEN 'table:' || matched_canonical ELSE 'file:' || file_name END AS dst,
    line_start || '-' || line_end AS lines FROM results) AS e GROUP BY src, dst"""
CTES["nodes"] = """
SELECT DISTINCT 'table:' || matched_canonical AS id, 'table' AS node_type, matched_canonical AS label, CAST(NULL AS VARCHAR) AS full_path, CAST(NULL AS VARCHAR) AS file_type FROM results
UNION ALL
SELECT 'file:' || file_name, 'file', file_name, arg_min(file_path, (query, -final_score, chunk_id)), arg_min(file_type, (query, -final_score, chunk_id)) FROM results GROUP BY file_name"""


def _sql(final: str) -> str:
    """The CTEs a query needs, in order, and the query."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in CTES and name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [f"{name} AS MATERIALIZED ({body})" if name != "sh_states" else f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final


def _family_sql(family: int) -> str:
    return f"""SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY first_at) - 1 AS ord, name FROM (
      SELECT chunk_id, name, min(pat * 1000000 + pos) AS first_at FROM ({_named(_found({("sql", family): FOUND["sql", family]}))}) AS n GROUP BY chunk_id, name) AS d"""


def _chunk_rows(kind: str) -> str:
    return f"SELECT chunk_id, chunk_type, raw_text, line_start, line_end FROM chunks WHERE file_type = '{kind}'"


def _ref_rows(kind: str) -> str:
    return f"SELECT r.chunk_id, r.ord, r.raw, r.ref_type, 'medium' AS confidence FROM refs r JOIN chunks c USING (chunk_id) WHERE c.file_type = '{kind}'"


_PROSE = "SELECT doc_id, text || ' from ' || lang || ' join \"X\".[' || source || ']' AS txt FROM documents"
_PROSE_FOUND = _found({("sql", 0): FOUND["sql", 0]}, "txt", "doc_id", f"({_PROSE}) AS t", gate=False).replace(r"\b", r"(?:^|[^\p{L}\p{N}_])")
_PAIRS = """'(?s:\\$\\$.*?\\$\\$)|"[^"]*"|' || chr(39) || '[^' || chr(39) || ']*' || chr(39) || '|`[^`]*`'"""
_SEMI = f"""SELECT '/d/' || doc_id || '.sql' AS file_path, text || ' ; ;' || {NL} || {NL} || 'end' || CASE
  WHEN regexp_matches(regexp_replace(text, {_PAIRS}, '', 'g'), '["`' || chr(39) || ']') THEN '' ELSE chr(39) END AS source FROM documents"""
_OPEN = f"""SELECT '/d/' || doc_id || '.py' AS file_path, text || {NL} || '(' AS source FROM documents"""
_LISTING_NAMES = "SELECT query, array_to_string(list_sort(list(DISTINCT alias) FILTER (alias <> canonical)), ',') AS other_names FROM expanded GROUP BY query"

_FINAL: dict[str, str] = {
    "exclude_dirs": f"""SELECT file_path, substr(file_path, 7) AS rel_path FROM ({corpus_sql()}) AS c
        WHERE NOT list_has_any(string_split(substr(file_path, 7), '/'), ['archive', 'team3'])""",
    "ext_dispatch": "SELECT file_path, file_type FROM files",
    "folder_lists": f"""SELECT doc_id, array_to_string(f, '|') AS folders, len(f) AS n FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(' archive , ' || source || {NL} || {NL} || ', tmp' || doc_id || ',, ' || {NL}, '[,\\n]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS f
        FROM documents) AS t""",
    "sql_statements": _chunk_rows("sql"),
    "python_blocks": _chunk_rows("python"),
    "shell_groups": _chunk_rows("shell"),
    "semicolon_split": f"""
        SELECT file_path, 'statement' AS chunk_type, part AS raw_text, CAST(line_start AS BIGINT) AS line_start, CAST(line_start + {_lines('part')} AS BIGINT) AS line_end FROM (
          SELECT *, 1 + coalesce(sum({_lines('part')} + 2) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
          FROM (SELECT file_path, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
            SELECT file_path, list_filter(list_transform(string_split(source, ';'), lambda x: {_strip('x')}), lambda x: x <> '') AS parts FROM ({_SEMI}) AS d) AS p) AS q) AS r""",
    "line_blocks": f"""
        SELECT file_path, 'block' AS chunk_type, string_agg(line, {NL} ORDER BY i) AS raw_text, min(i) AS line_start, max(i) AS line_end FROM (
          SELECT file_path, unnest(string_split(source, {NL})) AS line, generate_subscripts(string_split(source, {NL}), 1) AS i FROM ({_OPEN}) AS d) AS l
        GROUP BY file_path, (i - 1) // 30""",
    "long_sql": "SELECT file_path, chunk_type, raw_text, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM ls_chunks",
    "python_faults": "SELECT file_path, fault FROM fp_faults",
    "faulty_blocks": "SELECT file_path, chunk_type, raw_text, line_start, line_end FROM fp_chunks",
    "chunk_captions": "SELECT chunk_id, '[' || upper(file_type) || '] ' || file_path || ' lines ' || line_start || '-' || line_end || ' (' || chunk_type || ')' AS caption FROM chunks",
    "tiny_chunks": f"SELECT chunk_id, raw_text FROM chunks WHERE length({_strip('raw_text')}) < 10",
    "chunk_type_counts": "SELECT file_type, chunk_type, count(*) AS n FROM chunks GROUP BY file_type, chunk_type",
    "refs_sql": _ref_rows("sql"),
    "refs_python": _ref_rows("python"),
    "refs_shell": _ref_rows("shell"),
    "refs_shell_writes": f"SELECT chunk_id, raw, ref_type FROM ({_deduped(_named(_found(SHELL_WRITES)))}) AS r",
    "refs_python_no_imports": "SELECT chunk_id, raw, ref_type FROM ("
    + _deduped(
        _named(
            _found(
                {k: v for k, v in FOUND.items() if k[0] == "python"},
                r"regexp_replace(raw_text, '(?m)^[ \t]*from[ \t]+\S+[ \t]+import(?:[ \t][^\n]*)?$', '', 'g')",
            )
        )
    )
    + ") AS r",
    "refs_sql_read": _family_sql(0),
    "refs_sql_write": _family_sql(1),
    "refs_sql_create": _family_sql(2),
    "refs_sql_drop": _family_sql(3),
    "refs_copy_into": _family_sql(4),
    "prose_refs": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) - 1 AS ord, name FROM (
        SELECT doc_id, name, min(pat * 1000000 + pos) AS first_at FROM ({_named(_PROSE_FOUND, 'doc_id')}) AS n GROUP BY doc_id, name) AS d""",
    "ident_clean": f"SELECT doc_id, {CLEAN} AS name FROM (SELECT doc_id, ' `' || lang || '`.\"' || source || chr(39) || '.[' || upper(CAST(doc_id AS VARCHAR)) || '_T] ' || {NL} AS raw FROM documents) AS t",
    "alias_rules": "SELECT raw, canonical, ref_type, count(*) AS n FROM aliased GROUP BY raw, canonical, ref_type",
    "alias_rules_by_table": "SELECT raw, canonical, ref_type, count(*) AS n FROM aliased GROUP BY raw, canonical, ref_type",
    "prompt_inputs": f"""SELECT chunk_id, md5('File: ' || file_path || {NL} || 'Type: ' || file_type || {NL} || 'Lines: ' || line_start || '-' || line_end
        || {NL} || {NL} || 'Code:' || {NL} || raw_text) AS prompt_md5 FROM chunks WHERE length({_strip('raw_text')}) >= 10""",
    "reply_parse": """SELECT chunk_id, ord, raw, CASE WHEN k < 2 AND ref_type <> 'DROP' THEN 'c_' || raw END AS canonical,
        CASE WHEN k < 2 THEN ref_type ELSE 'UNKNOWN' END AS ref_type, CASE WHEN k < 2 THEN 'high' ELSE 'low' END AS confidence
        FROM (SELECT r.*, length(c.raw_text) % 6 AS k FROM refs r JOIN chunks c USING (chunk_id)) AS t WHERE k IN (0, 1, 4)""",
    "reply_documents": """SELECT c.chunk_id, coalesce(tables, '') AS canonical_tables, coalesce(names, '') AS aliases_used, coalesce(ops, '') AS operations
        FROM chunks c
        LEFT JOIN (SELECT chunk_id, string_agg('c_' || raw, '|' ORDER BY ord) AS tables, string_agg(raw, '|' ORDER BY ord) AS names FROM replied GROUP BY chunk_id) AS n USING (chunk_id)
        LEFT JOIN (SELECT chunk_id, string_agg(ref_type, '|' ORDER BY first) AS ops FROM (
          SELECT chunk_id, ref_type, min(ord) AS first FROM replied GROUP BY chunk_id, ref_type) AS f GROUP BY chunk_id) AS o USING (chunk_id)""",
    "alias_registry": "SELECT canonical, alias FROM names",
    "alias_current": """SELECT alias, arg_max(canonical, place) AS canonical FROM (
        SELECT raw AS alias, moved AS canonical, place FROM m UNION ALL SELECT moved, moved, place FROM m) AS n GROUP BY alias""",
    "alias_resolve": "SELECT query, canonical FROM resolved",
    "alias_expand": "SELECT query, canonical, alias FROM expanded",
    "files_for_table": "SELECT DISTINCT r.query, r.canonical, a.file_path FROM resolved r JOIN aliased a USING (canonical)",
    "all_tables": "SELECT DISTINCT canonical FROM names",
    "registry_merge": """SELECT alias, canonical, name_count FROM (SELECT alias, coalesce(n.canonical, o.alias) AS canonical FROM (SELECT DISTINCT raw AS alias FROM refs) AS o FULL JOIN newest n USING (alias)) AS c
        JOIN (SELECT canonical, count(*) AS name_count FROM (SELECT canonical, alias FROM names UNION SELECT raw, raw FROM refs) AS u GROUP BY canonical) AS k USING (canonical)""",
    "registry_report": """SELECT canonical, coalesce(array_to_string(list_sort(list(alias) FILTER (alias <> canonical)), ', '), '') AS other_names,
        (SELECT count(DISTINCT file_path) FROM aliased a WHERE a.canonical = n.canonical) AS file_count FROM names n GROUP BY canonical""",
    "known_tables": """SELECT canonical, coalesce(array_to_string(list_sort(list(alias) FILTER (alias <> canonical)), ', '), '') AS other_names
        FROM names GROUP BY canonical ORDER BY canonical LIMIT 30""",
    "doc_entities": "SELECT chunk_id, array_to_string(canonical_tables, '|') AS canonical_tables, array_to_string(aliases_used, '|') AS aliases_used, array_to_string(operations, '|') AS operations FROM docs",
    "doc_text": "SELECT chunk_id, embedding_text FROM docs",
    "meta_codec": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '~' || source || '|x~' || text WHEN 1 THEN lang || '~' || source || '~z' WHEN 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS joined,
        CAST(CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents""",
    "code_recovery": f"SELECT chunk_id, {_strip('raw_text')} AS code FROM chunks",
    "upsert_by_key": """SELECT chunk_id, CASE WHEN chunk_id LIKE '/repo/core/%' THEN 'new ' || chunk_type ELSE chunk_type END AS chunk_type FROM chunks
        UNION ALL SELECT '/repo/new#' || count(*), 'new' FROM chunks""",
    "query_clean": f"SELECT doc_id, {_strip('t')} AS cleaned FROM (SELECT doc_id, regexp_replace(' ;' || text, '[^\\p{{L}}\\p{{N}}_\\s.-]', '', 'g') AS t FROM documents) AS c",
    "token_counts": r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) AS t GROUP BY term",
    "bm25_postings": "SELECT term, doc_id, tf, dl FROM d_tf",
    "bm25_terms": "SELECT term, df, round(idf, 6) AS idf FROM d_idf",
    "bm25_scores": "SELECT query, doc_id, round(score, 6) AS score FROM d_scores",
    "bm25_normalised": "SELECT query, doc_id, round(score, 6) AS score FROM d_norm",
    "bm25_topk": """SELECT query, doc_id, round(round(score, 8), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 8) DESC, doc_id) AS rank FROM d_scores) AS t WHERE rank <= 10""",
    "vector_topk": """SELECT query, vec_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
          SELECT q.query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) AS score FROM vec e, (SELECT CAST(label AS VARCHAR) AS query, arg_min(v, vec_id) AS v FROM vec GROUP BY label) AS q) AS s) AS t WHERE rank <= 20""",
    "table_filter": "SELECT query, chunk_id, round(score, 6) AS score, rank FROM named",
    "semantic_chunks": "SELECT query, chunk_id, round(score, 6) AS score, rank FROM semantic",
    "query_words": "SELECT query, term, times FROM words",
    "bm25_chunks": "SELECT query, chunk_id, round(score, 6) AS score FROM c_norm",
    "hybrid_topk": "SELECT query, rank, chunk_id, round(score, 4) AS hybrid_score FROM fused",
    "hybrid_hits": """SELECT f.query, f.rank, f.chunk_id, d.file_path, r.canonical AS matched_canonical,
        (SELECT array_to_string(list_sort(list(alias)), ',') FROM expanded e WHERE e.query = f.query) AS matched_aliases
        FROM fused f JOIN docs d USING (chunk_id) JOIN resolved r USING (query)""",
    "snippets": f"""SELECT query, rank - 1 AS pos, chunk_id, file_path AS file, line_start || '-' || line_end AS lines, file_type AS type, {_strip('raw_text')} AS code_excerpt
        FROM results WHERE rank <= 15""",
    "judgement_parse": "SELECT query, chunk_id, relevance_score, operation, explanation, matched_via FROM judged",
    "rerank_scores": """SELECT query, chunk_id, llm_score, operation, explanation, matched_via, final_score,
        row_number() OVER (PARTITION BY query ORDER BY final_score DESC, rank) AS place FROM (
          SELECT r.query, r.chunk_id, r.rank, coalesce(j.relevance_score, 0) AS llm_score, coalesce(j.operation, 'UNKNOWN') AS operation, coalesce(j.explanation, '') AS explanation,
            coalesce(j.matched_via, 'direct') AS matched_via, round(0.4 * hybrid_score + 0.6 * coalesce(j.relevance_score, 0), 4) AS final_score
          FROM results r LEFT JOIN judged j USING (query, chunk_id) WHERE r.rank <= 15) AS s WHERE llm_score >= 0.25""",
    "rerank_missing": """SELECT query, chunk_id, coalesce(j.operation, 'UNKNOWN') AS operation, coalesce(j.matched_via, 'direct') AS matched_via, round(0.4 * hybrid_score, 4) AS final_score
        FROM results r LEFT JOIN judged j USING (query, chunk_id) WHERE r.rank <= 15 AND coalesce(j.relevance_score, 0) = 0""",
    "fallback_rank": "SELECT query, chunk_id, operation, matched_via, final_score FROM results",
    "fallback_rank_per_table": """SELECT r.query, r.chunk_id, arg_min(a.ref_type, a.ord) AS operation, CASE WHEN bool_or(a.raw <> a.canonical) THEN 'alias' ELSE 'direct' END AS matched_via
        FROM results r JOIN aliased a ON a.chunk_id = r.chunk_id AND a.canonical = r.matched_canonical GROUP BY r.query, r.chunk_id""",
    "file_report": """SELECT query, max(file_name) AS script, array_to_string(list_sort(list(DISTINCT operation)), ' + ') AS operations,
        CASE WHEN bool_or(matched_via = 'alias') THEN 'alias' ELSE 'direct' END AS matched_via,
        CASE WHEN len(flatten(list(aliases_used))) = 0 THEN '—' ELSE array_to_string(list_sort(list_distinct(flatten(list(aliases_used)))), ', ') END AS aliases_used,
        round(max(final_score), 3) AS relevance_score, file_path AS full_path FROM results GROUP BY query, file_path""",
    "file_chunks": "SELECT query, file_path, string_agg(chunk_id, '|' ORDER BY line_start, final_score DESC, chunk_id) AS chunk_ids FROM results GROUP BY query, file_path",
    "script_count": f"""SELECT r.query, r.matched_canonical, coalesce(max(n.other_names), '') AS other_names, count(DISTINCT r.file_path) AS script_count
        FROM results r JOIN ({_LISTING_NAMES}) AS n USING (query) GROUP BY r.query, r.matched_canonical""",
    "chunk_detail": f"""SELECT query, file_path, chunk_id, operation, 'lines ' || line_start || '–' || line_end AS lines, '{settings.UNJUDGED_NOTE}' AS explanation,
        {_strip('raw_text')} AS code, CASE file_type WHEN 'shell' THEN 'bash' ELSE file_type END AS language FROM results""",
    "graph_nodes": "SELECT id, node_type, label, full_path, file_type FROM nodes",
    "graph_edges": "SELECT src, dst, operation, lines, score FROM edges",
    "graph_edges_by_path": """SELECT src, dst, operation, arg_max(lines, (query, -final_score, chunk_id)) AS lines, arg_max(final_score, (query, -final_score, chunk_id)) AS score FROM (
        SELECT *, CASE WHEN operation IN ('WRITE', 'CREATE', 'INSERT', 'UPDATE', 'DELETE', 'DROP') THEN 'file:' || file_path ELSE 'table:' || matched_canonical END AS src,
          CASE WHEN operation IN ('WRITE', 'CREATE', 'INSERT', 'UPDATE', 'DELETE', 'DROP') THEN 'table:' || matched_canonical ELSE 'file:' || file_path END AS dst,
          line_start || '-' || line_end AS lines FROM results) AS e GROUP BY src, dst, operation""",
    "graph_size": "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count",
    "lineage_summary": """SELECT CASE WHEN src LIKE 'table:%' THEN substr(src, 7) ELSE substr(dst, 7) END AS canonical, CASE WHEN src LIKE 'table:%' THEN 'READ' ELSE operation END AS operation,
        CASE WHEN src LIKE 'table:%' THEN substr(dst, 6) ELSE substr(src, 6) END || ' (lines ' || lines || ')' AS entry FROM edges""",
}
_FINAL |= {
    "published_documents": """SELECT chunk_type, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(embedding_text), 1, 8) AS BIGINT)) AS BIGINT) AS text_md5,
        (SELECT count(*) FROM chunks) AS total FROM pub_docs GROUP BY chunk_type""",
    "published_terms": "SELECT term, df, round(idf, 6) AS idf FROM p_idf",
    "published_scores": "SELECT query, chunk_id, round(score, 6) AS score FROM p_scores",
    "published_topk": """SELECT query, chunk_id, round(round(score, 8), 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 8) DESC, chunk_id) AS rank FROM p_scores) AS t WHERE rank <= 10""",
    "text_vector_topk": """SELECT query, doc_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc_id) AS rank FROM v_near) AS n WHERE rank <= 10""",
    "saved_registry": """SELECT alias, canonical, file_count FROM newest
        JOIN (SELECT canonical, count(DISTINCT file_path) AS file_count FROM aliased GROUP BY canonical) AS f USING (canonical)""",
    "exported_report": _FINAL["file_report"],
    "exported_graph": "SELECT src, dst, operation, operation || ' (lines ' || lines || ')' AS title FROM edges",
    "model_references": f"""SELECT raw, canonical, ref_type, confidence, count(*) AS n FROM (
        SELECT 'File: ' || file_path AS raw, 'file' AS canonical, 'READ' AS ref_type, 'high' AS confidence FROM chunks
        WHERE length({_strip('raw_text')}) >= 10 AND NOT contains(raw_text, 'COPY')
        UNION ALL SELECT r.raw, r.raw, r.ref_type, 'medium' FROM refs r JOIN chunks c USING (chunk_id)
        WHERE length({_strip('raw_text')}) >= 10 AND contains(c.raw_text, 'COPY')) AS m GROUP BY ALL""",
    "result_modes": f"""SELECT query, judged, operation, matched_via, count(*) AS n FROM (
        SELECT r.query, true AS judged, coalesce(j.operation, 'UNKNOWN') AS operation, coalesce(j.matched_via, 'direct') AS matched_via
        FROM results r LEFT JOIN judged j USING (query, chunk_id) WHERE r.rank <= 15 AND coalesce(j.relevance_score, 0) >= 0.25
        UNION ALL SELECT query, false, operation, matched_via FROM results WHERE rank <= {TOP_K}) AS b GROUP BY ALL""",
}
_FINAL["vector_topk_label_filter"] = _FINAL["vector_topk"].replace("FROM vec e, (", "FROM (SELECT * FROM vec WHERE label % 2 = 1) AS e, (")
_FINAL["vector_topk_cells"], _FINAL["table_filter_buckets"] = _FINAL["vector_topk"], _FINAL["table_filter"]
_FINAL["alias_current"] = _FINAL["alias_current"].replace(
    "FROM m ", "FROM (SELECT raw, CASE WHEN file_path LIKE '%/core/%' THEN canonical || '_core' ELSE canonical END AS moved, (file_path, line_start, ord) AS place FROM aliased) AS m "
).replace("FROM m)", "FROM (SELECT raw, CASE WHEN file_path LIKE '%/core/%' THEN canonical || '_core' ELSE canonical END AS moved, (file_path, line_start, ord) AS place FROM aliased) AS m)")

ORACLES = {name: _sql(final) for name, final in _FINAL.items()}
