import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest import COLUMNS, table

from tabletrail.llm import queries, secret_spans

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX = "0123456789abcdef"


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def credential_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ran", "ter", "lo", "mi", "stan", "de", "ku"]) for _ in range(4))
    key = lambda n, of=HEX: "".join(rng.choice(of) for _ in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prose = lambda n: " ".join(word() for _ in range(n))
    out = {i: prose(30) for i in range(1, 61)}
    out |= {i: f"{prose(8)} token = \"{key(40)}\" {prose(5)}" for i in range(61, 101)}
    out |= {i: f"{prose(8)} é {'AKIA' + key(16, upper)}, {prose(5)}" for i in range(101, 141)}
    out |= {
        141: None, 142: "", 143: "passwd:short secret = 'longenough1' API_KEY=x api-key=aaaaaaaaaa apikey: 'k+/_.=-9'",
        144: f"äöü {key(31)} {key(32)} AKIA12345678901 AKIA123456789012 x{key(40)}y", 145: f"token={key(40)}token={key(40)}",
        146: f"{prose(4)} {key(24)} {prose(4)}", 147: f"{prose(4)} AKIB{key(11, upper)} " + prose(4), 148: prose(20_000) + f" Token: {key(40)} " + prose(20_000),
        149: "TOKEN = \"\" token == abcdefgh1 token : : abcdefgh2", 150: "toſen=abcdefgh1 toKen=abcdefgh1", 151: "0" * 5000, 152: key(40), 153: key(40),
    }
    out[153] = out[152]
    return out


@pytest.fixture(scope="module")
def found(spark):
    return {r["doc_id"]: r for r in secret_spans.scanned(table(spark, credential_texts())).collect()}


def test_base_spans_agree_with_plain_ones(found):
    for i, text in credential_texts().items():
        base = plain_base(text)
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), i
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_runs_like_credentials_are_added_and_words_are_not(found):
    texts = credential_texts()
    assert found[146]["n_format"] == 1, "a hex run too short for the pattern"
    a, b = map(int, found[146]["spans"].split(":")[1:])
    assert re.fullmatch("[0-9a-f]{24}", texts[146][a:b])
    assert sum(found[i]["n_format"] for i in range(1, 61)) == 0
    assert found[148]["n_format"] == 0 and found[148]["n_assign"] == 1


def test_result_does_not_depend_on_partitions(spark, found):
    again = secret_spans.scanned(table(spark, credential_texts(), 2)).collect()
    assert {r["doc_id"]: r for r in again} == found
    rows = secret_spans.spans(table(spark, credential_texts())).collect()
    assert sorted((r["doc_id"], r["kind"], r["start"], r["end"]) for r in rows) == sorted(
        (i, s.split(":")[0], *map(int, s.split(":")[1:])) for i, r in found.items() for s in r["spans"].split(",") if s
    )
    assert all((r["ratio"] is not None) == (r["kind"] == "format") for r in rows)


def test_merged_automata_keep_the_counts_and_the_probabilities():
    rng = random.Random(5)
    values = [("ab" * (1 + int(rng.expovariate(0.4))) + rng.choice("xyz")).encode() for _ in range(800)]
    made = secret_spans.infer(values)
    assert len(made.log) < 8 < max(map(len, values)), "states of the loop are merged"
    assert np.allclose(np.exp(made.log).sum(axis=1), 1)

    def plain(value):
        state, total = 0, 0.0
        for c in value:
            s = secret_spans.SYMBOLS.index(c)
            total, state = total + made.log[state, s], made.next[state, s]
        return total + made.log[state, secret_spans.END]

    tried = [*values[:20], b"abababab", b"AKIA", b"q", b"x" * 300]
    data, starts, ends = secret_spans._joined(tried)
    assert secret_spans.likelihood(made, data, starts, ends).tolist() == pytest.approx([plain(v) for v in tried])
    per = lambda v: plain(v) / (len(v) + 1)
    assert per(b"ababababx") > made.usual - 1e-9 and per(b"bbbbbbbb") < made.usual
    # Without merging, frequencies are those of the values themselves.
    apart = secret_spans.infer([b"aaaaaaaa"] * 300 + [b"bbbbbbbb"] * 100)
    assert apart.log[0, secret_spans.SYMBOLS.index(b"a")] == pytest.approx(math.log(0.75), abs=0.01)


def test_the_sample_is_bounded_and_distinct(spark):
    rows = secret_spans.labelled(table(spark, credential_texts()), 10).collect()
    for kind in range(4):
        mine = [r["value"] for r in rows if r["kind"] == kind]
        assert len(mine) == len(set(mine)) == 10


def test_empty_tables_and_texts_without_credentials(spark):
    assert secret_spans.scanned(spark.createDataFrame([], COLUMNS)).count() == 0
    r = secret_spans.scanned(table(spark, {1: "some ordinary words", 2: None})).collect()
    assert {x["spans"] for x in r} == {""} and {x["base_sha256"] for x in r} == {hashlib.sha256(b"").hexdigest()}


def test_query_on_the_given_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_secret_spans"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(plain_base(texts[r["doc_id"]])).encode()).hexdigest()
