import math
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from conftest import table

from tabletrail.llm import (
    compact_windows, containment, html_text, language_model, near_copies, packing, quality, queries, repeats, suffix_arrays, token_counts, toxicity, words,
)
from tabletrail.llm.components import components

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- Words and suffix arrays ---------------------------------------------------


def test_words_and_shingles_agree_with_plain_ones(texts):
    import pyarrow as pa

    column = pa.array(list(texts.values()))
    for limit in (50, 1 << 20):
        at = 0
        for part in words.slices(column, limit):
            found, whole = words.words_of(part), words.shingles_of(words.words_of(part))
            for i in range(len(part)):
                text = list(texts.values())[at + i]
                assert found.counts[i] == len(plain.words(text))
                assert len(set(whole.hashes[whole.first[i] : whole.first[i + 1]].tolist())) == len(plain.shingles(text))
            at += len(part)
        assert at == len(texts)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(150):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0)
        array = suffix_arrays.suffix_array(s)
        assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = suffix_arrays.permuted_prefixes(s, array, suffix_arrays.symbol_codes(s))
        for before, i in zip(array, array[1:], strict=False):
            most = min(len(s) - i, len(s) - before)
            assert shared[i] == next((k for k in range(most) if s[i + k] != s[before + k]), most)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *[(100, 100 + i) for i in range(1, 50)], *[(i, i + 1) for i in range(200, 240)]]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | dict.fromkeys(range(100, 150), 100) | dict.fromkeys(range(200, 241), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- The ten operators -----------------------------------------------------------


def test_passages_cover_every_shared_run_and_nothing_else(docs, texts):
    found = compact_windows.passages(docs).collect()
    tokens = {i: plain.words(plain.lower(t)) for i, t in texts.items()}
    covered = {}
    for r in found:
        for i, start, n in ((r["doc_id"], r["start_word"], r["n_words"]), (r["first_doc_id"], r["first_start_word"], r["first_n_words"])):
            covered.setdefault(i, []).append((start, start + n))
        a, b = (plain.shingles(" ".join(tokens[i][s : s + n])) for i, s, n in ((r["doc_id"], r["start_word"], r["n_words"]), (r["first_doc_id"], r["first_start_word"], r["first_n_words"])))
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    first = {}
    for i in sorted(tokens):
        for p in range(len(tokens[i]) - 49):
            run = tuple(tokens[i][p : p + 50])
            if first.setdefault(run, i) != i:
                assert any(a <= p + 2 and p + 48 <= b for a, b in covered.get(i, [])), (i, p)
    assert not any(r["doc_id"] in range(40, 60) for r in found)


def drift_texts():
    """Versions of a text, each near the one before it only; each changes what an earlier one did not."""
    import random

    from conftest import sentence

    rng = random.Random(11)
    words, out = sentence(rng, 80).split(" "), {}
    order = rng.sample(range(80), 80)
    for i in range(40):
        out[1000 + i] = " ".join(words)
        words = list(words)
        words[order[i]] = f"changed{i}"
    return out


def sentence_texts():
    """Copies of passages around sentences that very many unrelated documents hold too."""
    import random

    from conftest import sentence

    rng = random.Random(12)
    common = [sentence(rng, 24) for _ in range(2)]
    out = {i: " ".join([sentence(rng, 30), common[0], sentence(rng, 20), common[1], sentence(rng, 30)]) for i in range(1, 61)}
    for i in range(20):
        passage = " ".join([sentence(rng, 8), common[0], sentence(rng, 8), common[1], sentence(rng, 8)])
        for k in (0, 1):
            out[100 + 2 * i + k] = " ".join([sentence(rng, 30), passage, sentence(rng, 30)])
    return out


def test_drifting_versions_meet(spark):
    texts = drift_texts()
    found = {(r["first_doc_id"], r["doc_id"]) for r in compact_windows.passages(table(spark, texts)).collect()}
    sets = {i: plain.shingles(t) for i, t in texts.items()}
    near = [(i, i + 1) for i in sorted(texts)[:-1] if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    groups, expected = ({r["node"]: r["component"] for r in components(spark.createDataFrame(sorted(e), "a long, b long")).collect()} for e in (found, near))
    assert len(near) > 30 and all(groups.get(a) == groups.get(b) is not None for a, b in near)
    assert set(expected) <= set(groups)


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_around_common_sentences_meet(spark, parts):
    found = {(r["first_doc_id"], r["doc_id"]) for r in compact_windows.passages(table(spark, sentence_texts(), parts)).collect()}
    assert found == {(100 + 2 * i, 101 + 2 * i) for i in range(20)}


def test_kneser_ney_against_plain(docs, texts):
    got = by_id(language_model.scored(docs))
    tokens = {i: [*plain.words(plain.lower(t)), "</s>"] for i, t in texts.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    single, n, size, p = plain.kneser_ney(train, language_model.discounts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(single[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(plain.log10_base(single[w], n, size) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False)))
    for context in ("an", "never seen", "<s>"):
        assert sum(p(context, w) for w in single) + p(context, "never seen") == pytest.approx(1)


def test_quality_counts_and_votes(docs, texts):
    got = by_id(quality.judged(docs))
    for i, t in texts.items():
        r = got[i]
        counts = plain.quality_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])
    assert all(got[i]["kept"] for i in (8, 20, *range(40, 60)))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_rules_learn_which_of_them_to_trust():
    """Two good rules and a noisy one: a lone vote of the noisy rule rejects nothing, the others' do."""
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    votes = np.stack([np.where(truth, 1, np.where(rng.random(len(truth)) < 0.9, -1, 1)), np.where(truth | (rng.random(len(truth)) < 0.2), 1, -1), np.where(rng.random(len(truth)) < 0.3, -1, 1)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    odds, weights = quality.estimate(patterns, n.astype(float))
    score = odds + (votes == -1) @ weights[:, 0] + (votes == 1) @ weights[:, 2]
    assert ((score > 0) == truth).mean() > 0.95


def test_main_text():
    page = """<html><head><title>no</title><script>var x="</p>";</script></head><body><header>site</header><nav><a href=1>m</a></nav>
      <div class="ad">buy</div><!-- c --><article><h1>A &amp; b</h1><p>First  long&nbsp;paragraph<br>of words.<p>Second <b>open <i>tags</p>
      <div class="comments"><p>me too</p></div><form>mail</form></article><aside>s</aside><footer>f</footer></body></html>"""
    assert html_text.main_text(page) == "A & b\nFirst long paragraph of words.\nSecond open tags"
    plain_page = "<body><div id='menu'><a>x</a><a>y</a></div><div><h2>T</h2><div><p>" + "long text here " * 9 + "</p><p>more text of the page</p></div></div><div class=cookie>ok</div></body>"
    assert html_text.main_text(plain_page) == "T\n" + ("long text here " * 9).strip() + "\nmore text of the page"
    wrapped = "<body><div class='page has-sidebar'><div class='sidebar'>links here</div><article><header class='entry-header'><h1>H</h1></header><p>" + "words of the text " * 9 + "</p></article></div></body>"
    assert html_text.main_text(wrapped) == "H\n" + ("words of the text " * 9).strip()
    for broken in ("", "<", "<p", "</p></p>", "<!-- open", "a < b", "<script>x", "<div>" * 3000 + "deep", "&bogus; &#65;"):
        html_text.main_text(broken)
    assert html_text.main_text("a < b &#65;") == "a < b A" and html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_names_do_not_empty_a_page():
    text = "words of the text " * 9
    expected = "H\n" + text.strip()
    for page in (
        f"<body><article class='node node--type-article node--promoted'><h1>H</h1><p>{text}</p></article><footer>f</footer></body>",
        f"<body><article class='post comment-open'><h1>H</h1><p>{text}</p></article></body>",
        f"<body><div class='page has-comments'><h1>H</h1><p>{text}</p><div class=comments><p>me too</p></div></div></body>",
        f"<body><section class='content with-banner'><div class=banner>buy</div><article><h1>H</h1><p>{text}</p></article></section></body>",
        f"<body><form action=x><div><h1>H</h1><p>{text}</p><form>mail</form></div></form></body>",
    ):
        assert html_text.main_text(page) == expected, page
    crowd = f"<div class=comments>{'<p>a comment that is long</p>' * 40}</div>"
    assert html_text.main_text(f"<body><article><h1>H</h1><p>{text}</p></article>{crowd}</body>") == expected
    assert html_text.main_text(f"<body><div><h1>H</h1><p>{text}</p></div>{crowd}</body>") == expected


def test_depth_changes_nothing():
    text, nested = "words of the text " * 9, "<div>" * 600 + "deep" + "</div>" * 600
    page = f"<body><div><article><h1>H</h1><p>{text}</p>{nested}<p>the rest</p></article></div></body>"
    assert html_text.main_text(page) == f"H\n{text.strip()}\ndeep\nthe rest"
    page = f"<body><article><h1>H</h1><p>{text}" + "<font>" * 600 + "<nav>menu</nav><p>the rest</p></article></body>"
    assert html_text.main_text(page) == f"H\n{text.strip()}\nthe rest"
    import time

    start = time.time()
    html_text.main_text("<div>" * 20_000 + "<p>deep</b></p>" * 20_000)
    assert time.time() - start < 10


def test_pages_table(spark):
    rows = [(1, "u", "<p>one</p>", "x"), (2, None, None, "x"), (1, "u", "<p>one</p>", "x"), (None, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extracted(pages).collect()} == {(1, "one", 3), (2, "", 0), (None, "", 0)}
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_near_copies_against_all_pairs(docs, texts):
    got = by_id(near_copies.linked(docs))
    expected = plain.near_components(texts)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    for i, t in texts.items():
        assert got[i]["n_shingles"] == len(plain.shingles(t)) and got[i]["kept"] == (expected[i] == i)
    kept = near_copies.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in expected.items() if c == i}


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    share = (1 - 2.0**-near_copies.BITS) * 0.85 + 2.0**-near_copies.BITS
    least = near_copies.HASHES * share - near_copies.SPREADS * (near_copies.HASHES * share * (1 - share)) ** 0.5
    agree = rng.binomial(near_copies.HASHES, share, 100_000)
    assert (agree < least).mean() < 1e-4
    unlike = rng.binomial(near_copies.HASHES, 2.0**-near_copies.BITS, 100_000)
    assert (unlike >= least).mean() < 1e-4


def test_contained_items(spark, docs, texts):
    items = {1: texts[15], 2: " ".join(texts[20].split(" ")[1000:1030]), 3: "Two words", 4: "nowhere at all in any of the documents here", 5: None, 6: "", 7: texts[15]}
    half = texts[16].split(" ")
    items[8] = " ".join([*half[10:60], *["missing"] * 4])
    table_ = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, containment string")
    got = containment.contained(docs, table_).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in got} == plain.contained(texts, items)
    assert containment.contained(docs, table_.limit(0)).count() == 0 and containment.contained(docs.limit(0), table_).count() == 0


def test_token_counts_against_plain(docs, texts):
    vocabulary = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(token_counts.counted(docs, vocabulary))
    for i, t in texts.items():
        own = plain.words(t)
        if max(map(len, own), default=0) < 100:
            assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(own), sum(plain.unigram_tokens("▁" + w, vocabulary.scores, vocabulary.byte_score) for w in own))
    odd = ["▁" + w for w in ("日本", "áb", "\U0001f600", "zz", "zzz", "z")]
    order = sorted(w.encode() for w in odd)
    assert token_counts.count_sorted(order, vocabulary) == [plain.unigram_tokens(w.decode(), vocabulary.scores, vocabulary.byte_score) for w in order]


def test_packing_is_an_exact_round_trip(docs, texts):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, *queries.bpe_files()).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*encoder.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["tier"] and at & (at - 1) == 0 and at <= 1024


def test_fast_ids_equal_the_tokenizer_files():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = packing.Encoder(*queries.bpe_files())
    latin = st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(latin, st.text(max_size=30), latin.map(lambda t: t + "<|endoftext|>" + t)))
    def check(text):
        assert encoder.ids(text).tolist() == [*encoder.slow.encode(text, add_special_tokens=False).ids, 0]

    check()


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats_against_plain(docs, texts, crowd):
    got = by_id(repeats.summaries(docs, crowd))
    expected = plain.without_repeats(texts)
    for i in texts:
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == expected[i], i


def test_texts_without_repeats_keep_whole_characters(docs, texts):
    out = repeats.without_repeats(docs)
    assert out.schema == docs.schema
    got = by_id(out)
    expected = plain.without_repeats(texts)
    for i, t in texts.items():
        assert (got[i]["text"] is None) == (t is None)
        if t is not None:
            assert got[i]["n_chars"] == len(got[i]["text"])
            assert 0 <= len(got[i]["text"].encode()) - (expected[i][0] - expected[i][1]) <= 6 * max(expected[i][2], 1)


def test_toxicity_learns_words_and_keeps_the_fold_apart(spark):
    import random

    from conftest import sentence

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = sentence(rng, 60)
        if toxic:
            text = " ".join(w + (" brakluna" + rng.choice("abc") if j in (5, 20, 40) else "") for j, w in enumerate(text.split(" ")))
        rows.append((i, text, i * 2))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0), (1001, "", 0), (1002, "you idiot, you moron", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = by_id(toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(got) == len(rows)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.98
    assert 0 <= got[1000]["score"] == got[1001]["score"] < 0.5 and got[1001]["score"] < got[1002]["score"] <= 1
    unlabelled = by_id(toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert unlabelled[1002]["score"] > unlabelled[1001]["score"]


def test_grammar_takes_the_clause_into_account():
    grammar = toxicity.Grammar()
    other, insult, target, no, said = toxicity.OTHER, toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT

    def paths(*symbols):
        return grammar.clause(list(symbols), [1.0 if s == insult else 0.0 for s in symbols])[0]

    assert paths(other, insult) == [1, 0, 0, 0]
    assert paths(target, other, insult) == paths(insult, target) == [0, 1, 0, 0]
    assert paths(no, other, insult) == [0, 0, 1, 0] and paths(no, other, other, other, insult) == [1, 0, 0, 0]
    assert paths(said, target, insult) == [0, 0, 0, 1]


# --- Odd tables --------------------------------------------------------------------


def runs_on(docs, spark):
    """Every operator that reads documents, as (name, frame)."""
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    vocabulary = token_counts.Vocabulary.ranked(["▁", "a", "n"])
    return [
        ("passages", compact_windows.passages(docs)), ("scored", language_model.scored(docs)), ("judged", quality.judged(docs)), ("linked", near_copies.linked(docs)),
        ("contained", containment.contained(docs, items)), ("counted", token_counts.counted(docs, vocabulary)), ("packed", packing.pack(docs, *queries.bpe_files())),
        ("summaries", repeats.summaries(docs)), ("toxic", toxicity.scored(docs, labels)),
    ]


def test_empty_tables(spark, nothing):
    for name, frame in runs_on(nothing, spark):
        assert frame.count() == 0, name


def test_null_ids_and_repeated_rows(spark):
    rows = {1: "one two three four five six seven " * 20, 2: None}
    frame = table(spark, rows)
    twice = frame.union(frame).union(frame.selectExpr("cast(null as long) doc_id", *[f"`{c}`" for c in frame.columns[1:]]))
    for name, out in runs_on(twice, spark):
        found = out.collect()
        if name in ("scored", "judged", "linked", "counted", "summaries", "toxic"):
            assert len(found) == 6, name
    assert {r["n_removed"] for r in repeats.summaries(twice).collect() if r["doc_id"] is None} == {0}


# --- Registered queries ------------------------------------------------------------


def test_queries_cover_the_whole_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_kneser_ney", "op3_quality_rules", "op5_minhash_near_copies", "op7_token_counts", "op9_suffix_repeats", "op10_toxicity"):
        frame = queries.QUERIES[name](spark, SF)
        assert frame.select("doc_id").distinct().count() == frame.count() == n, name
    assert queries.QUERIES["op8_packing"](spark, SF).select("doc_id").distinct().count() == n
    assert queries.QUERIES["op4_html_text"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
