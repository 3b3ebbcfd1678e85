"""Language, quality, similarity, token and HTML operators against brute force and libraries."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from terroir.llm import html_text, jaccard, language, order, pieces, quality, queries
from terroir.llm.components import connected_components


def test_language_held_out_accuracy(spark):
    truth = {i: lang for i, _, lang in H.documents("/root/testdata/sf0.01")}
    rows = [r for r in queries.op2_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_phrases_match_naive_parsing():
    rng = random.Random(5)
    sample = [(lang, "".join(rng.choice(a) for _ in range(300))) for lang, a in (("x", "abc d"), ("y", "bcde f")) for _ in range(3)]
    model = language.Model(sample)
    texts = ["", "a", "z", "Abc  ABC, dd!", "".join(rng.choice("abcdefz ") for _ in range(1500))]
    block = 64
    got = model.phrases(np.array([ord(c) for t in texts for c in t], np.uint32), np.cumsum([0] + [len(t) for t in texts]), block)[2]
    for k, lang in enumerate(model.languages):
        learned = [language.normalised(t) for x, t in sample if x == lang]
        for i, t in enumerate(texts):
            flat = "".join(c.lower() if c.isalpha() else " " for c in t)
            flat = "".join(c for j, c in enumerate(flat) if not (c == " " and j and flat[j - 1] == " "))
            count = 0
            for b in range(0, len(flat), block):
                part, at = flat[b:b + block], 0
                while at < len(part):
                    n = 1
                    while at + n <= len(part) and any(part[at:at + n] in x for x in learned):
                        n += 1
                    at += max(1, n - 1)
                    count += 1
            assert got[k][i] == count, (lang, t[:30])


def test_language_edges(spark):
    docs = H.awkward(spark, ["the cat and the dog went home", "", "12 -- 34", "the dog " * 20000])
    out = language.language_id(docs, [("en", "the cat and the dog"), ("xx", "qq ww zz")]).collect()
    assert len(out) == 7
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[0][0] == got[3][0] == "en" and got[1] == got[2] == ("und", 0.0)
    assert {r.lang_pred for r in language.language_id(docs, []).collect()} == {"und"}
    assert language.language_id(H.empty(spark), []).count() == 0
    assert language.labelled_sample(H.empty(spark)) == []
    copies = spark.createDataFrame([(1, "one text", "en")] * 200 + [(2, "deux", "fr")], "doc_id long, text string, lang string")
    assert language.labelled_sample(copies, rows=4) == [("en", "one text"), ("fr", "deux")]


def test_quality_matches_brute_force(spark):
    texts = [t for _, t, _ in H.documents()] + [None, "", " \n ", "a\nb\na\n\n\x0b\na", "x y " * 50, "é<>|" * 30]
    out = quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == H.base_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_compression_bands(spark):
    rng = random.Random(3)
    plain = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(900))
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9)) for _ in range(900))
    rising = " ".join(f"{i:07d}aaaaaaaaaaaaaaaaaaaaaaaa" for i in range(900))
    out = {r.doc_id: r for r in quality.quality_rules(H.awkward(spark, [plain, noise, rising])).collect()}
    assert out[0].kept and not out[1].kept and not out[2].kept
    assert not out[1].base_failed and not out[2].base_failed and out[0].n_chunks == 2
    assert quality.quality_rules(H.empty(spark)).count() == 0


def near_copies(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    out = [None, "", "one", "One", "one two", "  one  two "]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 30, 120)))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_matches_brute_force(spark, width, percent):
    texts = near_copies(60)
    component, links = H.jaccard_components([H.shingles(t, width) for t in texts], percent)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, need int")
    out = {r.doc_id: r for r in jaccard.jaccard_join(docs, width=width, percent=percent).collect()}
    assert len(out) == len(texts)
    assert [out[i].component_id for i in range(len(texts))] == component
    assert [out[i].n_links for i in range(len(texts))] == links
    assert [out[i].n_shingles for i in range(len(texts))] == [len(H.shingles(t, width)) for t in texts]


def test_jaccard_edges(spark):
    out = jaccard.jaccard_join(H.awkward(spark, ["a b c d", "A  b c d", "", "x " * 50000])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.n_links) for r in out) == [
        (-1, -1, 0), (-1, 0, 3), (0, 0, 3), (0, 0, 3), (1, 0, 3), (2, 2, 0), (3, 3, 0)]
    assert jaccard.jaccard_join(H.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    out = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(queries.PIECE_MODEL)


def test_pieces_match_the_library(model):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = random.Random(1)
    texts = ["", " ", "  a\n\nb  c ", "x\x00y", "▁", "ﬁ①　x​日本語", "   " * 20 + "q", "aaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(rng.choice("abcdetnors THEi.\n,é日😀▁") for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    texts += [t for _, t, _ in H.documents()]
    encoder = pieces.Encoder(model)
    for half in (texts[:500], texts[500:]):  # the second with a cache
        ids, at = encoder.encode([t.encode() for t in half])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == lib.encode(half)
        assert pieces.decode_ids(model, ids.astype(np.int64), at) == [t.replace("▁", " ") for t in half]


def test_pieces_tables(spark, model):
    docs = H.awkward(spark, ["hello world", "", "a\nb  c", "longword" * 3000])
    coded = pieces.encode(docs, model)
    back = pieces.decode(coded, model).collect()
    assert len(back) == 7 and all(r.text == r.decoded for r in back)
    assert [r.ids for r in back if r.text is None] == [None] and [r.ids for r in back if r.text == ""] == [[]]
    assert pieces.encode(H.empty(spark), model).count() == 0
    tried = pieces.round_trip(docs, model).collect()
    assert all(r.exact for r in tried if r.ids is not None) and all(r.n_tokens == len(r.ids or []) for r in tried)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 1000, 4097):
        slots = order.feistel(np.arange(n), n, 11)
        assert sorted(slots) == list(range(n))
        assert (order.feistel(slots, n, 11, inverse=True) == np.arange(n)).all()
    assert (order.feistel(np.arange(1000), 1000, 1) != order.feistel(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip(spark):
    texts = [t for _, t, _ in H.documents()] + [None, "", "é" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = order.materialise(order.sequences_of_texts(docs, length=100), seed=5, length=100, shard_size=64)
    rows = order.read_from(shards).collect()
    n = sum(-(-len((t or "").encode()) // 100) for t in texts)
    assert sorted(r.slot for r in rows) == list(range(n))
    parts = {}
    for r in rows:
        parts.setdefault(r.key, {})[r.part] = (bytes(r.ids), r.last)
    for i, t in enumerate(texts):
        mine = parts.get(i, {})
        assert b"".join(mine[k][0] for k in sorted(mine)) == (t or "").encode()
        assert [mine[k][1] for k in sorted(mine)] == [False] * (len(mine) - 1) + [True] * bool(mine)
    later = order.read_from(shards, slot=n - 70).collect()
    assert sorted(r.slot for r in later) == list(range(n - 70, n))
    assert order.materialise(order.sequences_of_texts(H.empty(spark))).count() == 0


def test_training_order_of_ids(spark):
    rows = spark.createDataFrame([("a", [1, 70000, 3]), ("b", None), ("c", [5])], "k string, ids array<int>")
    shards = order.materialise(order.sequences_of_ids(rows, "k", length=2, width=4), "k", length=2, width=4)
    got = sorted((r.key, r.part, r.last, r.ids) for r in order.read_from(shards, width=4).collect())
    assert got == [("a", 0, False, [1, 70000]), ("a", 1, True, [3]), ("c", 0, True, [5])]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><div class="cookie-notice"><div>We use cookies</div> a lot</div>
%s
<aside>side</aside><form><input name=q>search</form><div id="comments"><article class="comment"><p>first!</p></article></div><footer>&copy; us</footer></body></html>"""


def test_html_extraction():
    body = "<h1>Head &amp; tail</h1><p>One\n <b>two</b>&nbsp;three<br>four<p>Five <!-- x --><script>no()</script>six<div class='ad'>buy</div><ul><li>7<li>8</ul>"
    text = "Head & tail\nOne two three four\nFive six\n7\n8"
    assert html_text.main_text(PAGE % f"<article>{body}</article>") == text
    assert html_text.main_text(PAGE % f"<form><main>{body}</main></form>") == text
    assert html_text.main_text(PAGE % f"<div>{body}</div>") == text
    assert html_text.main_text("") == "" and html_text.main_text("<nav>x</nav>") == "" and html_text.main_text("plain < text") == "plain < text"
    assert html_text.main_text("<p>a" * 3000).count("\n") == 2999
    assert html_text.main_text('<p title="a>b">x</p><div class="ad">never closed <article><p>kept</article>') == "kept"


BODY = "A long sentence of the body text goes on and on. " * 5


def test_html_marks_are_evidence_only():
    body = BODY.strip()
    for start in ("<div id=page class='has-sidebar'>", "<div class='content menu-open'>", "<div class=sidebar>", "<form>"):
        assert html_text.main_text(f"{start}<p>{BODY}</p></{start[1:5].strip()}>") == body
    parts = f"<p>{BODY}<section id=discussion><p>{BODY}</section><div class=related-work>{BODY}</div><h2 id=notice>Notice</h2><p>{BODY}"
    assert html_text.main_text(f"<article>{parts}</article>") == "\n".join([body, body, body, "Notice", body])
    assert html_text.main_text(f"<article><p class=ad>buy<p>{BODY}<ul><li class=share>share<li>kept</ul><p>{BODY}</article>") == "\n".join([body, "kept", body])
    assert html_text.main_text("<nav>" * 2000 + "<div class=ad>" * 2000 + "x") == ""


def test_html_lines_decide():
    body = BODY.strip()
    menu = "<ul>" + "".join(f"<li><a href=x>Menu {k}</a></li>" for k in range(5)) + "</ul>"
    assert html_text.main_text(f"<aside><article>teaser</article></aside><div><p>{BODY}<p>{BODY}</div>") == f"{body}\n{body}"
    assert html_text.main_text(f"{menu}<div><p>{BODY}</p><aside>x</aside><p>The end.</p></div>{menu}") == f"{body}\nThe end."
    assert html_text.main_text(f"<article>{BODY}</article><article>teaser</article>") == body
    assert html_text.main_text(f"<article>{BODY}</article><article>{BODY}</article>") == f"{body}\n{body}"


def test_line_blocks():
    assert html_text.line_blocks([0, 5, 6, 0, 0, 0, 200, 3, 0, 0, 0, 4], 3, 100) == [(6, 8)]
    assert html_text.line_blocks([150, 0, 0, 0, 300], 3, 100) == [(0, 1), (4, 5)]
    assert html_text.line_blocks([0, 0], 3, 100) == []


def test_html_table(spark):
    rows = [(1, "u", PAGE % "<article><p>é x</p></article>"), (1, "u", PAGE % "<article><p>é x</p></article>"), (None, None, None), (2, "v", "")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "é x", 3), (1, "é x", 3), (2, "", 0)]
