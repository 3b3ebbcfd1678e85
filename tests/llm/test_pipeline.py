"""The corpus pipeline against brute force, and its edges."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

import corpus_pipeline as P


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    kept = P.language_id(spark, docs, H.SF)
    lang = {i: x for i, _, x in H.documents()}
    rows = kept.collect()
    assert len(rows) == len(lang) and sum(r.lang == lang[r.doc_id] for r in rows) >= 0.98 * len(rows)
    kept = P.line_dedup(spark, kept, H.SF)
    texts = {r.doc_id: r.text for r in kept.collect()}
    kept = P.near_duplicates(spark, kept, H.SF)
    ids = sorted(texts)
    component, _ = H.jaccard_components([H.shingles(texts[i], 5) for i in ids], 80)
    stay = {r.doc_id for r in kept.collect()}
    assert len(stay) == len(set(component)) and len({component[ids.index(i)] for i in stay}) == len(stay)
    kept = P.decontaminate(spark, kept, H.SF)
    hit = {r for r in stay} - {r.doc_id for r in kept.collect()}
    assert hit == {i for i in stay if contaminated(texts[i])}
    out = P.sentencepiece(spark, kept, H.SF).collect()
    assert all(r.exact for r in out) and len(out) == len(stay) - len(hit)


def contaminated(text):
    import re

    import duckdb

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    if not hasattr(contaminated, "windows"):
        items = duckdb.connect().execute(f"select text from '{H.SF}/benchmark.parquet'").fetchall()
        items = [word.findall((t or "").translate(H.LOWER)) for t, in items]
        contaminated.windows = {tuple(w[i:i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
        contaminated.sizes = {len(w) for w in contaminated.windows}
    w = word.findall(text.translate(H.LOWER))
    return any(tuple(w[i:i + n]) in contaminated.windows for n in contaminated.sizes for i in range(len(w) - n + 1))


def test_pipeline_runs(spark):
    out = P.run(spark, H.SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "exact"] and out.filter("not exact").count() == 0


def test_pipeline_edges(spark):
    docs = H.awkward(spark, ["the cat and the dog went home again", "", "12", "the cat and the dog went home again", "the bird " * 20])
    for rows in (docs, H.empty(spark)):
        for name, stage in P.STAGES:
            rows = stage(spark, rows, H.SF)
            if name != "sentencepiece":
                assert rows.columns == P.COLUMNS
        count = rows.count()
    assert count == 0


def test_near_duplicates_keep_rows_with_null_ids(spark):
    rows = [(None, f"{w} " + " ".join(f"{w}{i}" for i in range(30)), None, None, 0) for w in "abc"] + [(1, None, None, None, 0), (2, "", None, None, 0)]
    out = P.near_duplicates(spark, spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long"), H.SF)
    assert sorted(str(r.text)[:1] for r in out.collect()) == ["", "N", "a", "b", "c"]


def test_language_id_learns_its_limits(spark):
    import random

    def prose(rng, words):
        return " ".join(rng.choice(words) for _ in range(60))

    def vocabulary(seed, heads, tails):
        rng = random.Random(seed)
        return ["".join(rng.choice(heads) + rng.choice(tails) for _ in range(rng.randint(1, 3))) for _ in range(400)]

    rng = random.Random(3)
    learned = vocabulary(1, "th wh st br nd sh".split(), "e o ing er ou".split())
    other = vocabulary(2, "gn rd tst hw bs ng".split(), "i eo oe rue uo".split())  # the same letters, not learned
    rare = [chr(0x4E00 + k) + chr(0x5E00 + 7 * k) for k in range(900)]             # few labels, a large alphabet
    rows = [(prose(rng, learned), "a") for _ in range(60)] + [(prose(rng, other), None) for _ in range(5)]
    rows += [(prose(rng, rare), "r") for _ in range(2)] + [(prose(rng, rare), None) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(rows)], docs_schema)
    kept = {r.doc_id: r.lang for r in P.language_id(spark, docs, H.SF).collect()}
    assert kept == {i: "a" for i in range(60)} | {i: "r" for i in range(65, 72)}


def test_line_dedup_counts_copies_once(spark):
    def text(name):
        return "\n".join(" ".join(f"{name}{k}x{j}" for j in range(12)) for k in range(5))

    copied = text("copy")
    near = [copied.replace(f"copy{k % 5}x5 ", f"other{k} ") for k in range(6)]
    texts = [copied] * 6 + near + [text(f"own{i}x") for i in range(20)]
    docs = spark.createDataFrame([(i, "common header line\n" + t, "en", "s", 0) for i, t in enumerate(texts)], docs_schema)
    cleaned = P.line_dedup(spark, docs, H.SF)
    assert {r.doc_id: r.text for r in cleaned.collect()} == dict(enumerate(texts))
    kept = P.near_duplicates(spark, cleaned, H.SF)
    assert {r.doc_id for r in kept.collect()} == {0, *range(12, 32)}


def test_pages_of_much_boilerplate_stay(spark):
    """200 common words and 18 own ones: alike by shingles, but different pages."""
    common = ["common%d " % k + " ".join(f"c{k}x{j}" for j in range(19)) for k in range(10)]
    own = [" ".join(f"own{i}x{j}" for j in range(18)) for i in range(30)]
    texts = ["\n".join([*common[:4], o, *common[4:]]) for o in own]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], docs_schema)
    cleaned = P.line_dedup(spark, docs, H.SF)
    assert {r.doc_id: r.text for r in cleaned.collect()} == dict(enumerate(own))
    assert P.near_duplicates(spark, cleaned, H.SF).count() == 30


def test_copies_among_pages_of_boilerplate(spark):
    """Copies of one page on such a source are still one page, and keep what is theirs."""
    common = ["common%d " % k + " ".join(f"c{k}x{j}" for j in range(19)) for k in range(6)]
    own = ["\n".join(" ".join(f"own{i}l{k}x{j}" for j in range(12)) for k in range(3)) for i in range(12)]
    article = [" ".join(f"art{k}x{j}" for j in range(15)) for k in range(6)]
    copies = [[line.replace(f"art{k}x7", f"new{n}") if k == n % 6 else line for k, line in enumerate(article)] for n in range(12)]
    texts = ["\n".join([*common, o]) for o in own] + ["\n".join([*common, *c]) for c in [article, *copies]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], docs_schema)
    cleaned = P.line_dedup(spark, docs, H.SF)
    assert {r.doc_id: r.text for r in cleaned.collect()} == dict(enumerate(own + ["\n".join(c) for c in [article, *copies]]))
    assert {r.doc_id for r in P.near_duplicates(spark, cleaned, H.SF).collect()} == set(range(13))


docs_schema = "doc_id long, text string, lang string, source string, n_chars long"
