"""Sentence, line, secret and decontamination operators against SQL and brute force."""

import hashlib
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from terroir.llm import decontaminate, lines, queries, secrets, sentences

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi. Omicron pi rho sigma tau upsilon. Phi chi psi omega."


def test_substring_dedup_matches_sql(spark):
    H.same(queries.op1_substring_dedup(spark, H.SF), H.oracle(sentences.ORACLE))


def test_substring_dedup_edges(spark):
    texts = [LONG, "Intro here. " + LONG, "", "No stop", "\n\n", LONG + " " + LONG, "word " * 20000]
    out = sentences.sentence_dedup(H.awkward(spark, texts)).collect()
    assert len(out) == len(texts) + 3
    got = {(r.doc_id, r.text) for r in out}
    assert (None, LONG) in got and (0, "") in got  # the first copy stays; a null id is the smallest
    assert (1, "Intro here. ") in got and (5, "") in got and (2, "") in got and (3, "No stop") in got and (4, "\n\n") in got
    assert any(r.doc_id is None and r.text is None and r.n_sentences == 0 for r in out)
    assert sentences.sentence_dedup(H.empty(spark)).count() == 0


def test_substring_dedup_finds_passages(spark):
    one = " ".join(f"w{i}" for i in range(60)) + "."           # one long sentence
    three = "Here are twenty words " + " ".join(f"a{i}" for i in range(20)) + ". " + " ".join(f"b{i}" for i in range(20)) + ". " + " ".join(f"c{i}" for i in range(20)) + "."
    texts = [f"Own text {i} begins. {p}\nOwn text {i} ends." for i in range(4) for p in (one, three)]
    out = {r.doc_id: r.text for r in sentences.sentence_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert one in out[0] and three in out[1]
    assert all(one not in t and three not in t and "Own text" in t for i, t in out.items() if i > 1)


def test_line_dedup_matches_sql(spark):
    H.same(queries.op3_line_dedup(spark, H.SF), H.oracle(lines.ORACLE))


def test_line_dedup_edges(spark):
    rows = [(i, f"menu\nown {i}\n menu \n\nlast", "h") for i in range(6)] + [(9, "menu\nother", None), (10, None, "h"), (11, "", "h"), (None, "menu", "h")]
    out = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[(0, "own 0\n")] == (5, 3)
    assert out[(9, "menu\nother")] == (2, 0)       # another host
    assert out[(10, None)] == (0, 0) and out[(11, "")] == (1, 0) and out[(None, "")] == (1, 1)
    assert lines.line_dedup(H.empty(spark)).count() == 0
    assert lines.line_dedup(H.awkward(spark, ["a"])).columns.count("n_lines") == 1
    clash = spark.createDataFrame([(i, "menu\nown", "h", 7, 8, 9, 10) for i in range(6)], "doc_id long, text string, source string, host int, key int, drop int, line int")
    assert [tuple(r) for r in lines.line_dedup(clash).filter("doc_id = 3").collect()] == [(3, "", "h", 7, 8, 9, 10, 2, 2)]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))


def test_secret_scan_matches_brute_force(spark):
    random = "qZ8vT1xK9bR4mW7nP2cL5hJ0"
    texts = ["é😀 password = 'abcdefgh1' x", "token: secret: abcdefgh12", "secret=token=abcdefgh12", "AKIAAKIA", "AKIA" + "A1" * 8,
             "0" * 31, "ab" * 16 + " " + "cd" * 20, f"key {random} end", "internationalization_of_the_things", "", "Passwd:short", "apikey=12345678 API_KEY = \"x/y+z_12\"",
             "word " * 30000 + "deadbeef" * 5] + [t for _, t, _ in H.documents()]
    found = secrets.digest(secrets.scan(H.awkward(spark, texts))).collect()
    assert len(found) == len(texts) + 3
    for r in found:
        text = texts[r.doc_id if r.doc_id is not None else 0]
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("markov"))
        if r.doc_id is None:
            continue
        assert base == base_spans(text), (r, text[:50])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    spans = {r.doc_id: r.spans for r in found}
    assert spans[7] == "markov:4:28" and spans[8] == ""
    assert secrets.scan(H.empty(spark)).count() == 0


def test_secret_sample_is_of_different_texts_without_a_match(spark):
    ordinary = [f"ordinary_identifier_{w}" for w in ("alpha", "beta", "gamma")]

    def sample(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return sorted(r.body for r in secrets.ordinary_texts(docs, secrets.base_and_tokens(docs), sample_docs=3).collect())

    assert sample([t for t in ordinary for _ in range(9)] + [f"password={w}bcdefgh" for w in "abcdefghijkl"]) == sample(ordinary) == sorted(ordinary)


def test_added_spans_find_random_tokens_and_leave_identifiers(spark):
    """Recall and precision of the added spans on planted tokens of either kind."""
    import base64
    import random
    import string
    import uuid

    rng = random.Random(8)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    planted = [pick(string.ascii_letters + string.digits, rng.randint(20, 40)) for _ in range(100)]
    planted += [base64.urlsafe_b64encode(rng.randbytes(24)).decode() for _ in range(60)] + [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(40)]
    words = [w for _, t, _ in H.documents() for w in re.findall("[A-Za-z]{4,}", t)][:4000]
    names = ["xmlHttpRequestFactoryImpl", "internationalization_of_the_things", "get-the-latest-version-number", "MAXIMUM_NUMBER_OF_RETRIES_ALLOWED", "AbstractSingletonProxyFactoryBean"]
    for i in range(195):
        some = [rng.choice(words) for _ in range(4)]
        names.append(["_".join(some).lower(), "-".join(some).lower(), "".join(w.title() for w in some), some[0].lower() + "".join(w.title() for w in some[1:])][i % 4])
    texts = [f"see {a} and {b} here" for a, b in zip(planted, names)] + [t for _, t, _ in H.documents()]
    spans = {r.doc_id: {s.found for s in r.spans or [] if s.name == "markov"} for r in
             secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = sum(p in spans[i] for i, p in enumerate(planted))
    wrong = sum(n in spans[i] for i, n in enumerate(names))
    assert caught >= 0.97 * len(planted) and wrong <= 0.02 * len(names), (caught, wrong)


def test_many_tokens_in_one_text(spark):
    import time

    text = " ".join(f"token_number_{i}_of_this_long_file" for i in range(40_000))
    began = time.perf_counter()
    assert len(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()) == 1
    assert time.perf_counter() - began < 60


def test_secret_scan_on_documents(spark):
    text = {i: t for i, t, _ in H.documents()}
    for r in queries.op5_secret_scan(spark, H.SF).collect():
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("markov"))
        assert base == base_spans(text[r.doc_id])


def test_decontaminate_matches_sql(spark):
    H.same(queries.op10_decontaminate(spark, H.SF), H.oracle(decontaminate.ORACLE))


def test_decontaminate_edges(spark):
    item = "One two THREE four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "Kurz É"), (3, None), (4, " .. "), (1, item)], "item_id long, text string")
    texts = ["zero one two three four five six seven eight nine ten eleven!", "..kurz--É", "kurz é", "one two three four five six seven eight nine", "",
             "two three four five six seven eight nine ten eleven " * 2, "filler " * 30000 + item]
    out = decontaminate.decontaminate(H.awkward(spark, texts), items)
    got = {r.doc_id: (r.n_words, r.n_hit, sorted({m.item for m in r.matches})) for r in out.collect() if r.doc_id is not None}
    assert got[0] == (12, 11, ["1"]) and got[1] == (2, 2, ["2"]) and got[2] == (2, 0, []) and got[3] == (9, 0, []) and got[4] == (0, 0, [])
    assert got[5] == (20, 20, ["1"]) and got[6] == (30011, 11, ["1"])
    assert out.count() == len(texts) + 3
    assert decontaminate.decontaminate(H.empty(spark), items).count() == 0
    none = decontaminate.decontaminate(H.awkward(spark, texts), items.limit(0)).agg({"n_hit": "sum"}).first()[0]
    assert none == 0


def test_columns_with_inner_names(spark):
    """Columns of the input may be called as the operators' own; they come out as they were."""
    from terroir.llm import jaccard

    names = ["_id", "_k", "_key", "_v", "_version", "_c", "_p", "_all", "_kept", "_cover", "_runs", "wanted", "id", "a"]
    docs = spark.createDataFrame([(i, LONG, *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    for out in (sentences.sentence_dedup(docs), decontaminate.decontaminate(docs, items)):
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert sorted(r.n_removed for r in sentences.sentence_dedup(docs).collect()) == [0, 3, 3]
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items).collect()} == {10}
    assert {r.component_id for r in jaccard.jaccard_join(docs).collect()} == {0}


def test_proximity(spark):
    items = spark.createDataFrame([(1, "a b c d rare f g h i scarce")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d rare f g h i scarce"), (2, "a b c d rare f g h scarce a b c d f g h i i i")], "doc_id long, text string")
    windows = decontaminate.windows_of(items)
    postings, chosen = decontaminate.build_index(docs, windows)
    near = {(r.id, r.shift) for r in decontaminate.near_matches(postings, chosen, 2).collect()}
    assert near == {(1, 0), (2, -1)}


def test_among_flags_all_keys_and_few_others(spark):
    from pyspark.sql import functions as F
    from terroir.llm._arrow import among
    docs = spark.range(4000).select(F.when(F.col("id") < 3990, F.struct(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("version")))
                                    .otherwise(F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("version"))).alias("row"), F.lit("t").alias("_word"))
    keys = docs.filter("row.version % 10 = 0").select("row")
    got = among(docs, F.col("row"), keys, "flag")
    assert got.columns == ["row", "_word", "flag"] and got.count() == 4000
    assert got.filter("flag is null").count() == 0
    assert got.join(keys, "row", "left_semi").filter("not flag").count() == 0
    assert got.filter("flag").count() < 0.2 * 4000
    assert among(docs, F.col("row"), keys.limit(0), "flag").filter("flag").count() == 0


def test_near_duplicates_shuffles_no_texts_without_copies(spark, tmp_path):
    """Long texts, no copies: what the stage shuffles are tokens and keys, no column of texts."""
    import corpus_pipeline as c
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(40)] + [(40, "a b c d e f g", "en", "s", 1)] * 3 + [(None, "a b c d e f g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    out = c.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in out.collect()) == [(False, None)] + [(True, i) for i in range(40)]
    sides = out._jdf.queryExecution().optimizedPlan()
    assert sides.nodeName() == "Union" or "Union" in sides.toString()
