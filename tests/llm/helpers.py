"""Small tables and brute-force versions shared by the tests."""

import re
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, n_words string, n_lines string"


def awkward(spark, texts):
    """Documents of ``texts`` with null and repeated ids and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).df()


def same(frame, other, key="doc_id"):
    a, b = frame.toPandas(), other
    assert sorted(a.columns) == sorted(b.columns)
    a = a[sorted(a.columns)].sort_values(key).reset_index(drop=True)
    b = b[sorted(b.columns)].sort_values(key).reset_index(drop=True)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":   # a column of integers with nulls is one of floats
            x, y = x.astype(float), y.astype(float)
        assert (x.astype(str) == y.astype(str)).all(), c


def documents(sf=SF):
    return duckdb.connect().execute(f"select doc_id, text, lang from '{sf}/documents.parquet' order by doc_id").fetchall()


def words(text):
    return BLANK_WORD.findall(text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_components(sets, percent):
    """Component (smallest index) and number of links of every set."""
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], links


def base_rules(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside),
            len(w) < 20 or 100 * len(inside) > 30 * len(w))
