"""Source mixing against SQL, a plain water filling and awkward tables."""

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from terroir.llm import mixing, queries


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit >= limit * sizes[s]}
        if not above:
            return out | {s: weight[s] * unit for s in free}
        for s in above:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= above
    return out


def test_mixing_matches_sql(spark):
    H.same(queries.op11_source_mixing(spark, H.SF), H.oracle(mixing.ORACLE))


def test_targets_match_water_filling(spark):
    for sizes in ({"b": 10, "a": 1000, None: 70, "é": 3, "z": 0, "Z": 500}, {None: 5}, {"a": 0, "b": 0}, {f"s{i}": 2 ** (i % 17) for i in range(60)}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        want = targets(sizes)
        assert set(got) == set(want)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)
        assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()), rel_tol=1e-12)


def test_mixing_edges(spark):
    texts = ["one two three", "", None, "a\tb c\x0bd", "word " * 30000, "x"]
    docs = H.awkward(spark, texts)
    rows = mixing.allot(docs).collect()
    assert len(rows) == docs.count()
    size = {0: 3, 1: 0, 2: 0, 3: 3, 4: 30000, 5: 1}   # U+00A0 parts no words
    for r in rows:
        assert r.size == (size[r.doc_id] if r.doc_id is not None else r.size)
        assert r.taken == r.size * r.copies and r.taken <= 2 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
    assert mixing.allot(H.empty(spark)).count() == 0 and mixing.emit(H.empty(spark)).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.allot(docs.repartition(7)).collect()))


def test_emitted_documents_are_the_allotted_ones(spark):
    docs = H.awkward(spark, [f"text {i} " * (i % 9 + 1) for i in range(300)]).withColumnRenamed("body", "copy")
    allotted = {}
    for r in mixing.allot(docs).collect():
        allotted[r.doc_id] = allotted.get(r.doc_id, 0) + r.copies
    out = mixing.emit(docs)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    emitted = {}
    for r in out.collect():
        emitted[r.doc_id] = emitted.get(r.doc_id, 0) + 1
    assert emitted == {k: v for k, v in allotted.items() if v}


def test_a_hot_group_of_repeated_rows_is_near_its_target(spark):
    """Half of the table is one row again and again; its source still comes near its target."""
    rows = [(1, "the same five words here", "b")] * 9000 + [(i + 2, "some other words", "abc"[i % 3]) for i in range(9000)]
    out = mixing.allot(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = {r.source: r for r in out.join(spark.createDataFrame([(i, s) for i, _, s in dict((r[0], r) for r in rows).values()], "doc_id long, source string"), "doc_id")
           .groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).withColumnsRenamed({"sum(taken)": "taken", "max(target)": "target", "count(1)": "n"}).collect()}
    assert sum(r.n for r in per.values()) == len(rows)
    for r in per.values():
        assert abs(r.taken - r.target) <= 0.01 * r.target
