"""Prefix trie against SQL and a plain dictionary of prefixes."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from terroir.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth string, conv long"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    below, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]] += saved[p]
            leaves[p[:d]] += not children[p]
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], below[p],
             hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()}


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)


def test_trie_matches_sql(spark):
    H.same(queries.op13_prefix_trie(spark, H.SF).orderBy("conv_id", "depth"), H.oracle(prefix_trie.ORACLE), ["conv_id", "depth"])


def test_trie_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "long " * 40]))
            for c in (*range(0, 90, 3), 1000, 1004) for _ in range(rng.randrange(1, 8))]
    rows += [(None, 1, "user", "nobody"), rows[0], rows[0], (7, 0, "ab", ""), (8, 0, "a", "b")]
    df = table(spark, rows)
    assert found(prefix_trie.prefix_trie(df, rebuild=prefix_trie.with_shared_starts)) == trie(rebuilt(rows))
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert found(prefix_trie.prefix_trie(df)) == trie({c: [t[2:] for t in sorted(v)] for c, v in own.items()})


def test_trie_edges(spark, monkeypatch):
    assert prefix_trie.prefix_trie(table(spark, [(1, 0, "u", "x")]).limit(0), rebuild=prefix_trie.with_shared_starts).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 0, "u", "x")])).count() == 0
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "LIST_BLOCK", 8)
    # one long conversation, many equal ones, one that is a prefix of another, one turn only
    paths = {1: [("u", f"t{i}") for i in range(30)], 2: [("u", f"t{i}") for i in range(9)], 3: [("u", "t0")], **{c: [("u", "t0"), ("a", "same")] for c in range(10, 70)}}
    rows = [(c, i, *t) for c, p in paths.items() for i, t in enumerate(p)]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == trie(paths)
