"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of distinct word shingles; equal sets are one class.  A class is described by
set tokens: at a size level, the hash space is cut into m segments, more than the d elements that
the sets of a linked pair can differ in, so a linked pair has at least m - d segments in common;
the hash of a segment's content is a token.  Of these, at most as many as the class has empty
segments are empty; the rest are tokens that the pair shares.  Empty segments are tokens
only of classes with m - d of them or more (then both sides of a pair that needs them have them).
A class has the tokens of its own size level and of the level below, which covers all sizes a
link allows.

* Partition: classes that share tokens are put into groups around the smallest class that
  they share one with.  Every class is in exactly one group.
* Matrix: the union of its members' tokens is stored for each group.
* Bound: a class with a link into a group has m - d tokens, less its empty segments, in the
  group's union.  Only (class, group) cells with so many are opened.
* Opening: members and queries of a group meet in blocks of bounded size, where exact
  intersections are counted with an inverted list.  A block gives a spanning forest of its links
  and each query's number of links, never all pairs.

Shingles are 64-bit hashes; a set is known by its size and a 64-bit hash.  The links are exact but
for hash collisions.  Nulls and texts without words are empty sets: linked with nothing, component
of their own.  Rows with the same id and text are two documents with equal sets.  Ids may be
null; the smallest id of a component ignores nulls if it has others.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from . import _arrow as A
from .components import connected_components

BLOCK = 512


def size_levels(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of every level, and the elements a linked pair can differ in.

    A linked pair of sizes a <= b has b <= 100 a / percent and differs in at most
    a (100 - percent) / percent elements: if a is in level j, b is in j or j + 1.
    """
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    first = np.array(starts, np.int64)
    return first[:-1], (first[1:] - 1) * (100 - percent) // percent


def set_tokens(hashes: np.ndarray, at: np.ndarray, percent: int):
    """For both levels of the (non-empty) sets: rows, their needed tokens, and of each token its
    row and value."""
    sizes = np.diff(at)
    first_size, differ = size_levels(percent, int(sizes.max(initial=1)))
    own = np.searchsorted(first_size, sizes, "right") - 1
    total = np.zeros(len(hashes) + 1, A.U)
    np.cumsum(A.mix(hashes), out=total[1:])
    for below in (0, 1):
        rows = np.flatnonzero(own >= below)
        level = own[rows] - below
        spare = 1 + differ[level] // 8
        m = differ[level] + spare
        n_own = sizes[rows]
        base = np.cumsum(m) - m
        inside = hashes[np.repeat(own >= below, sizes)]
        place = np.repeat(base, n_own) + (((inside >> A.U(32)) * np.repeat(m, n_own).astype(A.U)) >> A.U(32)).astype(np.int64)
        count = np.bincount(place, minlength=int(m.sum()))
        owner = np.repeat(np.arange(len(rows)), m)
        empty = np.bincount(owner[count == 0], minlength=len(rows))
        need = np.maximum(spare - empty, 1)
        # segments of a set are successive ranges of its sorted hashes
        running = np.cumsum(count)
        shift = (at[rows] - (np.cumsum(n_own) - n_own))[owner]
        content = total[running + shift] - total[running - count + shift]
        segment = (np.arange(len(owner)) - base[owner]).astype(A.U)
        token = A.mix(content + A.mix(segment * A.U(0x9E3779B97F4A7C15) + level[owner].astype(A.U) * A.U(0xD1B54A32D192ED03) + A.U(1)))
        kept = (count > 0) | (empty >= spare)[owner]
        yield rows, need, rows[owner[kept]], token[kept]


class Shingler:
    """Sorted distinct shingle hashes of the texts of a slice."""

    def __init__(self, width: int) -> None:
        self.width = width

    def sets(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sets, one after another, and the n + 1 offsets."""
        n = len(offsets) - 1
        words, at = A.word_hashes(A.LOWER[buf], offsets)
        counts = np.diff(at)
        rows = np.repeat(np.arange(n), counts)
        hashes, pos = A.window_hashes(words, rows, self.width)
        owner = rows[pos]
        # a text of fewer words is one shingle
        short = np.flatnonzero((counts > 0) & (counts < self.width))
        whole = np.zeros(len(short), A.U)
        for k in range(self.width - 1):
            more = counts[short] > k
            whole[more] = A.mix(whole[more] + words[at[short[more]] + k] + A.U(k + 1))
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, whole])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
        ends = np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):
            hashes[ends[i]:ends[i + 1]].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))]).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, A.U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return A.mix(_sums(A.mix(hashes + A.U(0x5851F42D4C957F2D)), offsets) + np.diff(offsets).astype(A.U)).view(np.int64)


def _documents(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``key``, size ``n``, set id ``a`` and the tokens ``need`` ed in a group, of every row."""
    shingler = Shingler(width)

    def measure(buf, offsets):
        hashes, at = shingler.sets(buf, offsets)
        sizes = np.diff(at)
        some = np.flatnonzero(sizes)
        need = np.full(len(some), 1 << 30)
        for rows, least, _, _ in set_tokens(hashes, np.concatenate([[0], np.cumsum(sizes[some])]), percent):
            need[rows] = np.minimum(need[rows], least)
        every = np.zeros(len(sizes), np.int64)
        every[some] = need
        return [pa.array(sizes, pa.int64()), pa.array(_set_ids(hashes, at), pa.int64()), pa.array(every, pa.int64())]

    return A.per_text(docs, [key], text, [StructField("n", LongType()), StructField("a", LongType()), StructField("need", LongType())], measure)


def _sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    shingler = Shingler(width)

    def measure(buf, offsets):
        hashes, at = shingler.sets(buf, offsets)
        data = hashes.tobytes()
        return [pa.array(np.diff(at), pa.int64()), pa.array(_set_ids(hashes, at), pa.int64()),
                pa.array([data[8 * at[i]:8 * at[i + 1]] for i in range(len(at) - 1)], pa.binary())]

    return A.per_text(docs, [key], text, [StructField("n", LongType()), StructField("a", LongType()), StructField("set", BinaryType())],
                      measure).select("n", "a", "set")


def _tokens(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``(token, a)``; equal sets of a slice of rows give their tokens once."""
    shingler = Shingler(width)
    source = docs.select(A.quoted(text).cast("string"))

    def run(batches):
        for batch in batches:
            buf, offsets = A.text_bytes(batch.column(0))
            for i, j in A.row_slices(offsets):
                hashes, at = shingler.sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids, sizes = _set_ids(hashes, at), np.diff(at)
                _, first = np.unique(ids, return_index=True)
                chosen = np.zeros(len(ids), bool)
                chosen[first] = True
                chosen &= sizes > 0
                if not chosen.any():
                    continue
                hashes = hashes[np.repeat(chosen, sizes)]
                ids, sizes = ids[chosen], sizes[chosen]
                for _, _, owner, token in set_tokens(hashes, np.concatenate([[0], np.cumsum(sizes)]), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[owner])], names=["token", "a"])

    return source.mapInArrow(run, "token long, a long")


def block_links(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """For each query set the members it is linked with (itself too, if it is one)."""
    every = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes = np.array([len(m) for m in members])
    out = []
    for q in queries:
        low, high = np.searchsorted(every, q, "left"), np.searchsorted(every, q, "right")
        n = high - low
        where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(members))
        out.append(np.flatnonzero(100 * common >= percent * (len(q) + sizes - common)))
    return out


def _open_blocks(percent: int):
    """Rows sorted by cell and role (members first) to links ``(n, a, bn, b, links)``."""

    def finish(members, queries):
        """members, queries: lists of (n, a, size of class, set)"""
        if not members or not queries:
            return
        sets = [np.frombuffer(m[3], A.U) for m in members]
        weight = np.array([m[2] for m in members])
        found = block_links(sets, [np.frombuffer(q[3], A.U) for q in queries], percent)
        part = np.arange(len(members))
        for (n, a, _, _), links in zip(queries, found):
            if not len(links):
                continue
            others = [k for k in links if (members[k][1], members[k][0]) != (a, n)] if len(links) < 8 else links
            count = int(weight[links].sum()) - sum(int(weight[k]) for k in links if members[k][1] == a and members[k][0] == n)
            roots, where = np.unique(part[links], return_index=True)
            if len(roots) > 1:
                part[np.isin(part, roots)] = roots[0]
            if count or len(others):
                yield n, a, None, None, count
            for k in links[where]:
                if members[k][1] != a or members[k][0] != n:
                    yield n, a, members[k][0], members[k][1], 0

    def run(batches):
        cell, members, queries, out = None, [], [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["n", "a", "bn", "b", "links"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            sets = batch.column(5)
            for i, (key, role, n, a, size) in enumerate(zip(*columns)):
                if key != cell:
                    out += finish(members, queries)
                    cell, members, queries = key, [], []
                (queries if role else members).append((n, a, size, sets[i].as_buffer()))
            if out:
                yield flush()
                out = []
        out += finish(members, queries)
        if out:
            yield flush()

    return run


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``n_links`` (linked
    documents) of every row."""
    rows = _documents(docs, key, text, width, percent).withColumnRenamed(key, "id").checkpoint()
    classes = rows.filter("n > 0").groupBy("n", "a", "need").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("id"))
    # tokens that two classes share, with the smallest class of each
    same = Window.partitionBy("token")
    shared = (_tokens(docs, text, width, percent).select("token", "a", F.min("a").over(same).alias("hub"), F.max("a").over(same).alias("last"))
              .filter("hub <> last").select("token", "a", "hub").distinct().checkpoint())
    # partition and matrix
    members = (shared.groupBy("a").agg(F.min("hub").alias("g"), F.count(F.lit(1)).alias("c")).join(classes, "a")
               .filter("c >= need").drop("c").checkpoint())
    matrix = shared.join(members.select("a", "g").distinct(), "a").select("token", "g").distinct()
    # bound: cells in which a class has a token of the union
    cells = (shared.join(matrix, "token").groupBy("a", "g").agg(F.count(F.lit(1)).alias("c"))
             .join(members.select("a", "n", "need"), "a").filter("c >= need").select("n", "a", "g"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    member_blocks = members.groupBy("g").agg(F.count(F.lit(1)).alias("c")).select("g", blocks.alias("mb"))
    cells = cells.checkpoint()
    query_blocks = cells.groupBy("g").agg(F.count(F.lit(1)).alias("c")).select("g", blocks.alias("qb"))
    shape = member_blocks.join(query_blocks, "g")

    def numbered(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def salt(n):
        return F.pmod(F.xxhash64("a", "n"), F.col(n)).cast("int")

    inside = members.join(shape, "g").select("g", salt("mb").alias("m"), numbered("qb").alias("q"), F.lit(0).alias("role"), "n", "a", "size")
    asking = cells.join(shape, "g").select("g", numbered("mb").alias("m"), salt("qb").alias("q"), F.lit(1).alias("role"), "n", "a",
                                           F.lit(1).cast("long").alias("size"))
    wanted, likely = A.fresh("wanted", [key, text]), A.fresh("likely", [key, text])
    chosen = members.select(F.col("id").alias(wanted)).distinct().checkpoint()
    # most texts need not be shuffled to be told from those of members
    texts = A.among(docs.select(A.quoted(key), A.quoted(text)), A.quoted(key), chosen, likely).filter(F.col(likely)).drop(likely)
    candidates = texts.join(chosen, A.quoted(key).eqNullSafe(F.col(wanted)), "left_semi")
    sets = _sets(candidates, key, text, width).groupBy("n", "a").agg(F.first("set").alias("set"))
    cell = F.concat_ws(":", F.col("g").cast("string"), F.col("m").cast("string"), F.col("q").cast("string"))
    dealt = (inside.union(asking).join(sets, ["n", "a"])
             .select(cell.alias("cell"), "role", F.col("n").cast("long").alias("n"), "a", "size", "set")
             .repartition("cell").sortWithinPartitions("cell", "role", "a"))
    links = dealt.mapInArrow(_open_blocks(percent), "n long, a long, bn long, b long, links long").checkpoint()
    node = F.struct(F.col("a"), F.col("n"))
    edges = links.filter("b is not null").select(node.alias("u"), F.struct(F.col("b").alias("a"), F.col("bn").alias("n")).alias("v"))
    parts = connected_components(edges).select(F.col("node.n").alias("n"), F.col("node.a").alias("a"), "component")
    counts = links.filter("b is null").groupBy("n", "a").agg(F.sum("links").alias("links"))
    known = classes.join(parts, ["n", "a"], "left").join(counts, ["n", "a"], "left").select(
        "n", "a", "id", "size", F.coalesce("component", node).alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    known = known.join(least, "component").select("n", "a", "least", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    return rows.join(known, ["n", "a"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
