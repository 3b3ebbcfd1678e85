"""Prefix trie of conversations by whole-sequence collapse.

Turns are ranked within their conversation and become two 64-bit hashes; the prefix of depth d is known
by d and the exclusive or of the place-seeded hashes of its turns (128 bits), so prefixes come from a scan by
chunks of a conversation, without a task for a long one.  Identical conversations become one weighted sequence,
stood for by its smallest id, with the list of the conversations that end there.  Only the sequences' prefixes
are aggregated: a node's members are the summed weights, and the sequences left after the anti-join with the
proper prefixes are the leaves.

Each node belongs to its smallest member, which owns a suffix of its own path.  So the bytes of the
different nodes below u are the owned bytes of the sequences through u, and sums over subtrees and numbers of
children are plain sums over the sequences through a node: no pairs of nodes and ancestors are formed.  Sums are
combined before they are shuffled, so the root and a common first turn are no task of their own.  End lists are
joined into bounded blocks by range, and one digest reads a node's blocks as a stream.

A null role or text is empty; rows with a null conversation id belong to none and are left out.  Turns are in the
order of their number (null first), then role and text; repeated rows are turns of their own.  A conversation
that the rebuilding leaves without turns ends at the root.  No conversations give no rows, not even a root.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.scan import ranked
from ..session import shared_path
from ._arrow import quoted

#: Turns of a conversation that one task scans at once.
CHUNK = 1024
#: Characters of an end list's block.
LIST_BLOCK = 1 << 16
KEY = ["depth", "a", "b"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"trie-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hashed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, place, a, b, bytes)`` of every turn; ``place`` counts 1, 2, ... in a conversation."""
    rows = conversations.select(quoted(conv).cast("long").alias("conv"), quoted(turn).alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    in_order = ranked(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place", "trie-turns")
    return _stored(in_order.select("conv", "place", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
                                   F.octet_length("text").cast("long").alias("bytes")), "hashed")


def sizes(turns: DataFrame) -> DataFrame:
    """``(conv, total)``: the conversations and their numbers of turns."""
    return turns.groupBy("conv").agg(F.max("place").alias("total"))


def with_shared_starts(turns: DataFrame, convs: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as another one: the first h turns of conversation c - c % ``every`` (none if there is
    none), then the own turns after the first h; h is crc32(decimal c) % ``most``.  A start has fewer than ``most``
    turns and a conversation that gives one gives it to its nearest ones only, so no join key is hot."""
    start = convs.select("conv", F.col("total").alias("own"), (F.col("conv") - F.col("conv") % every).alias("base"),
                         (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    plan = _stored(start.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_total", F.lit(0)))).withColumn(
        "total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv", "base", "h", "taken", "total"), "starts")
    given = turns.filter(F.col("place") < most).withColumnRenamed("conv", "base").join(plan, "base").filter("place <= h")
    own = turns.join(plan, "conv").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    names = ["conv", "place", "a", "b", "bytes"]
    return given.select(*names).union(own.select(*names)), plan.select("conv", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, a, b, bytes, path_bytes, up_a, up_b)``: the prefix that ends with each turn, and the one before."""
    placed = turns.select("conv", "place", F.xxhash64("place", "a", "b").alias("ha"), F.xxhash64("b", "a", "place").alias("hb"), "bytes",
                          F.floor((F.col("place") - 1) / CHUNK).alias("chunk"))
    here = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"a": F.bit_xor("ha").over(here), "b": F.bit_xor("hb").over(here), "path": F.sum("bytes").over(here)})
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (placed.groupBy("conv", "chunk").agg(F.bit_xor("ha").alias("ca"), F.bit_xor("hb").alias("cb"), F.sum("bytes").alias("cp"))
             .select("conv", "chunk", *[f(c).over(before).alias(c) for f, c in ((F.bit_xor, "ca"), (F.bit_xor, "cb"), (F.sum, "cp"))]).filter("chunk > 0"))
    zero = F.lit(0).cast("long")
    both = local.join(carry, ["conv", "chunk"], "left").select(
        "conv", F.col("place").alias("depth"), F.col("a").bitwiseXOR(F.coalesce("ca", zero)).alias("a"), F.col("b").bitwiseXOR(F.coalesce("cb", zero)).alias("b"),
        "bytes", (F.col("path") + F.coalesce("cp", zero)).alias("path_bytes"), "ha", "hb")
    return both.select("conv", *KEY, "bytes", "path_bytes", F.col("a").bitwiseXOR(F.col("ha")).alias("up_a"), F.col("b").bitwiseXOR(F.col("hb")).alias("up_b"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)`` of the ascending ``conv`` of each key, joined by commas.

    First bounded blocks of a sorted range, then a stream of a key's blocks: a list is never whole in memory."""
    blocks_schema = ends.select(*KEY, F.col("conv").alias("first"), F.col("conv").cast("string").alias("ids")).schema
    digest_schema = ends.select(*KEY).schema.add("ends_sha256", StringType())

    def blocks(batches):
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key or size >= LIST_BLOCK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = row[:3], row[3], [], 0
                ids.append(str(row[3]))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=blocks_schema.names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(ids))], names=blocks_schema.names)

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256(row[4].encode())
                else:
                    state.update(b"," + row[4].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=digest_schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=digest_schema.names)

    by_range = ends.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(blocks, blocks_schema)
    return by_range.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, digest_schema)


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuild: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """One row for each different prefix: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of last turns that members after the first share, over the
    subtree) and ``ends_sha256`` (of the ascending ids of the conversations that end there).

    The prefix itself is the first ``depth`` turns of conversation ``conv_id``.  ``rebuild(turns, convs)`` may put
    other turns together before, from ``hashed_turns`` and ``sizes``.
    """
    turns = hashed_turns(conversations, conv, turn, role, text)
    convs = sizes(turns)
    if rebuild is not None:
        turns, convs = rebuild(turns, convs)
    paths = _stored(prefixes(turns), "prefixes")
    convs = _stored(convs, "convs")

    zero = F.lit(0).cast("long")
    at_end = paths.withColumnRenamed("depth", "total").join(convs, ["conv", "total"]).select(F.col("total").alias("depth"), "a", "b", "path_bytes", "conv")
    ends = at_end.union(convs.filter("total = 0").select(zero, zero, zero, zero, "conv"))
    sequences = _stored(ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("seq"), F.max("path_bytes").alias("seq_bytes"))
                        .withColumnRenamed("depth", "length"), "sequences")

    steps = paths.withColumnRenamed("conv", "seq").join(sequences.select("seq", "weight", "length"), "seq")
    roots = sequences.select("seq", *[zero.alias(c) for c in (*KEY, "bytes", "path_bytes")], *[F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")], "weight", "length")
    steps = _stored(steps.select("seq", *KEY, "bytes", "path_bytes", "up_a", "up_b", "weight", "length").union(roots), "steps")

    owned = steps.groupBy(*KEY).agg(F.min("seq").alias("seq"), F.max("bytes").alias("bytes"))
    owned = owned.groupBy("seq").agg(F.sum("bytes").alias("owned_bytes"), F.min("depth").alias("top"))
    proper = steps.filter("depth < length").select(F.col("depth").alias("length"), "a", "b").distinct()
    leaves = sequences.join(proper, ["length", "a", "b"], "left_anti").select("seq", F.lit(1).alias("leaf"))
    parts = sequences.join(owned, "seq", "left").join(leaves, "seq", "left").select(
        "seq", "seq_bytes", F.coalesce("owned_bytes", zero).alias("owned_bytes"), F.coalesce("top", F.col("length") + 1).alias("top"), F.coalesce("leaf", F.lit(0)).alias("leaf"))

    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("top"))).cast("long")
    nodes = _stored(steps.join(parts, "seq").groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("seq_bytes")).alias("all_bytes"),
        F.sum("owned_bytes").alias("different_bytes"), F.min(F.struct("seq", "top", "owned_bytes", "seq_bytes")).alias("owner"),
        F.max("bytes").alias("bytes"), F.max("path_bytes").alias("path_bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")), "nodes")
    above = F.col("path_bytes") - F.col("bytes")
    saved = (F.col("all_bytes") - F.col("n_convs") * above) - (F.col("different_bytes") - F.col("owner.owned_bytes") + F.col("owner.seq_bytes") - above)
    named = nodes.select(F.col("owner.seq").alias("conv_id"), *KEY, "up_a", "up_b", (F.col("depth") > F.col("owner.top")).alias("inside"), "n_convs", "n_children", "n_leaves",
                         saved.alias("saved_tokens"))
    # within the owner's suffix the parent has the same owner; only where the suffix hangs is it looked up
    parents = named.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    hung = named.filter("not inside").join(parents, ["depth", "up_a", "up_b"], "left")
    names = ["conv_id", *KEY, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = hung.select(*names).union(named.filter("inside").withColumn("parent_conv_id", F.col("conv_id")).select(*names))
    digests = whole.join(end_digests(ends), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return digests.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc),
o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base,
             xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                             lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 9 AS h FROM o, t),
r AS (SELECT h.conv_id, coalesce(b.own[1:h], []) || h.own[h + 1:] AS path FROM h LEFT JOIN o AS b ON b.conv_id = h.base),
s AS (SELECT conv_id, len(path) AS length, path[1:d] AS prefix, d AS depth FROM r, LATERAL (SELECT unnest(range(len(path) + 1)) AS d) AS x),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256 FROM s GROUP BY prefix, depth),
c AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * octet_length(encode(n.prefix[n.depth].text)) ELSE 0 END AS saved
      FROM n LEFT JOIN c ON n.prefix = c.prefix),
a AS (SELECT prefix[1:e] AS prefix, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves
      FROM m, LATERAL (SELECT unnest(range(depth + 1)) AS e) AS x GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
FROM m JOIN a ON m.prefix = a.prefix LEFT JOIN n AS p ON m.depth > 0 AND p.prefix = m.prefix[1:m.depth - 1]
"""
