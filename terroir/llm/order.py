"""Training-order materialisation: fixed-stride binary shards of token sequences.

Documents are cut into sequences of ``length`` ids.  The N sequences are numbered, and a keyed
Feistel permutation with cycle-walking gives every number a slot in 0..N-1: a shuffled order that
needs no sort and that any reader can compute.  Range partitions over the shard number write
``shard_size`` records of equal stride each, ordered by slot, so record k of a shard is at
byte k times the stride and a reader can go on from any slot.

A record is a little-endian uint32 (number of ids; the top bit marks a document's last
sequence), then the ids in ``width`` bytes each, then zeros.  Texts become byte ids (width 1: the
UTF-8 bytes, a vocabulary of 256); given id lists become 2- or 4-byte ids.

The numbered sequences are stored in the shared checkpoint folder first, so a lost executor
never changes a number; only one count for each stored partition reaches the driver.  Null and
empty texts (or lists) have no sequence.  Repeated rows are documents of their own.  Keys are
carried, not interpreted.  No sequences give no shards.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructType

from ..session import shared_path
from . import _arrow as A

LAST = 1 << 31
ROUNDS = 6


def _round(half: np.ndarray, r: int, key: int) -> np.ndarray:
    return A.mix(half * A.U(0x9E3779B97F4A7C15) + A.U((key + r * 0xD1B54A32D192ED03) & (2**64 - 1)))


def feistel(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slots of ``numbers`` under a permutation of 0..n-1 (or back again)."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = A.U((1 << bits) - 1)
    shift = A.U(bits)
    x = numbers.astype(A.U)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, r, key) & mask), left
            else:
                left, right = right, left ^ (_round(right, r, key) & mask)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= A.U(n)]  # walk the cycle until it is back inside
    return x.astype(np.int64)


def _cut(source: DataFrame, key: str, length: int, width: int, packed) -> DataFrame:
    """``(key, part, last, body)`` of every sequence; ``packed(column)`` gives bytes and offsets."""
    schema = source.select(A.quoted(key)).schema.add("part", IntegerType()).add("last", BooleanType()).add("body", BinaryType())
    stride = length * width

    def run(batches):
        for batch in batches:
            buf, offsets = packed(batch.column(1))
            for i, j in A.row_slices(offsets):
                data, base = memoryview(np.ascontiguousarray(buf[offsets[i]:offsets[j]])), offsets[i]
                rows, parts, last, bodies = [], [], [], []
                for k in range(i, j):
                    a, b = int(offsets[k] - base), int(offsets[k + 1] - base)
                    for p, s in enumerate(range(a, b, stride)):
                        rows.append(k)
                        parts.append(p)
                        last.append(s + stride >= b)
                        bodies.append(bytes(data[s:min(s + stride, b)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(parts, pa.int32()), pa.array(last),
                                                      pa.array(bodies, pa.binary())], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def sequences_of_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 1024) -> DataFrame:
    """Byte-id sequences of the texts."""
    return _cut(docs.select(A.quoted(key), A.quoted(text).cast("string").alias(A.fresh("body", [key]))), key, length, 1, A.text_bytes)


def sequences_of_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", length: int = 1024, width: int = 2) -> DataFrame:
    """Sequences of id lists; an id must fit into ``width`` bytes (2 or 4)."""
    kind = {2: np.uint16, 4: np.uint32}[width]

    def packed(lists):
        count = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
        flat = np.asarray(lists.flatten(), dtype=np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
            raise ValueError(f"an id does not fit into {width} bytes")
        return flat.astype(kind).view(np.uint8), np.concatenate([[0], np.cumsum(count)]).astype(np.int64) * width

    return _cut(rows.select(A.quoted(key), A.quoted(ids).cast("array<long>").alias(A.fresh("ids", [key]))), key, length, width, packed)


def numbered(sequences: DataFrame) -> tuple[DataFrame, int]:
    """The stored sequences with a dense ``number``, and how many there are."""
    spark = sequences.sparkSession
    path = shared_path(spark, f"sequences-{uuid.uuid4().hex}")
    sequences.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["count"]) for r in stored.groupBy(part.alias("p")).count().collect())
    base, start = 0, {}
    for p, c in counts:
        start[p] = base
        base += c
    offsets = spark.createDataFrame(list(start.items()), "_p long, _start long") if start else spark.createDataFrame([], "_p long, _start long")
    joined = stored.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # one row for each stored partition
    return joined.withColumn("number", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_start"), base


def materialise(sequences: DataFrame, key: str = "doc_id", seed: int = 0, length: int = 1024, width: int = 1, shard_size: int = 2048) -> DataFrame:
    """One row for each shard: ``shard``, ``first_slot``, ``n_sequences``, ``stride``, ``payload`` (the
    records) and, in slot order, ``keys`` and ``parts`` of its sequences."""
    stored, n = numbered(sequences)
    stride = 4 + length * width
    kind = stored.schema[key].dataType
    slotted = stored.select("number", A.quoted(key).alias("key"), "part", "last", "body")
    with_slot = StructType(list(slotted.schema.fields)).add("slot", LongType()).add("shard", LongType())

    def slots(batches):
        for batch in batches:
            slot = feistel(np.asarray(batch.column(0)), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot), pa.array(slot // shard_size)], names=[f.name for f in with_slot.fields])

    def shards(batches):
        now, rows = None, []

        def done():
            out = bytearray(stride * len(rows))
            for k, (_, _, last, body, _) in enumerate(rows):
                at = k * stride
                out[at:at + 4] = (len(body) // width | (LAST if last else 0)).to_bytes(4, "little")
                out[at + 4:at + 4 + len(body)] = body
            return pa.RecordBatch.from_pylist([{"shard": now, "first_slot": now * shard_size, "n_sequences": len(rows), "stride": stride,
                                                "payload": bytes(out), "keys": [r[0] for r in rows], "parts": [r[1] for r in rows]}], schema=arrow)

        arrow = to_arrow_schema(result)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                if row[5] != now:
                    if rows:
                        yield done()
                    now, rows = row[5], []
                rows.append(row[:5])
        if rows:
            yield done()

    result = (StructType().add("shard", LongType()).add("first_slot", LongType()).add("n_sequences", LongType()).add("stride", LongType())
              .add("payload", BinaryType()).add("keys", ArrayType(kind)).add("parts", ArrayType(IntegerType())))
    parts = max(1, -(-n // shard_size))
    spark = sequences.sparkSession
    dealt = slotted.mapInArrow(slots, with_slot).repartitionByRange(
        min(parts, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "slot")
    return dealt.mapInArrow(shards, result)


def read_from(shards: DataFrame, slot: int = 0, width: int = 1) -> DataFrame:
    """Sequences ``(slot, key, part, last, ids)`` from ``slot`` on: whole shards before it are not read."""
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[width]
    of = shards.schema["keys"].dataType.elementType
    schema = shards.select(F.col("first_slot").alias("slot")).schema.add("key", of).add("part", IntegerType()).add("last", BooleanType()).add("ids", ArrayType(IntegerType()))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for k in range(max(0, slot - row["first_slot"]), row["n_sequences"]):
                    record = row["payload"][k * row["stride"]:(k + 1) * row["stride"]]
                    head = int.from_bytes(record[:4], "little")
                    count = head & (LAST - 1)
                    out.append((row["first_slot"] + k, row["keys"][k], row["parts"][k], bool(head & LAST),
                                np.frombuffer(record, kind, count, 4).astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    kept = shards.filter(F.col("first_slot") + F.col("n_sequences") > slot).select("first_slot", "n_sequences", "stride", "payload", "keys", "parts")
    return kept.mapInArrow(run, schema)
