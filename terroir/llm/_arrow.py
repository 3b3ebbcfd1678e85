"""Shared numpy helpers: texts of an Arrow batch as one byte buffer, words and span hashes.

Texts are worked on in slices of about one megabyte, so memory does not depend on the batch
or partition size (a single longer text is one slice).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

U = np.uint64
SLICE_BYTES = 1 << 20

#: Bytes that part words: space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z, leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Shared:
    """A broadcast object of a class of this package.  Its plain state is broadcast, so workers need no copy
    of the package; a worker unpacks it once, keeps it (with what it caches) for the tasks of a
    stage, and frees it when it gets a task of another."""

    def __init__(self, spark, value) -> None:
        self.kind, self.state = type(value), spark.sparkContext.broadcast(vars(value))

    @property
    def value(self):
        out = object.__new__(self.kind)
        out.__dict__ = self.state.value
        return out


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column of ``taken`` has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


#: Bits for each key of ``among``; one key in so many that is not among them passes.  A bitmap of the most bits is 64 MB as rows.
KEY_BITS, MOST_BITS = 16, 1 << 28


def among(docs: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``docs`` with the boolean ``flag``: true for all rows whose ``key`` is in ``keys`` (one column) and for few others.

    What is not flagged needs no shuffle to be told from ``keys``; what is flagged has yet to be joined.  The keys' hashes are the bits of a
    bitmap, whose words are broadcast: their number is bounded whatever the keys are, and beyond ``MOST_BITS`` more rows are flagged."""
    n = keys.count()
    bits = 1 << min(max(n * KEY_BITS, 64).bit_length(), MOST_BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64(quoted(keys.columns[0])), F.lit(bits))
    word, mask, taken = fresh("_word", docs.columns), fresh("_mask", docs.columns), fresh("_taken", docs.columns)
    words = (keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias(taken))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias(mask)))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    held = docs.withColumn(word, at).join(F.broadcast(words), F.shiftright(quoted(word), 6) == quoted(taken), "left")
    bit = F.call_function("getbit", F.coalesce(quoted(mask), F.lit(0).cast("long")), (quoted(word) % 64).cast("int")) == 1
    return held.select(*[quoted(c) for c in docs.columns], bit.alias(flag))


def per_text(docs: DataFrame, keys: list[str], text: str, fields: list[StructField],
             fn: Callable[[np.ndarray, np.ndarray], list[pa.Array]], limit: int = SLICE_BYTES) -> DataFrame:
    """``keys`` and the columns that ``fn(bytes, offsets)`` gives for each slice of rows."""
    source = docs.select(*[quoted(k) for k in keys], quoted(text).cast("string").alias(fresh("body", keys)))
    schema = StructType([source.schema.fields[i] for i in range(len(keys))] + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(len(keys)))
            for i, j in row_slices(offsets, limit):
                out = fn(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(len(keys))] + out, names=names)

    return source.mapInArrow(run, schema)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes; runs end with their row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between successive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: a polynomial modulo 2^64 over prefix sums, then mixed."""
    n = len(buf)
    total = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _power("up", _MULTIPLIER, n + 1)[:n], out=total[1:])
    inverse = _power("down", pow(_MULTIPLIER, -1, 1 << 64), n + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, and each row's n + 1 offsets among them."""
    starts, ends = spans_of(~BLANK[buf], offsets)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of a row, and the first word's position."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for k in range(width):
        h = h * U(0xD6E8FEB86659FD93) + words[k:k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1:])
    return mix(h[at]), at
