"""Quality rules with compression bands.

A text that fails the base rules (too short, or too many words inside repeated 8-word windows)
is rejected.  The others are compressed with zstandard, whole and in chunks of fixed size; the
ratio of raw to compressed bytes of natural text lies in a band that depends on the length.
Above it a text is repetitive, below it incompressible (noise, encoded data).

Null texts count as empty: no words, so the base rules reject them.  Texts of any length are
read whole.  Rows are independent: repeated rows give repeated results, an empty table an
empty result, and other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from . import _arrow as A

SYMBOLS = b"#*$%&|<>"

#: (bytes below, least ratio, largest ratio) for whole texts, by length.
WHOLE_BANDS = ((256, 0.0, 3.0), (1024, 1.0, 3.5), (8192, 1.4, 4.0), (65536, 1.5, 5.0), (None, 1.5, 6.0))
#: The same for one chunk; a last chunk may be short.
CHUNK_BANDS = ((256, 0.0, 8.0), (1024, 0.8, 10.0), (None, 1.4, 12.0))


def _in_band(size: int, packed: int, bands) -> bool:
    for below, least, most in bands:
        if below is None or size < below:
            return least * packed <= size <= most * packed
    return True


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 20, repeat_percent: int = 30,
                  chunk_bytes: int = 4096, bad_chunk_share: float = 0.5, level: int = 3) -> DataFrame:
    """``key``, counts of the base rules, compression figures and the verdict of every text.

    ``kept`` is false if ``base_failed``, if the whole text's ratio is outside its band, or if more
    than ``bad_chunk_share`` of its chunks are outside theirs.
    """
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    fields = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [StructField("base_failed", BooleanType()), StructField("ratio", DoubleType()),
               StructField("n_chunks", LongType()), StructField("n_bad_chunks", LongType()), StructField("kept", BooleanType())]

    def measure(buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        blank = A.BLANK[buf]
        starts, ends = A.spans_of(~blank, offsets)
        at = np.searchsorted(starts, offsets)
        n_words = np.diff(at)
        word_chars = A.per_row(~blank & ((buf & 0xC0) != 0x80), offsets)
        n_symbols = A.per_row(symbol[buf], offsets)
        # lines that hold a word; those equal to an earlier one of the same text
        line_start, line_end = A.spans_of(buf != 10, offsets)
        wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[wordy], line_end[wordy]
        row = np.searchsorted(offsets, line_start, "right").astype(A.U) - A.U(1)
        keys = A.mix(A.span_hashes(buf, line_start, line_end) + row * A.U(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        n_dup = np.bincount(row.astype(np.int64), minlength=n) - np.bincount(row[first].astype(np.int64), minlength=n)
        # words inside 8-word windows found twice or more in the text
        words = A.span_hashes(buf, starts, ends)
        rows = np.repeat(np.arange(n), n_words)
        window, pos = A.window_hashes(words, rows, 8)
        keys = A.mix(window + rows[pos].astype(A.U) * A.U(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, pos[twice], 1)
        np.add.at(cover, pos[twice] + 8, -1)
        n_repeat = A.per_row(np.cumsum(cover)[:-1] > 0, at)
        failed = (n_words < min_words) | (100 * n_repeat > repeat_percent * n_words)
        pack = zstandard.ZstdCompressor(level=level).compress
        view = memoryview(np.ascontiguousarray(buf))
        ratio, chunks, bad, kept = [], [], [], []
        for i in range(n):
            part = view[offsets[i]:offsets[i + 1]]
            size = len(part)
            packed = len(pack(part)) if size else 0
            n_bad = 0
            for k in range(0, size, chunk_bytes):
                piece = part[k:k + chunk_bytes]
                n_bad += not _in_band(len(piece), packed if size <= chunk_bytes else len(pack(piece)), CHUNK_BANDS)
            count = -(-size // chunk_bytes)
            ratio.append(size / packed if packed else 0.0)
            chunks.append(count)
            bad.append(n_bad)
            kept.append(not failed[i] and _in_band(size, packed, WHOLE_BANDS) and n_bad <= bad_chunk_share * count)
        longs = [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)]
        return [*longs, pa.array(failed, pa.bool_()), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int64()),
                pa.array(bad, pa.int64()), pa.array(kept, pa.bool_())]

    return A.per_text(docs, [key], text, fields, measure)
