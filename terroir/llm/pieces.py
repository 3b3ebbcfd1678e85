"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes units: a run of spaces with what follows up to the next space; line ends are
units of their own.  No piece spans two units (checked when the model is read), so every distinct
unit of a batch is encoded once.  The new units of a batch are concatenated and their
suffixes sorted; every piece of the vocabulary is looked up by binary search, which gives the range
of its occurrences.  The occurrences are edges from character to character, laid out by
position, and relaxed from left to right in all units at once.

For a BPE vocabulary an edge extends a prefix only if its piece and the prefix's last piece
are what BPE makes of their joined text; then each prefix has exactly one last piece, and the
path found is the BPE encoding (a sequence of pieces is one if all its neighbours are).
Characters without a piece become byte pieces.

A null text has null ids, an empty one none.  Texts are read whole; the memory of a task is bounded
by its slice, by ``GROUP_BYTES`` of new units at a time and by ``CACHE_UNITS``.  Rows are independent; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from . import _arrow as A

CACHE_UNITS = 200_000
CACHE_PAIRS = 1 << 21
SLICE_BYTES = 1 << 19
GROUP_BYTES = 1 << 18
SPACE = "▁"
NONE = 0xFFFF
FALLBACK = 0xFFFE
START = 0xFFFD


class PieceModel:
    """Vocabulary of a byte-fallback BPE model; spaces are held as spaces, not as the space mark."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if size >= START:
            raise ValueError("vocabularies of up to 65,532 pieces are supported")
        ids = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.rank = {sp.id_to_piece(i).replace(SPACE, " "): (-sp.get_score(i), i) for i in ids}
        inner = [p for p in self.rank if " " in p.lstrip(" ") or ("\n" in p and len(p) > 1)]
        if inner:
            raise ValueError(f"pieces span units: {inner[:5]}")
        self.text = {i: p for p, (_, i) in self.rank.items()}
        pieces = sorted((p.encode(), i, len(p)) for p, (_, i) in self.rank.items())
        self.id = np.array([i for _, i, _ in pieces], np.int64)
        self.chars = np.array([n for _, _, n in pieces], np.int64)
        self.bytes = np.array([len(b) for b, _, _ in pieces], np.int64)
        self.low = np.array([int.from_bytes(b[:8].ljust(8, b"\0"), "big") for b, _, _ in pieces], A.U)
        self.high = np.array([int.from_bytes(b[:8].ljust(8, b"\xff"), "big") for b, _, _ in pieces], A.U)
        self.full = [b for b, _, _ in pieces]
        self.longest = int(self.chars.max(initial=1))
        # bytes of every id, for decoding
        table = [b""] * size
        for i in ids:
            table[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b in range(256):
            table[int(self.byte_ids[b])] = bytes([b])
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.table_at = np.concatenate([[0], np.cumsum([len(b) for b in table])]).astype(np.int64)
        self.pair_key = self.pair_value = None  # a worker's cache

    def bpe(self, text: str) -> list[str]:
        """Merges of the best-scored neighbours, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] < best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, key: int) -> bool:
        a, b = key >> 16, key & 0xFFFF
        right = self.text[b]
        return self.bpe(right) == [right] if a == START else self.bpe(self.text[a] + right) == [self.text[a], right]

    def fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow each last piece."""
        out = (last == FALLBACK) & (piece != FALLBACK)
        first = out | (last == START)
        key = np.where(first, START, last).astype(np.int64) << 16 | piece
        if self.pair_key is None:
            self.pair_key, self.pair_value = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)
        slot = (A.mix(key.astype(A.U)) & A.U(CACHE_PAIRS - 1)).astype(np.int64)
        out = self.pair_value[slot]
        miss = np.flatnonzero((self.pair_key[slot] != key) & (piece != FALLBACK))
        if len(miss):
            keys, where = np.unique(key[miss], return_inverse=True)
            values = np.array([self._fits(int(k)) for k in keys], bool)
            out[miss] = values[where]
            self.pair_key[slot[miss]] = key[miss]
            self.pair_value[slot[miss]] = values[where]
            # of pairs that met in one slot the last one's key is kept; store its own value
            check = slot[miss]
            mine = self.pair_key[check] == key[miss]
            self.pair_value[check[mine]] = values[where][mine]
        return out | (piece == FALLBACK)

    def encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``data[starts:ends]``, one after another, and the n + 1 offsets."""
        n = len(starts)
        sizes = ends - starts
        # units laid out with a zero byte after each; no piece holds a zero byte
        at = np.cumsum(sizes + 1) - (sizes + 1)
        buf = np.zeros(int((sizes + 1).sum()) + 8, np.uint8)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        buf[np.repeat(at, sizes) + inner] = data[np.repeat(starts, sizes) + inner]
        m = len(buf) - 8
        key = np.zeros(m, A.U)
        for k in range(8):
            key = (key << A.U(8)) | buf[k:k + m]
        is_char = (buf[:m] & 0xC0) != 0x80
        char_of = np.cumsum(is_char) - 1
        char_at = np.flatnonzero(is_char)          # zero bytes count as characters too
        n_chars = len(char_at)
        # suffixes in order of their first eight bytes
        order = np.argsort(key[char_at], kind="stable")
        suffix = char_at[order]
        ranked = key[suffix]
        low, high = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        edges = np.full((self.longest, n_chars), NONE, np.uint16)
        edges[0] = FALLBACK
        for width in np.unique(self.chars[high > low]):
            some = np.flatnonzero((self.chars == width) & (high > low))
            count = high[some] - low[some]
            piece = np.repeat(some, count)
            where = suffix[np.repeat(low[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            long = np.flatnonzero(self.bytes[piece] > 8)
            if len(long):  # compare what lies beyond the sorted eight bytes
                same = np.ones(len(piece), bool)
                same[long] = [buf[p + 8:p + len(b)].tobytes() == b[8:] for p, b in ((int(where[x]), self.full[piece[x]]) for x in long)]
                piece, where = piece[same], where[same]
            edges[int(width) - 1, char_of[where]] = self.id[piece]
        # relax: last[c] is the last piece of the encoding that ends before character c
        first = char_of[at]
        length = char_of[at + sizes] - first
        by = np.argsort(-length, kind="stable")
        first, length = first[by], length[by]
        last = np.full(n_chars + 1, NONE, np.uint16)
        last[first] = START
        step = np.zeros(n_chars + 1, np.uint8)
        active = n
        for e in range(1, int(length[0]) + 1 if n else 1):
            active = int(np.searchsorted(-length[:active], -e, "right"))
            todo = first[:active] + e
            for width in range(min(e, self.longest), 0, -1):
                piece = edges[width - 1, todo - width]
                there = np.flatnonzero(piece != NONE)
                if not len(there):
                    continue
                end, piece = todo[there], piece[there]
                good = self.fits(last[end - width], piece)
                last[end[good]] = piece[good]
                step[end[good]] = width
                rest = np.ones(len(todo), bool)
                rest[there[good]] = False
                todo = todo[rest]
                if not len(todo):
                    break
        # walk back from every unit's end
        tokens, token_end = [], []
        unit = []
        here = first + length
        alive = np.flatnonzero(length > 0)
        while len(alive):
            p = here[alive]
            tokens.append(last[p])
            token_end.append(p)
            unit.append(by[alive])
            here[alive] = p - step[p]
            alive = alive[here[alive] > first[alive]]
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        tokens, token_end, unit = np.concatenate(tokens), np.concatenate(token_end), np.concatenate(unit)
        order = np.argsort(token_end, kind="stable")
        tokens, token_end, unit = tokens[order], token_end[order], unit[order]
        # characters without a piece: one id for each byte
        back = tokens == FALLBACK
        begin = char_at[token_end - 1]
        count = np.where(back, char_at[np.minimum(token_end, n_chars - 1)] - begin, 1)
        ids = np.repeat(tokens.astype(np.int32), count)
        which = np.repeat(back, count)
        byte = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids[which] = self.byte_ids[buf[byte[which]]]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(unit, weights=count, minlength=n))]).astype(np.int64)


class Encoder:
    """Encodes slices of texts; keeps the ids of units it has seen, up to ``CACHE_UNITS``."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.count, self.ids = np.zeros(0, A.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the n + 1 offsets."""
        marked = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts]
        buf = np.frombuffer(b"".join(marked), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), offsets * 0
        line = buf == 10
        space = buf == 32
        cut = np.zeros(len(buf), bool)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        cut[1:] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        hashes, first, which = np.unique(A.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_UNITS:
            self._clear()
        new = np.flatnonzero(~np.isin(hashes, self.hashes, assume_unique=True))
        if len(new):
            group = np.cumsum((ends - starts)[first[new]]) // GROUP_BYTES
            done = [self.model.encode_units(buf, starts[first[g]], ends[first[g]]) for g in np.split(new, np.flatnonzero(np.diff(group)) + 1)]
            count = np.concatenate([np.diff(at) for _, at in done])
            joined = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(joined)
            self.at = np.concatenate([self.at, np.cumsum(count) - count + len(self.ids)])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.hashes, self.ids = joined[order], np.concatenate([self.ids, *[ids for ids, _ in done]])
        place = np.searchsorted(self.hashes, hashes)[which]
        count = self.count[place]
        ids = self.ids[np.repeat(self.at[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(starts, offsets)]


def _lists(ids: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    marks = pa.array(offsets.astype(np.int32), pa.int32(), mask=np.append(missing, False))
    return pa.ListArray.from_arrays(marks, pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``ids`` (a column of that name is replaced)."""
    shared = A.Shared(docs.sparkSession, model)  # bounded by the vocabulary
    own = [c for c in docs.columns if c != ids]
    source = docs.select(*[A.quoted(c) for c in own], A.quoted(text).cast("string").alias(A.fresh("body", own)))
    schema = docs.select(*[A.quoted(c) for c in own]).schema.add(StructField(ids, ArrayType(IntegerType())))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(len(own))
            missing = np.asarray(column.is_null())
            buf, offsets = A.text_bytes(column)
            for i, j in A.row_slices(offsets, SLICE_BYTES):
                data = buf[offsets[i]:offsets[j]].tobytes()
                base = offsets[i]
                texts = [data[offsets[k] - base:offsets[k + 1] - base] for k in range(i, j)]
                found, at = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(len(own))] + [_lists(found, at, missing[i:j])],
                                                 names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def decode_ids(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of the id lists; byte pieces that are no UTF-8 give replacement characters."""
    size = (model.table_at[1:] - model.table_at[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(model.table_at[ids] - total[:-1], size) + np.arange(total[-1])
    data = model.table[where].tobytes()
    ends = total[offsets]
    texts = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in column ``text`` (replaced if there); null ids give null."""
    shared = A.Shared(rows.sparkSession, model)
    own = [c for c in rows.columns if c != text]
    source = rows.select(*[A.quoted(c) for c in own], A.quoted(ids).cast("array<int>").alias(A.fresh("ids", own)))
    schema = rows.select(*[A.quoted(c) for c in own]).schema.add(text, StringType())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part.column(len(own))
                missing = np.asarray(lists.is_null())
                counts = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
                flat = np.asarray(lists.flatten(), dtype=np.int64)
                texts = decode_ids(shared.value, flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(own))] + [pa.array(texts, pa.string(), mask=missing)],
                                                 names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids``, ``n_tokens`` and whether the decoded ids are the text again, in one pass."""
    shared = A.Shared(docs.sparkSession, model)
    source = docs.select(A.quoted(key), A.quoted(text).cast("string").alias(A.fresh("body", [key])))
    schema = docs.select(A.quoted(key)).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("exact", BooleanType())

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            missing = np.asarray(batch.column(1).is_null())
            buf, offsets = A.text_bytes(batch.column(1))
            for i, j in A.row_slices(offsets, SLICE_BYTES):
                data, base = buf[offsets[i]:offsets[j]].tobytes(), offsets[i]
                texts = [data[offsets[k] - base:offsets[k + 1] - base] for k in range(i, j)]
                ids, at = encoder.encode(texts)
                back = decode_ids(shared.value, ids, at)
                exact = [b.encode() == t for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(ids, at, missing[i:j]),
                                                  pa.array(np.diff(at), pa.int64()), pa.array(exact, pa.bool_(), mask=missing[i:j])],
                                                 names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
