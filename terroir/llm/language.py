"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built.  A text is
parsed from left to right into the longest phrases that occur in a language's sample; the
language that needs the fewest phrases per symbol wins.  Symbols are lower-cased letters; every
run of other characters is one space.  Phrases end at every border of ``block`` symbols, so that
the blocks of all texts of a slice are parsed side by side and memory stays bounded.

Whole texts are read.  A null text, and one without a letter, is ``und`` with score 0; so is every
text if there is no labelled sample.  Ties go to the first language by name.  Rows are
independent, repeated rows give repeated results, and other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import _arrow as A

UNKNOWN = "und"
NO_LETTER = 0xFFFF


def held_out(key) -> "F.Column":
    """Whether a document is kept away from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = 64, excerpt: int = 256) -> list[tuple[str, str]]:
    """At most ``rows`` different texts for each language, those with the smallest hash, and of each
    an excerpt of ``excerpt`` characters from a place that its hash gives: bounded, whatever the
    table's size.  Copies of a text count once."""
    base = docs.select(A.quoted(lang).cast("string").alias("lang"), A.quoted(text).alias("text")).filter("lang is not null and text is not null")
    hashed = base.withColumn("h", F.xxhash64("text"))
    # the smallest of every 32nd part of a language's hashes, then the smallest of those
    best = hashed.groupBy("lang", F.pmod("h", F.lit(32)).alias("part"), "h").agg(F.count(F.lit(1)).alias("n"))
    for by in (["lang", "part"], ["lang"]):
        best = best.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= rows)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - excerpt, F.lit(1))).cast("int") + 1
    found = (hashed.join(F.broadcast(best.select("lang", "h")), ["lang", "h"])
             .groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(excerpt))).alias("t")).collect())
    return sorted((r["lang"], r["t"]) for r in found)


class SuffixAutomaton:
    """States and transitions of the automaton of all substrings of a symbol sequence."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def restart(self) -> None:
        """The next symbol begins a new text: no substring crosses."""
        self.last = 0

    def add(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        if c in nxt[p]:
            q = nxt[p][c]
            self.last = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            return
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        self.last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy


def normalised(text: str) -> str:
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


class Model:
    """Transition tables of all languages' automata, laid one after another.

    ``table[state + symbol]`` is the next state (times the number of symbols), or 0, the dead
    state; ``roots[language]`` is a language's start.  Symbol 0 is any letter not learned.
    """

    def __init__(self, sample: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, t in sample if normalised(t)})
        texts = {x: [normalised(t) for lang, t in sample if lang == x] for x in self.languages}
        letters = sorted({c for parts in texts.values() for t in parts for c in t} - {" "})
        symbol = {c: i + 2 for i, c in enumerate(letters)} | {" ": 1}
        self.width = len(symbol) + 1
        rows, self.roots = [np.zeros((1, self.width), np.int32)], []
        base = 1
        for lang in self.languages:
            auto = SuffixAutomaton()
            for t in texts[lang]:
                auto.restart()
                for c in t:
                    auto.add(symbol[c])
            part = np.zeros((len(auto.next), self.width), np.int32)
            for s, edges in enumerate(auto.next):
                for c, to in edges.items():
                    part[s, c] = (base + to) * self.width
            self.roots.append(base * self.width)
            rows.append(part)
            base += len(auto.next)
        self.table = np.concatenate(rows).ravel()
        # code point -> symbol
        self.symbols = np.full(0x110000, NO_LETTER, np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.symbols[cp] = symbol.get(c.lower()[0], 0)

    def phrases(self, code_points: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, letters and, for each language, phrases of every text."""
        n = len(offsets) - 1
        sym = self.symbols[code_points]
        blank = sym == NO_LETTER
        letters = A.per_row(~blank, offsets)
        keep = np.ones(len(sym), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
        sizes = A.per_row(keep, offsets)
        sym = np.where(blank, 1, sym)[keep].astype(np.int32)
        at = np.concatenate([[0], np.cumsum(sizes)])
        # blocks of all texts, longest first; step t takes the t-th symbol of each
        per = -(-sizes // block)
        owner = np.repeat(np.arange(n), per)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = at[owner] + number * block
        length = np.minimum(block, at[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        langs = len(self.languages)
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.zeros((langs, len(owner)), np.int32)
        count = np.zeros((langs, len(owner)), np.int32)
        active = len(owner)
        for t in range(int(length[0]) if len(owner) else 0):
            active = int(np.searchsorted(-length[:active], -t, "left"))
            s = sym[start[:active] + t]
            to = np.take(self.table, state[:, :active] + s)
            dead = to == 0
            count[:, :active] += dead
            again = np.take(self.table, roots + s)
            np.copyto(to, again, where=dead)
            state[:, :active] = to
        total = np.zeros((langs, n))
        for k in range(langs):
            total[k] = np.bincount(owner, weights=count[k], minlength=n)
        return sizes, letters, total


def foreign_limits(sample: list[tuple[str, str]], folds: int = 4, least: int = 8, way: float = 0.75) -> tuple[dict[str, float], float]:
    """Phrases per symbol from which a text that a language wins is none of its texts, and the spread of the rates.

    Each part of the sample is parsed with the automata of the other parts, as it is and with its
    letters shuffled; a language's limit lies ``way`` of the way between the medians of the two.  A language with fewer
    than ``least`` texts has no limit."""
    texts = [(lang, t) for lang, t in ((lang, normalised(t)) for lang, t in sample) if t]
    own: dict[str, list[float]] = {}
    shuffled: dict[str, list[float]] = {}
    for k in range(folds):
        held = texts[k::folds]
        model = Model([x for i, x in enumerate(texts) if i % folds != k])
        held = [(lang, t) for lang, t in held if lang in model.languages]
        if not held:
            continue
        mixed = ["".join(random.Random(i).sample(t, len(t))) for i, (_, t) in enumerate(held)]
        for rates, parts in ((own, [t for _, t in held]), (shuffled, mixed)):
            points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
            sizes, _, total = model.phrases(points, np.cumsum([0] + [len(t) for t in parts]), 512)
            for i, (lang, _) in enumerate(held):
                rates.setdefault(lang, []).append(float(total[model.languages.index(lang), i] / sizes[i]))
    limits, spread = {}, [0.0]
    for lang, rates in own.items():
        if len(rates) >= least:
            a, b = np.median(rates), np.median(shuffled[lang])
            limits[lang] = float(a + way * (b - a))
            spread.append(float(np.std(rates)))
    return limits, max(spread)


def language_id(docs: DataFrame, sample: list[tuple[str, str]], keys: list[str] = ["doc_id"], text: str = "text", block: int = 512) -> DataFrame:
    """``keys``, ``lang_pred``, ``score`` and ``phrase_rate`` of every text.

    ``phrase_rate`` is the winner's phrases per symbol; ``score`` is 1 minus its ratio to the
    runner-up's (to 1 if there is one language only), from 0 for a tie upwards.
    """
    model = Model(sample)
    shared = A.Shared(docs.sparkSession, model)  # bounded by the sample
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrase_rate", DoubleType())]

    def predict(buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        m = shared.value
        n = len(offsets) - 1
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        sizes, letters, total = m.phrases(points, places, block)
        if not m.languages:
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.ones(n))]
        known = letters > 0
        rate = total / np.maximum(sizes, 1)
        best = np.argmin(rate, axis=0)
        ranked = np.sort(rate, axis=0)
        other = ranked[1] if len(m.languages) > 1 else np.ones(n)
        score = np.where(known, np.clip(1 - ranked[0] / np.maximum(other, 1e-12), 0, 1), 0.0)
        return [pa.array([m.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array(score, pa.float64()), pa.array(np.where(known, ranked[0], 1.0), pa.float64())]

    return A.per_text(docs, keys, text, fields, predict)


def with_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    return language_id(docs, labelled_sample(docs.filter(~held_out(A.quoted(key)) & A.quoted(key).isNotNull()), text, lang), [key], text)
