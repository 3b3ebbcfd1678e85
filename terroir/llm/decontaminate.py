"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Items are cut into windows of ``width`` consecutive words (a shorter item is one window).  The
training frequency of every benchmark word is counted over all documents; each window opens the
posting lists of its two rarest words only.  The lists are intersected after subtracting each
word's offset in the window, so that both must give the same start, and what remains is compared
word by word with the document.

Postings are stored (checkpointed) for the words that some window opens; they grow with the
corpus and are never broadcast.  The benchmark's words are broadcast only up to
``BROADCAST_WORDS`` of them, beyond it the same joins shuffle.  Counts and joins are keyed by
word, document and position; a frequent word is only opened by windows that hold no rarer one.

A null text has no words, a null or wordless item no window.  Rows are told apart by their id
and a hash of their text, so a repeated row gives the same result again and a null id is an id
like any other.  Empty tables give documents without hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import fresh, quoted

#: Parts of a text between words; upper-case ASCII letters belong to words and are lowered later.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_WORDS = 1_000_000


def _parts(text: Column) -> Column:
    """Words in their own case; the first and the last part may be empty."""
    return F.split(F.coalesce(text, F.lit("")), GAP)


def _low(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def windows_of(items: DataFrame, key: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """``item`` (as string), ``window`` (its number over all items' rows) and ``words`` of every window."""
    words = F.filter(F.transform(_parts(quoted(text)), _low), lambda w: w != "")
    rows = items.select(quoted(key).cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("words"))
            .distinct().withColumn("window", F.xxhash64("item", "words")))


def _tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    base = docs.select(quoted(key).alias("id"), F.xxhash64(quoted(text)).alias("version"), _parts(quoted(text)).alias("parts"))
    return base.select("id", "version", F.posexplode("parts").alias("pos", "word")).select(
        "id", "version", "pos", F.xxhash64(_low(F.col("word"))).alias("term"))


def _opened(terms: DataFrame, size: int) -> DataFrame:
    return F.broadcast(terms) if size <= BROADCAST_WORDS else terms


def build_index(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings ``(term, id, version, pos)`` of the words that some window opens, stored, and the
    windows with the hashes and offsets of their two rarest words ``(h1, o1, h2, o2)``."""
    placed = windows.select("window", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word")).withColumn(
        "term", F.xxhash64("word"))
    vocabulary = placed.select("term").distinct()
    tokens = _tokens(docs, key, text)
    size = vocabulary.count()
    frequency = tokens.select("term").join(_opened(vocabulary, size), "term").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    ranked = (placed.join(frequency, "term").groupBy("window", "n")
              .agg(F.array_sort(F.collect_list(F.struct("tf", "offset", "term"))).alias("r")).filter(F.size("r") == F.col("n")))
    second = F.element_at("r", F.least(F.lit(2), F.col("n")))
    chosen = ranked.select("window", F.col("r")[0]["term"].alias("h1"), F.col("r")[0]["offset"].alias("o1"),
                           second["term"].alias("h2"), second["offset"].alias("o2"))
    chosen = windows.join(chosen, "window").checkpoint()
    terms = chosen.select(F.explode(F.array("h1", "h2")).alias("term")).distinct()
    return tokens.join(_opened(terms, size), "term").select("term", "id", "version", "pos").checkpoint(), chosen


def near_matches(postings: DataFrame, chosen: DataFrame, slack: int) -> DataFrame:
    """Proximity matches ``(id, version, item, window, start, shift)``: the two rarest words of a
    window in a document, up to ``slack`` places from where the window has them."""
    first = _first_words(postings, chosen)
    other = postings.select(F.col("term").alias("h2"), F.col("id").alias("id2"), F.col("version").alias("version2"), F.col("pos").alias("pos2"))
    shift = F.col("pos2") - F.col("o2") - F.col("start")
    return (first.join(other, (first["h2"] == other["h2"]) & first["id"].eqNullSafe(other["id2"])
                       & (first["version"] == other["version2"]) & F.abs(shift).between(0, slack))
            .select("id", "version", "item", "window", "start", shift.alias("shift")))


def _first_words(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    return (postings.join(chosen, postings["term"] == chosen["h1"]).filter(F.col("pos") >= F.col("o1"))
            .select("id", "version", "item", "window", "words", "h2", "o2", (F.col("pos") - F.col("o1")).alias("start")))


def candidates(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(id, version, item, words, start)`` where both lists agree after their offsets are subtracted."""
    first = _first_words(postings, chosen)
    other = postings.select(F.col("term").alias("h2"), F.col("id").alias("id2"), F.col("version").alias("version2"), F.col("pos").alias("pos2"))
    return (first.join(other, (first["h2"] == other["h2"]) & first["id"].eqNullSafe(other["id2"]) & (first["version"] == other["version2"])
                       & (first["start"] + first["o2"] == other["pos2"]), "left_semi")
            .select("id", "version", "item", "words", "start"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = 10) -> DataFrame:
    """``docs`` with ``n_words``, ``matches`` (array of item and start and length in words) and
    ``n_hit`` (words inside a match); clashing columns of ``docs`` are replaced."""
    windows = windows_of(items, item_key, item_text, width).checkpoint()
    postings, chosen = build_index(docs, windows, key, text)
    own = [c for c in docs.columns if c not in ("n_words", "matches", "n_hit")]
    key_, version, id_, v, c_, p = (fresh(n, [*own, "n_words", "matches", "n_hit"]) for n in ("_key", "_version", "_id", "_v", "_c", "_p"))
    found = (candidates(postings, chosen).groupBy("id", "version")
             .agg(F.collect_list(F.struct("item", "start", "words")).alias(c_)).withColumnsRenamed({"id": id_, "version": v}))
    rows = docs.select(*[quoted(c) for c in own], quoted(key).alias(key_), F.xxhash64(quoted(text)).alias(version))
    rows = rows.join(found, F.col(key_).eqNullSafe(F.col(id_)) & (F.col(version) == F.col(v)), "left")
    rows = rows.withColumn(p, _parts(quoted(text)))
    empty = F.when(F.element_at(p, 1) == "", 1).otherwise(0) + F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    same = F.filter(c_, lambda c: F.transform(F.slice(p, c["start"] + 1, F.size(c["words"])), _low) == c["words"])
    lead = F.when(F.element_at(p, 1) == "", 1).otherwise(0)
    matches = F.when(F.col(c_).isNotNull(), F.array_sort(F.transform(same, lambda c: F.struct(
        c["item"].alias("item"), (c["start"] - lead).alias("start"), F.size(c["words"]).alias("length")))))
    rows = rows.withColumn("matches", F.coalesce(matches, F.lit([]).cast("array<struct<item:string,start:int,length:int>>")))
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))))
    return rows.select(*[quoted(c) for c in own], (F.size(p) - empty).cast("long").alias("n_words"), "matches",
                       F.when(F.size("matches") == 0, 0).otherwise(hit).cast("long").alias("n_hit"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS span FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
h AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id
"""
