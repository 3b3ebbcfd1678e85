"""Substring dedup over sliding sentence spans.

A text is cut into sentences (up to and with the next ``.``, ``!``, ``?`` or line end and the
blanks after it; the pieces joined are the text again).  Every run of one, two or three
consecutive sentences with enough words is hashed; equal runs meet in one aggregation over the
hash, whose smallest (document, position) is the first one.  Sentences that any other copy of
a repeated run covers are removed.  Single sentences count only when they are long, so that a
passage of one or two long sentences is found as well.

Hot runs: the aggregation is partial before the shuffle, and the join back is an equi-join that
adaptive execution splits.  Null texts stay null, empty ones empty.  Rows with the same key are
the same document: their equal runs are one occurrence.  A null key is the smallest.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import fresh, quoted

SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\f\x0b\n]*|[^.!?\n]+"
BLANKS = " \t\r\f\x0b\n"
#: Least words of a run of so many sentences.
RUNS = {1: 30, 2: 20, 3: 12}


def _sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def sentence_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", runs: dict[int, int] = RUNS) -> DataFrame:
    """``docs`` with later copies of repeated sentence runs removed from ``text``, and
    ``n_sentences``, ``n_removed``.  Of input columns that clash with these two, the counts win.
    """
    base = docs.select(quoted(key).alias("_key"), quoted(text).alias("_text"))
    trimmed = F.transform(_sentences(F.col("_text")), lambda s: F.btrim(s, F.lit(BLANKS)))
    words = F.transform(F.col("_s"), lambda s: F.when(s == "", 0).otherwise(
        F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1))
    parts = base.select("_key", trimmed.alias("_s")).filter(F.size("_s") > 0).select("_key", "_s", words.alias("_w"))

    def run(i: Column, k: int, least: int) -> Column:
        span = F.array_join(F.slice("_s", i + 1, F.lit(k)), "\n")
        total = sum((F.get("_w", i + j) for j in range(1, k)), F.get("_w", i))
        return F.when((i + k <= F.size("_s")) & (total >= least),
                      F.struct(F.xxhash64(span).alias("a"), F.xxhash64(F.lit(k), span).alias("b"),
                               i.cast("int").alias("pos"), F.lit(k).alias("k")))

    listed = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_s") - 1),
                                   lambda i: F.array_compact(F.array(*[run(i, k, n) for k, n in sorted(runs.items())]))))
    spans = parts.select("_key", F.explode(listed).alias("r")).select("_key", "r.a", "r.b", "r.pos", "r.k")
    at = F.struct("_key", "pos")
    repeated = (spans.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"))
                .filter(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first"))
    later = spans.join(repeated, ["a", "b"]).filter(~at.eqNullSafe(F.col("first")))
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    k, key_, cover, all_, kept_ = (fresh(n, [*docs.columns, "n_sentences", "n_removed"]) for n in ("_k", "_key", "_cover", "_all", "_kept"))
    covered = (later.groupBy("_key").agg(F.collect_set(F.struct("pos", "k")).alias("_runs"))
               .select(F.col("_key").alias(k), F.array_distinct(F.flatten(F.transform(
                   "_runs", lambda r: F.sequence(r["pos"], r["pos"] + r["k"] - 1)))).alias(cover)))
    joined = (docs.withColumn(key_, quoted(key)).join(covered, F.col(key_).eqNullSafe(F.col(k)), "left")
              .withColumn(all_, _sentences(quoted(text))))
    index = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: i < F.size(all_))
    kept = F.transform(F.array_except(index, cover), lambda i: F.get(all_, i))
    out = joined.withColumn(kept_, F.when(F.col(cover).isNull() | (F.size(all_) == 0), F.col(all_)).otherwise(kept))
    none = quoted(text).isNull()
    return out.select(
        *[F.array_join(kept_, "").alias(c) if c == text else quoted(c) for c in names],
        F.when(none, 0).otherwise(F.size(all_)).cast("long").alias("n_sentences"),
        F.when(none, 0).otherwise(F.size(all_) - F.size(kept_)).cast("long").alias("n_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\f\x0b\n]*|[^.!?\n]+') AS parts FROM documents),
s AS (SELECT doc_id, list_transform(parts, lambda x: trim(x, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))) AS s FROM d),
w AS (SELECT doc_id, s, list_transform(s, lambda x: CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END) AS n FROM s),
r AS (SELECT doc_id, pos - 1 AS pos, k, array_to_string(s[pos:pos + k - 1], chr(10)) AS span
      FROM (SELECT doc_id, s, n, unnest(range(1, len(s) + 1)) AS pos FROM w), (VALUES (1, 30), (2, 20), (3, 12)) AS v(k, least)
      WHERE pos + k - 1 <= len(s) AND list_sum(n[pos:pos + k - 1]) >= least),
f AS (SELECT k, span, min((doc_id, pos)) AS a, max((doc_id, pos)) AS b FROM r GROUP BY k, span),
c AS (SELECT r.doc_id, list_distinct(flatten(list(range(r.pos, r.pos + r.k)))) AS cover
      FROM r JOIN f ON r.k = f.k AND r.span = f.span WHERE f.a <> f.b AND (r.doc_id, r.pos) <> f.a GROUP BY r.doc_id)
SELECT doc_id, array_to_string(kept, '') AS text, len(parts) AS n_sentences, len(parts) - len(kept) AS n_removed
FROM (SELECT d.doc_id, parts, CASE WHEN cover IS NULL THEN parts ELSE list_transform(list_filter(range(0, len(parts)), lambda i: NOT list_contains(cover, i)), lambda i: parts[i + 1]) END AS kept
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
"""
