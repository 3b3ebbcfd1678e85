"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a line above the
boilerplate ratio is dropped from all pages of that host.  Lines are compared without outer
blanks; blank lines are never dropped.  Each page counts a line once, before anything is
shuffled; counting is a two-stage aggregation, so a hot host or line is no task of its own.

Copies of a page would make its own lines frequent.  ``copy_pages`` tells which rows of linked texts are one page and
which are pages of their own that share boilerplate: what is left of a page without the lines that are frequent among
different texts is, for a copy, a variant of those lines; for a page of its own it is new.

A null host is the host ``''``.  A null text stays null and holds no line; an empty one stays
empty.  Repeated rows count as pages of their own, unless ``pages`` says which rows are copies of
one page.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import quoted

BLANKS = " \t\r\f\x0b"
#: Words of a shingle by which a page's own lines are told from variants of others.
OWN_WIDTH = 3


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _host(host: str) -> Column:
    return F.coalesce(quoted(host).cast("string"), F.lit(""))


def _page_lines(docs: DataFrame, key: str, text: str, host: str, *more: Column) -> DataFrame:
    """``(host, key, line)``: a hash of each different line of a row."""
    hashes = F.transform(F.filter(F.transform(F.split(quoted(text), "\n"), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x))
    return docs.select(_host(host).alias("host"), quoted(key).alias("key"), *more, F.explode(F.array_distinct(hashes)).alias("line"))


def _frequent(counted: DataFrame, total: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """The lines of more than ``ratio`` of a host's ``pages``, and of ``min_pages`` at least; ``counted`` has a row for each page and line."""
    return (counted.groupBy("host", "line").agg(F.count(F.lit(1)).alias("with")).filter(F.col("with") >= min_pages).join(total, "host")
            .filter(F.col("with") > F.lit(float(ratio)) * F.col("pages")).select("host", "line"))


def _hits(page_lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(hit_host, hit_key, drop)``: the frequent lines of each row that has some."""
    return (page_lines.select("host", "key", "line").join(frequent, ["host", "line"]).groupBy("host", "key")
            .agg(F.collect_set("line").alias("drop")).withColumnsRenamed({"host": "hit_host", "key": "hit_key"}))


_HIT = lambda: (F.col("host") == F.col("hit_host")) & F.col("key").eqNullSafe(F.col("hit_key"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
               ratio: float = 0.1, min_pages: int = 5, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and ``n_lines``, ``n_dropped``.

    A line is boilerplate if more than ``ratio`` of its host's pages, and at least ``min_pages`` of
    them, contain it.  ``pages`` has a row ``(key, page)`` for each key: rows of one page and host count
    once, and a line counts if any of them contains it.  Columns of ``docs`` keep their names and order; of columns that clash with
    the two counts, the counts win.
    """
    page_lines = _page_lines(docs, key, text, host)
    rows = docs.select(_host(host).alias("host"), quoted(key).alias("key"))
    if pages is None:
        total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
        counted = page_lines
    else:
        of = pages.select(quoted("key").alias("page_key"), F.xxhash64("page").alias("page"))
        same = F.col("key").eqNullSafe(F.col("page_key"))
        total = rows.join(of, same).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
        counted = page_lines.join(of, same).select("host", "line", "page").distinct()
    hits = _hits(page_lines, _frequent(counted, total, ratio, min_pages))
    # the row travels as one column, so that its names meet no other
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(F.struct(*[quoted(c) for c in names]).alias("doc"), _host(host).alias("host"), quoted(key).alias("key")).join(hits, _HIT(), "left")
    body = F.col("doc")[text]
    lines = F.split(body, "\n")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains("drop", F.xxhash64(_trimmed(x)))))
    out = joined.withColumn("kept", kept)
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return out.select(
        *[F.array_join("kept", "\n").alias(c) if c == text else F.col("doc")[c].alias(c) for c in names],
        F.when(body.isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(body.isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"))


def _shingles(lines: Column, width: int) -> Column:
    """Hashes of ``width`` successive words of a line; of the whole line if it has fewer."""
    def of(line: Column) -> Column:
        words = F.filter(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))

    return F.array_distinct(F.flatten(F.transform(F.filter(lines, lambda x: _trimmed(x) != ""), of)))


def copy_pages(docs: DataFrame, links: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
               ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``(key, page)`` of every row of ``links (key, component)``: copies are one page, other rows pages of their own.

    Of rows in one component, a row is a page of its own if it has lines that are frequent among the different texts
    of its host, and most word triples of the rest occur in no such line.  Rows that have none, or whose rest is empty or mostly
    made of such triples, are copies of one page."""
    page_lines = _page_lines(docs, key, text, host, F.xxhash64(quoted(text)).alias("page"))
    texts = docs.select(_host(host).alias("host"), F.xxhash64(quoted(text)).alias("page")).distinct()
    total = texts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    frequent = _frequent(page_lines.select("host", "line", "page").distinct(), total, ratio, min_pages)
    linked = links.select(quoted("key").alias("link_key"), "component")
    groups = linked.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("component").alias("group"))
    members = linked.join(groups, F.col("component").eqNullSafe(F.col("group"))).select("link_key").distinct()
    # rows of groups with frequent lines only
    some = _hits(page_lines, frequent).join(members, F.col("hit_key").eqNullSafe(F.col("link_key")), "left_semi")
    bodies = docs.select(_host(host).alias("host"), quoted(key).alias("key"), F.split(quoted(text), "\n").alias("lines")).join(some, _HIT())
    dropped = lambda x: F.array_contains("drop", F.xxhash64(_trimmed(x)))
    parts = bodies.select("host", "key", _shingles(F.filter("lines", dropped), OWN_WIDTH).alias("cut"), _shingles(F.filter("lines", lambda x: ~dropped(x)), OWN_WIDTH).alias("rest"))
    known = parts.select("host", F.explode("cut").alias("shingle")).distinct().withColumn("known", F.lit(1))
    rest = parts.select("host", "key", F.explode("rest").alias("shingle")).join(known, ["host", "shingle"], "left")
    own = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k")).filter("2 * k < n").select(F.col("key").alias("own_key"))
    marked = linked.join(own, F.col("link_key").eqNullSafe(F.col("own_key")), "left")
    is_own = F.col("own_key").isNotNull()
    return marked.select(F.col("link_key").alias("key"), F.struct(is_own.alias("own"), F.when(is_own, F.col("link_key")).otherwise(F.col("component")).alias("of")).alias("page"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, chr(32)||chr(9)||chr(13)||chr(12)||chr(11))), lambda x: x <> ''))) AS line FROM d),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
f AS (SELECT host, list(line) AS drops FROM (SELECT l.host, line, count(*) AS n, any_value(pages) AS pages FROM l JOIN p ON l.host = p.host GROUP BY l.host, line)
      WHERE n >= 5 AND n > 0.1 * pages GROUP BY host)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped
FROM (SELECT d.doc_id, lines, CASE WHEN drops IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drops, trim(x, chr(32)||chr(9)||chr(13)||chr(12)||chr(11)))) END AS kept
      FROM d LEFT JOIN f ON d.host = f.host)
"""
