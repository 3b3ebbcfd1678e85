r"""Mixing sources to target weights, in DataFrame functions only.

The words of every document are counted and summed for each source.  The targets share ``share`` times all
words by the sources' weights; a source stops at ``limit`` times its own words, and what it leaves goes to the
others by weight, until none is above.  A source's repetition rate is its target divided by its words.
A document is taken floor(rate) times, and once more if a hash of its id and text, seeded for the source, falls
below the fraction.  Of ``seeds`` seeds each source uses the one whose draw comes nearest to its target.

Sources are ordered by code point, null last, and the weights repeat in that order.  Ranks and the sums of the
limits come from an ordered scan over blocks of sources, so the number of sources is not bounded by a task; the
words of a hot source are summed before they are shuffled.  The table of sources is stored and the
planner broadcasts it only below its size limit.

A null or empty text has 0 words and is taken 0 words.  Rows equal in id, text and source are one document with a
count n: it is taken floor(n * rate) times, and once more by the draw, spread evenly over the rows; no row is
taken more than ceil(rate) times.  A source without words, and an empty table, have the target 0.  Null ids are
ids.  Extra columns are ignored by ``allot`` and carried by ``emit``; in ``emit`` a result column wins over an extra
column of its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from ..session import shared_path
from ._arrow import quoted

WORD = r"[^\x20\x09-\x0D]++"
#: Rows of one repeated document that are made in one task.
ROWS_A_BLOCK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _version(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("-"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _documents(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(quoted(key).alias("id"), quoted(source).cast("string").alias("source"), n_words(quoted(text).cast("string")).alias("size"),
                       _version(quoted(text).cast("string")).alias("version"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``(source, source_size, target, rate)`` of a table ``(source, source_size)`` of different sources."""
    by_name = running(sizes.select("source", F.col("source_size").cast("long")), [], [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-names")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = by_name.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(limit)).alias("most"))
    everything = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, all_weights = everything[0] * float(share), everything[1]
    # by rising limit for a unit of weight: the sources that stop come first
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    scanned = running(rows, [], order, {"size_to": F.col("source_size"), "weight_to": F.col("weight")}, "mix-limits")
    left = F.lit(total) - (F.col("size_to") - F.col("source_size")) * float(limit)
    stops = F.col("most") * (F.lit(all_weights) - (F.col("weight_to") - F.col("weight"))) <= left * F.col("weight")
    marked = _stored(scanned.select("source", "source_size", "weight", "most", stops.alias("stops")), "mix-stops")
    full = marked.filter("stops").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    unit = (total - full[0] * float(limit)) / max(all_weights - full[1], 1)
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.least(F.col("weight") * F.lit(unit), F.col("most")))
    return marked.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _copies(trial: Column) -> Column:
    """Copies of a document with ``n`` rows: floor(n * rate), and the draw.  One digest serves four trials."""
    wanted = F.col("n") * F.col("rate")
    digest = F.md5(F.concat_ws(":", F.floor(trial / 4).cast("string"), F.col("id").cast("string"), "version"))
    drawn = F.conv(F.substr(digest, (trial % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))
    return (F.floor(wanted) + (drawn < wanted - F.floor(wanted)).cast("long")).cast("long")


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    named = table.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _planned(grouped: DataFrame, seed: int, seeds: int, **shares) -> DataFrame:
    """The table of sources with the ``seed`` that comes nearest to each target."""
    sizes = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    table = _stored(source_targets(sizes, **shares), "mix-targets")
    trials = F.sequence(F.lit(seed * seeds).cast("long"), F.lit(seed * seeds + seeds - 1).cast("long"))
    drawn = _with_source(grouped, table.select("source", "rate")).withColumn("seed", F.explode(trials))
    taken = drawn.groupBy("source", "seed").agg(F.sum(F.col("size") * _copies(F.col("seed"))).alias("taken"))
    off = F.struct(F.abs(F.col("taken") - F.col("target")).alias("off"), "seed")
    best = _with_source(taken, table).groupBy("source", "source_size", "target", "rate").agg(F.min(off)["seed"].alias("seed"))
    return _stored(best, "mix-seeds")


def _decided(docs: DataFrame, key: str, text: str, source: str, seed: int, seeds: int, shares: dict) -> DataFrame:
    counted = _stored(_documents(docs, key, text, source).groupBy("id", "version", "source").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-documents")
    table = _planned(counted, seed, seeds, **shares)
    return _with_source(counted, table).withColumn("copies", _copies(F.col("seed")))


def allot(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, seeds: int = 32, **shares) -> DataFrame:
    """``key, size, source_size, target, copies, taken`` of every row; ``shares`` are those of ``source_targets``."""
    groups = _decided(docs, key, text, source, seed, seeds, shares)
    last = F.floor((F.col("n") - 1) / ROWS_A_BLOCK).cast("long")
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("id", "version", "block")
    first = F.col("block") * ROWS_A_BLOCK + 1
    rows = blocks.withColumn("k", F.explode(F.sequence(first, F.least(F.col("n"), first + (ROWS_A_BLOCK - 1)))))
    copies = (F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")).cast("long")
    return rows.select(F.col("id").alias(key), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, seeds: int = 32, **shares) -> DataFrame:
    """The mixture: the columns of ``docs``, each document as often as it is taken, and ``copy`` (0, 1, ...).

    Of rows equal in id, text and source one stands for all."""
    groups = _decided(docs, key, text, source, seed, seeds, shares).filter("copies > 0").select("id", "version", "source", "copies")
    names = [c for c in docs.columns if c.lower() != "copy"]
    whole = docs.select(F.struct(*[quoted(c) for c in names]).alias("doc"), quoted(key).alias("id_"), quoted(source).cast("string").alias("source_"),
                        _version(quoted(text).cast("string")).alias("version_"))
    one = whole.groupBy("id_", "version_", "source_").agg(F.first("doc").alias("doc"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("version") == F.col("version_")) & F.col("source").eqNullSafe(F.col("source_"))
    last = F.floor((F.col("copies") - 1) / ROWS_A_BLOCK).cast("long")
    blocks = one.join(groups, same).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("block") * ROWS_A_BLOCK
    copy = F.explode(F.sequence(first, F.least(F.col("copies"), first + ROWS_A_BLOCK) - 1))
    return blocks.select(*[F.col("doc")[c].alias(c) for c in names], copy.alias("copy"))


ORACLE = r"""
WITH g AS (SELECT doc_id AS id, coalesce(md5(text), '-') AS version, source,
                  max(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS size, count(*) AS n
           FROM documents GROUP BY 1, 2, 3),
s AS (SELECT source, sum(size * n)::BIGINT AS source_size FROM g GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
a AS (SELECT sum(source_size)::DOUBLE * 1.5 AS total, sum(weight) AS weights FROM w),
r AS (SELECT w.*, sum(source_size) OVER o - source_size AS size_before, sum(weight) OVER o - weight AS weight_before FROM w
      WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
t AS (SELECT source, source_size, most, weight, most * (weights - weight_before) <= (total - size_before * 2.0::DOUBLE) * weight AS stops FROM r, a),
u AS (SELECT (any_value(total) - coalesce(sum(source_size) FILTER (stops), 0)::DOUBLE * 2.0::DOUBLE)
             / greatest(any_value(weights) - coalesce(sum(weight) FILTER (stops), 0), 1) AS unit FROM t, a),
q AS (SELECT source, source_size, CASE WHEN stops THEN most ELSE least(weight * unit, most) END AS target FROM t, u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM q),
d AS (SELECT g.*, source_size, target, n * rate AS wanted, k AS seed,
             ('0x' || substr(md5(concat_ws(':', (k // 4)::VARCHAR, id::VARCHAR, version)), (k % 4 * 8 + 1)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS drawn
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source, range(32) AS z(k)),
c AS (SELECT *, floor(wanted)::BIGINT + (drawn < wanted - floor(wanted))::BIGINT AS copies FROM d),
b AS (SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), seed) AS place
      FROM c GROUP BY source, seed)
SELECT c.id AS doc_id, size, source_size, target, copies // n + (x.k <= copies % n)::BIGINT AS copies, size * (copies // n + (x.k <= copies % n)::BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.seed = b.seed AND place = 1, LATERAL (SELECT unnest(range(1, c.n + 1)) AS k) AS x
"""
