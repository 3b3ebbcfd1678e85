"""The corpus pipeline: from raw documents to token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor kept, is written as
Parquet and read again.  All but the last return the columns of ``documents``.

1. language_id: documents in none of the learned languages go (no text or letter, or a text whose
   winner needs phrases nearer to those of shuffled letters than to those of its own texts, by a limit
   learned for each language of eight or more labelled texts); ``lang`` becomes the prediction.
2. line_dedup: boilerplate lines of a source are cut out of the texts.  Documents that stage 3's measure
   links as they come in are one page, unless what they do not share as lines is new: a group of copies makes
   no line boilerplate by its size, and different pages of much boilerplate lose it and stay.
3. near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more over shingles of five
   words, the one with the smallest id (then text hash; a null id is the smallest) stays.
4. decontaminate: documents with a benchmark passage go.
5. sentencepiece: token ids of the texts.

Null and empty texts go in stage 1.  Repeated rows are duplicates: stage 3 keeps one.  Columns beyond
those of ``documents`` are dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terroir.llm import decontaminate as _decontaminate
from terroir.llm import jaccard, language, lines, pieces
from terroir.llm._arrow import among
from terroir.llm.queries import PIECE_MODEL
from terroir.session import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of fewer symbols is too short to be called foreign.
FOREIGN_SYMBOLS = 40
#: Rates of texts shorter than the learned excerpts vary more; so many of their deviations are granted.
EXCERPT, DEVIATIONS = 256, 3.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    sample = language.labelled_sample(docs, excerpt=EXCERPT)
    limits, spread = language.foreign_limits(sample)
    found = language.language_id(docs, sample, COLUMNS)
    kept = found.filter(F.col("lang_pred") != language.UNKNOWN)
    if limits:
        # a language without a limit keeps what it wins
        limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])[F.col("lang_pred")]
        granted = DEVIATIONS * spread * (F.sqrt(EXCERPT / F.least(F.length("text"), F.lit(EXCERPT))) - 1)
        kept = kept.filter(~F.coalesce((F.length("text") >= FOREIGN_SYMBOLS) & (F.col("phrase_rate") >= limit + granted), F.lit(False)))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    # a row is its id and its text's hash: ids may be null or repeat
    return docs.select(*COLUMNS).withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("version")))


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    links = jaccard.jaccard_join(rows, key="row", width=5, percent=80)
    # a group is asked for more than once
    linked = _stored(spark, links.select(F.col("row").alias("key"), F.col("component_id").alias("component")).distinct(), "links")
    pages = _stored(spark, lines.copy_pages(rows, linked, key="row"), "pages")
    cleaned = lines.line_dedup(rows, key="row", pages=pages)
    return cleaned.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    links = _stored(spark, jaccard.jaccard_join(rows, key="row", width=5, percent=80).select("row", "component_id"), "links")
    is_kept = F.col("row").eqNullSafe(F.col("component_id"))
    kept = links.filter(is_kept).select("row").distinct()
    # a row that is neither linked with a smaller one nor repeated stays as it is; the texts of the others are shuffled
    other = links.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min(is_kept).alias("kept")).filter("n > 1 or not kept").select("row")
    marked = among(rows, F.col("row"), _stored(spark, other, "other"), "other")
    # a struct is never null itself and its null fields are equal; join and grouping share one shuffle of the texts
    met = marked.filter("other").join(kept, "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select(*[F.col(f"r.{c}") for c in COLUMNS])
    return marked.filter("not other").select(*COLUMNS).unionByName(met)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _decontaminate.decontaminate(docs.select(*COLUMNS), items).filter("n_hit = 0").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs, pieces.PieceModel(PIECE_MODEL))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: Cross-parsing and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
