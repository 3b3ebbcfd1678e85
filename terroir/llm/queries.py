"""One query ``opN_<name>`` for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, language, lines, mixing, order, pieces, prefix_trie, quality, secrets, sentences, whitening

#: Vocabulary of the SentencePiece operator; read on the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sentences.sentence_dedup(docs).select("doc_id", "text", "n_sentences", "n_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.with_languages(docs)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), pieces.PieceModel(PIECE_MODEL))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialise(order.sequences_of_texts(_table(spark, sf_dir, "documents")), seed=20260101)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.integers(_table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), rebuild=prefix_trie.with_shared_starts)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_language_id, op3_line_dedup, op4_quality_rules, op5_secret_scan,
    op6_ngram_jaccard, op7_sentencepiece, op8_training_order, op9_html_text, op10_decontaminate,
    op11_source_mixing, op12_embedding_whitening, op13_prefix_trie)}
ORACLES = {"op1_substring_dedup": sentences.ORACLE, "op3_line_dedup": lines.ORACLE, "op10_decontaminate": decontaminate.ORACLE,
           "op11_source_mixing": mixing.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
