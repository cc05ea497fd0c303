"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import cotraining, language_model, pieces, quality_rules
from clickloom.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from clickloom.llm.line_dedup import LINES_SQL, dedup_lines
from clickloom.llm.ngram_join import near_duplicates
from clickloom.llm.packing import PACKED, pack
from clickloom.llm.passages import dedup_passages
from clickloom.llm.prefix_trie import PREFIX_TRIE_SQL, prefix_trie
from clickloom.llm.quotes import link_quotes
from clickloom.llm.radix_dedup import RADIX_SQL, radix_groups
from clickloom.llm.text import stored, tokenizer_file
from clickloom.llm.warc import WARC_SQL, read_archives, write_archives
from clickloom.session import fresh_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stored(quality_rules.measure(documents).drop("text"), "measured")
    cutoffs = quality_rules.fit_cutoffs(measured, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = cotraining.fit(documents, _table(spark, sf_dir, "labels"))
    scored = cotraining.score(documents, model)
    return scored.select("doc_id", "p_text", "p_page", "p_quality", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_groups(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.encode(documents, model, with_decoded=True).select(
        "doc_id",
        "ids",
        "n_pieces",
        "n_byte_pieces",
        "log_score",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).select(PACKED)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language_model.score(documents, language_model.file_blocks())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(_table(spark, sf_dir, "pages"), fresh_folder(spark, "archives"))

    def page(record: str):
        return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")

    return read_archives(manifest, with_payload=False).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op5_quality_classifier": op5_quality_classifier,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_sentencepiece": op4_sentencepiece,
        "op7_quotation_linking": op7_quotation_linking,
        "op6_packing": op6_packing,
        "op8_ngram_join": op8_ngram_join,
        "op9_language_model": op9_language_model,
        "op10_warc": op10_warc,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": LINES_SQL,
        "op3_exact_dedup": RADIX_SQL,
        "op10_warc": WARC_SQL,
        "op11_prefix_trie": PREFIX_TRIE_SQL,
        "op13_hard_negatives": HARD_NEGATIVES_SQL,
    }
