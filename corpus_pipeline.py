"""From raw documents to packed sequences: filter, deduplicate, pack.

Each stage takes what the one before has kept, as a stored table, and reads no other state but the
labels.

What holds for all stages: documents have doc_id, text, lang, source and n_chars, and may have any
other columns, which filtering stages give back as they were, whatever their names. NULL text counts
as empty and a NULL doc_id as an id smaller than all others. Rows that repeat a doc_id are judged
each by its own text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import cotraining, quality_rules
from clickloom.llm.ngram_join import near_duplicates, with_perhaps
from clickloom.llm.packing import PACKED, pack
from clickloom.llm.radix_dedup import radix_groups
from clickloom.llm.text import stored, tokenizer_file, whole_text
from clickloom.session import set_folder_if_unset


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


USED = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose other columns have names that no operator uses, and the way back."""
    own = {name: f"given {i}" for i, name in enumerate(docs.columns) if name not in USED}
    return docs.withColumnsRenamed(own), {given: name for name, given in own.items()}


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with cutoffs learned from the labels among them.

    Documents without words fail; a NULL lang is a stratum of its own. Without labels the base rules
    decide alone.
    """
    docs, names = _apart(docs)
    narrow = quality_rules.measure(docs.select("doc_id", "lang", "text")).drop("text")
    cutoffs = quality_rules.fit_cutoffs(stored(narrow, "measured"), _labels(spark, sf_dir))
    judged = quality_rules.judge(quality_rules.measure(docs), cutoffs)
    return judged.filter("kept").select(docs.columns).withColumnsRenamed(names)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good; all, if labels lack a class.

    NULLs in lang, source and n_chars are values of their own.
    """
    docs, names = _apart(docs)
    model = cotraining.fit(docs, _labels(spark, sf_dir))
    kept = cotraining.score(docs, model).filter("kept")
    return kept.select(docs.columns).withColumnsRenamed(names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; one row, also if rows repeat doc_id
    and text or all ids are NULL (which row's other columns stay is then open)."""
    docs, names = _apart(docs)
    kept = stored(
        radix_groups(docs)
        .filter("kept")
        .groupBy(F.col("doc_id").alias("id"), "text_sha256")
        .agg(F.count("*").alias("times")),
        "kept",
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (
        F.sha2(whole_text(), 256) == F.col("text_sha256")
    )
    once = docs.join(kept.filter("times = 1"), same, "left_semi")
    repeated = kept.filter("times > 1")
    if repeated.isEmpty():
        return once.withColumnsRenamed(names)
    # Only these rows are grouped, so that other texts are not shuffled for it.
    one = F.struct("*").alias("row")
    rows = docs.join(repeated, same, "left_semi").select(
        F.col("doc_id").alias("id"), F.sha2(whole_text(), 256).alias("sha"), one
    )
    first = rows.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(first).withColumnsRenamed(names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity, the one with the smallest doc_id.

    Where rows repeat a doc_id, or more than one has none, they are numbered in order of doc_id (NULL
    first) and text, and compared under these numbers, so that each row is a document of its own.
    Texts of most documents that stay are not shuffled: only the others are looked up.
    """
    docs, names = _apart(docs)
    numbered = docs.withColumn("number", F.col("doc_id").cast("bigint"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        ordered = docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        numbered = stored(ordered.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"))
    others = found.filter("not doc_id <=> component_id").select(F.col("doc_id").alias("number"))
    others = stored(others, "near-copies")
    looked = with_perhaps(numbered, others, "number")
    rest = looked.filter("perhaps").join(others, "number", "left_anti")
    kept = looked.filter("not perhaps").unionByName(rest)
    return kept.select(docs.columns).withColumnsRenamed(names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of all rows; other columns are left out."""
    # Workers still hold what earlier stages left, so they remember fewer words than op6's do.
    return pack(docs, tokenizer_file("word_bpe_49k.json"), most_words=1 << 19).select(PACKED)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("packing", packing),
]

ORACLE_SQL = None  # binomial cutoffs, a trained classifier and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored in the shared folder and read back."""
    set_folder_if_unset(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
