import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import moved_bytes, odd_documents, words
from tokenizers import Tokenizer

import corpus_pipeline
from clickloom.llm.text import stored, tokenizer_file
from clickloom.session import fresh_folder

SF_DIR = "/root/testdata/sf0.001"
CLEAN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage has made of the test table."""
    docs, made = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs, stored(stage(spark, docs, SF_DIR), name))
        docs = made[name][1]
    return made


def ids(frame):
    return {row[0] for row in frame.select("doc_id").collect()}


def test_filters_keep_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = ids(labels.filter("quality = 1"))
    for name in ("quality_rules", "quality_classifier"):
        before, after = stages[name]
        assert after.columns == CLEAN
        short = ids(before.filter(F.size(F.split(F.trim("text"), r"\\s+")) < 50))
        lost = (ids(before) - ids(after)) & (good - short)
        assert len(lost) <= 0.1 * len(ids(before) & good)


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    best = before.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
    assert ids(after) == ids(best)
    assert after.columns == CLEAN


def test_exact_stage_keeps_one_row(spark):
    """Of rows that repeat id and text, and of equal texts whose ids are all NULL or partly."""
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (3, "c"), (None, "c")]
    rows += [(2, "d"), (4, None), (4, ""), (5, "e"), (None, "f")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id bigint, text string, kept string")
    after = corpus_pipeline.exact_dedup(spark, docs.repartition(3), SF_DIR)
    assert after.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"] or "") for r in after.collect()), key=repr)
    expected = [(2, "a"), (None, "b"), (3, "c"), (2, "d"), (4, ""), (5, "e"), (None, "f")]
    assert found == sorted(expected, key=repr)


def test_near_stage(stages):
    from test_ngram_join import brute

    before, after = stages["ngram_join"]
    rows = [tuple(row) for row in before.select("doc_id", "text").collect()]
    assert ids(after) == {doc_id for doc_id, _, component in brute(rows) if doc_id == component}
    assert after.columns == CLEAN


def test_packing_stage(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    expected = {
        row["doc_id"]: np.array(tokenizer.encode(row["text"], add_special_tokens=False).ids + [1], "<u4")
        for row in before.collect()
    }
    covered = dict.fromkeys(expected, 0)
    for piece in after.collect():
        part = expected[piece["doc_id"]][piece["start"] : piece["start"] + piece["length"]]
        assert zlib.crc32(part.tobytes()) == piece["ids_crc32"]
        covered[piece["doc_id"]] += piece["length"]
    assert covered == {doc_id: len(tokens) for doc_id, tokens in expected.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_every_stage(spark, empty):
    docs = odd_documents(spark)
    if empty:
        docs = docs.limit(0)
    folder = fresh_folder(spark, "labels-of")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    given = {tuple(row) for row in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
            # Rows come back as they were, columns that operators use names of included.
            assert {tuple(row) for row in docs.collect()} <= given
    assert docs.isEmpty() == empty


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[:4]])
def test_stages_alone_give_rows_back_as_they_were(spark, stage):
    docs = odd_documents(spark)
    after = stage(spark, docs, SF_DIR)
    assert after.columns == docs.columns
    assert {tuple(row) for row in after.collect()} <= {tuple(row) for row in docs.collect()}


def test_near_stage_compares_rows_that_repeat_an_id(spark):
    first, second = (" ".join(f"{name}{i}" for i in range(80)) for name in "ab")
    rows = [(1, first), (1, second), (0, second + " more"), (None, first + " more"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    after = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert sorted(map(tuple, after.collect()), key=repr) == sorted([rows[2], rows[3], rows[4]], key=repr)


def test_near_stage_leaves_texts_that_stay_where_they_are(spark):
    texts = [" ".join(words(400, i, 10**6)) for i in range(200)]
    texts += [f"{text} more" for text in texts[::20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        after = corpus_pipeline.near_dedup(spark, stored(docs, "documents"), SF_DIR)
        assert ids(after) == set(range(200)) and after.count() == 200
        assert moved_bytes(after) < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set(conf, before)
