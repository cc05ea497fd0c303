import hashlib

import numpy as np
import pytest
from texts import collected, odd_documents, texts_of, words

import __spark_entry__ as driver
from clickloom.llm.passages import Words, dedup_passages, passages

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_text"]
SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def split(text):
    for space in SPACE:
        text = (text or "").replace(space, " ")
    return [word for word in text.split(" ") if word]


def brute(rows, width=20):
    """Of rows in order of doc_id (NULL first), unique ids assumed."""
    seen, result = set(), []
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        own = split(text)
        gone = [False] * len(own)
        for at in range(len(own) - width + 1):
            window = tuple(own[at : at + width])
            if window in seen:
                gone[at : at + width] = [True] * width
            seen.add(window)
        kept = " ".join(word for word, drop in zip(own, gone, strict=True) if not drop)
        result.append((doc_id, len(own), sum(gone), kept))
    return sorted(result, key=repr)


SMALL = [
    {},
    {"chunk_bytes": 300, "shard_words": 30},
    {"chunk_docs": 1},
    {"width": 1},
    {"width": 3, "chunk_docs": 4},
]


@pytest.mark.parametrize("sizes", SMALL)
def test_odd_documents(spark, sizes):
    docs = odd_documents(spark, repeat=False)
    found = collected(dedup_passages(docs, **sizes), *COLUMNS)
    assert found == brute(texts_of(docs), sizes.get("width", 20))


@pytest.mark.parametrize("sizes", SMALL[:3])
def test_overlapping_and_periodic_passages(spark, sizes):
    """Windows whose earlier places differ: parts of passages, cut and joined in other ways."""
    chance = np.random.default_rng(1)
    common = words(400, 7, 5000)
    rows = []
    for doc in range(120):
        text = words(30, 100 + doc, 50)
        for _ in range(int(chance.integers(0, 4))):
            start, size = int(chance.integers(0, 380)), int(chance.integers(5, 120))
            text += common[start : start + size]
            text += words(int(chance.integers(0, 3)), doc, 9)
        if doc % 17 == 0:
            text += ["again", "and"] * 40
        if doc % 19 == 0:
            text += ["on"] * 70
        rows.append((int(doc * 37 % 120) - 20, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert collected(dedup_passages(docs, **sizes), *COLUMNS) == brute(rows)


def test_a_third_are_copies(spark):
    same = " ".join(words(90, 3, 10_000))
    rows = [(i, same if i % 3 == 0 else " ".join(words(80, 1000 + i, 10_000))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = collected(dedup_passages(docs, chunk_docs=20), *COLUMNS)
    assert found == brute(rows)
    assert sum(1 for _, n, gone, _ in found if n == gone) == 99


def test_rows_repeating_a_doc_id(spark):
    """Each is a document; of equal ones one keeps its words, the others lose them."""
    text = " ".join(words(40, 5, 10_000))
    docs = spark.createDataFrame([(1, text)] * 3 + [(1, "a b c")], "doc_id bigint, text string")
    found = collected(dedup_passages(docs.repartition(3)), *COLUMNS)
    assert found == sorted([(1, 40, 0, text), (1, 40, 40, ""), (1, 40, 40, ""), (1, 3, 0, "a b c")], key=repr)


def test_empty_table(spark):
    assert dedup_passages(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query(spark):
    """The registered query on all documents of the smallest tables."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = [
        (doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for doc_id, n, gone, kept in brute(texts_of(docs))
    ]
    found = driver.queries()["op12_substring_dedup"](spark, SF_DIR)
    assert found.columns == [*COLUMNS[:3], "kept_sha256"]
    assert collected(found, *found.columns) == sorted(expected, key=repr)
    assert any(gone for _, _, gone, _ in expected)


def test_the_text_moves_once(spark, capsys):
    """Chunks are read as buckets: no exchange of texts, only of answers."""
    rows = [(i, " ".join(words(40, i, 1000))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    dedup_passages(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan
    assert plan.count("SelectedBucketsCount") == 1


def test_passages_are_stretches_found_together():
    own = words(60, 11, 10_000)
    texts = [" ".join(own), " ".join(own[10:40] + ["x"] + own[45:60]), " ".join(own[:30])]
    chunk = Words([1, 2, 3], [text.encode() for text in texts], 5)
    start, end = passages(chunk, np.zeros(len(chunk.first), bool))
    assert [(int(chunk.place[a]), int(b - a)) for a, b in zip(start, end, strict=True)] == [
        (0, 10), (10, 16), (26, 10), (45, 11)
    ]
