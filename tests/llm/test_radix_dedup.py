import hashlib
from collections import defaultdict

import pytest
from texts import collected, odd_documents, texts_of

from clickloom.llm import radix_dedup
from clickloom.llm.radix_dedup import radix_groups
from clickloom.llm.text import stored

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    result = []
    for doc_id, text in rows:
        same = groups[text or ""]
        keep = max((i for i in same if i is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        result.append((doc_id, keep, len(same), doc_id == keep, sha))
    return sorted(result, key=repr)


@pytest.mark.parametrize("digits", [{}, {"first": 1, "growth": 40}, {"first": 4, "growth": 4, "widest": 20_000}])
def test_odd_documents(spark, digits):
    docs = odd_documents(spark)
    assert collected(radix_groups(docs, **digits), *COLUMNS) == brute(texts_of(docs))


def test_hot_group_and_long_common_prefixes(spark):
    rows = [(i, "the same text " * 20 + (str(i % 50) if i % 3 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert collected(radix_groups(docs, first=8, growth=4), *COLUMNS) == brute(rows)


def test_rounds_grow_with_the_logarithm_of_the_length(spark, monkeypatch):
    rounds = []

    def counted(frame, purpose):
        rounds.append(purpose)
        return stored(frame, purpose)

    monkeypatch.setattr(radix_dedup, "stored", counted)
    long = "0123456789abcdef" * (1 << 18)  # 4 MiB
    rows = [(1, long), (2, long), (3, long), (4, long[:-1] + "x"), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collected(radix_groups(docs), *COLUMNS) == brute(rows)
    assert rounds.count("radix-groups") == 5  # of 64 B, 2 KiB, 64 KiB, 2 MiB, and the rest


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert radix_groups(docs).collect() == []
