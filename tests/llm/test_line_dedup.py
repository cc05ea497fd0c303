import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F
from texts import collected, odd_documents, texts_of

from clickloom.llm.line_dedup import HASH, LineRuns, dedup_lines, sorted_buckets


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        line = re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), line)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 if doc_id is None else doc_id)
    result = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if len(holders[key(line)]) < min_docs
            or max(holders[key(line)]) == (-1 if doc_id is None else doc_id)
        ]
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=repr)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = dedup_lines(docs, batches=4, fanout=2)
    assert collected(found, "doc_id", "n_lines", "n_dropped", "kept_text") == brute(texts_of(docs))
    assert set(docs.columns) < set(found.columns)
    assert not any(name.startswith("_") for name in set(found.columns) - set(docs.columns))


def test_hot_line_and_many_batches(spark):
    rows = [
        (i, f"{'A line that a third of all rows have' if i % 3 == 0 else 'x'}\n{i % 7} of seven lines, long"
            f"\n\nline {i // 2} comes in pairs, so it stays\nOWN line, long enough, number {i}")
        for i in range(300)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for batches, fanout in ((1, 2), (7, 2), (7, 3)):
        found = dedup_lines(docs, batches=batches, fanout=fanout, bucket_lines=100)
        assert collected(found, "doc_id", "n_lines", "n_dropped", "kept_text") == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dedup_lines(docs).collect() == []


def test_runs_are_compacted_and_settled_keys_not_added(spark):
    runs = LineRuns(spark, 2, fanout=2, min_docs=2)
    lines = spark.range(10).select(
        F.col("id").alias("h1"), F.col("id").alias("h2"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_doc")
    )
    for batch in range(4):
        runs.add(lines.filter(F.col("h1") >= 2 * batch))
        assert [len(level) for level in runs.levels] == [[1], [0, 1], [1, 1], [0, 0, 1]][batch]
    totals = runs.totals()
    assert totals.count() == 10
    # All keys are settled by the first batch, so later ones have added nothing.
    assert {(r["n_docs"], r["keeper"], r["arrived"]) for r in totals.collect()} == {(3, 3, 0)}
    assert set(HASH) < set(totals.columns)
    runs.forget()


def test_runs_are_neither_moved_nor_sorted(spark):
    """The batch is dealt out and sorted; runs are merged with it as they lie."""
    runs = LineRuns(spark, 3, fanout=4)
    lines = spark.range(1000).select(
        F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_doc")
    )
    for batch in range(3):
        runs.add(lines.filter(F.col("h2") % 3 == batch))
    keys = lines.groupBy(*HASH).agg(F.count("*").alias("n_docs"))
    with sorted_buckets(spark):
        plan = runs.unsettled(keys)._jdf.queryExecution().executedPlan().toString()
    assert runs.unsettled(keys).count() == 0
    scans = [line for line in plan.splitlines() if "FileScan" in line and "line_run_" in line]
    assert len(scans) == 3 and all("Bucketed: true" in line for line in scans)
    assert plan.count("SortMergeJoin") == 3 and "HashAggregate" in plan[plan.rindex("SortMergeJoin") :]
    # Those of the batch; its aggregate needs none here, since a range is parted by id.
    assert (plan.count("Exchange "), plan.count("Sort [")) == (1, 1)
    runs.forget()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_of_the_query(spark):
    docs = spark.createDataFrame([(1, "é\nb")], "doc_id bigint, text string")
    row = dedup_lines(docs).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256("é\nb".encode()).hexdigest()
