"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches. A run holds the line hashes that a batch brought, bucketed and
sorted by hash, with the number of documents of each and the document that keeps it. A new batch
is merge-anti-joined with the runs: keys they have settled are dropped, the rest become the
batch's own run. Every ``fanout`` runs of a level are merged into one run of the next, so that a
batch meets a logarithmic number of runs.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.text import LOWER, SPACES, UPPER, ascii_lower, whole_text
from clickloom.session import fresh_folder

HASH = ["h1", "h2"]
ROW = ["_doc", "_body"]  # with the text's hash, so that rows repeating a doc_id stay apart
LOWEST = -(2**63)  # stands for a NULL doc_id
# Lets a join use the order of a bucket that is a single file, as those of all runs are.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_buckets(spark: SparkSession):
    before = spark.conf.get(SORTED_BUCKETS)
    spark.conf.set(SORTED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_BUCKETS, before)


class LineRuns:
    """The runs of one corpus: tables (h1, h2, n_docs, arrived, keeper) by level.

    Each bucket of a run is one file sorted by hash. A batch is dealt out into the same buckets and
    sorted once, and then merged with run after run as they lie: neither the joins nor a merge of
    runs moves a run, and the joins do not sort one. The files are in the shared folder and
    outlive executors.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 4, min_docs: int = 3):
        self.spark, self.buckets, self.fanout, self.min_docs = spark, buckets, fanout, min_docs
        self.folder = fresh_folder(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.batches = 0

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of lines (h1, h2, _doc).

        The keeper of a hash is the largest document of the first batch that has it. A hash that
        one run has seen in ``min_docs`` documents is settled: later lines change nothing.
        """
        keys = (
            lines.select(*HASH, "_doc")
            .distinct()
            .groupBy(*HASH)
            .agg(F.count("*").alias("n_docs"), F.max("_doc").alias("keeper"))
            .withColumn("arrived", F.lit(self.batches))
        )
        with sorted_buckets(self.spark):
            self._write(self.unsettled(keys), 0)
        self.batches += 1
        self._compact(0)

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that no run has settled, in the buckets of the runs.

        Keys are one row per hash here, so no bucket is hot. The anti-join is written as an outer
        one, since Spark would move a left_anti below the repartition and the aggregate.
        """
        keys = keys.repartition(self.buckets, *HASH)
        for run in self.runs():
            settled = run.filter(F.col("n_docs") >= self.min_docs)
            settled = settled.select(*HASH, F.lit(True).alias("settled"))
            keys = keys.join(settled.hint("merge"), HASH, "left")
            keys = keys.filter(F.col("settled").isNull()).drop("settled")
        return keys

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def totals(self) -> DataFrame:
        """One row per hash over all runs."""
        return _merged(self.runs())

    def forget(self) -> None:
        """Take the runs out of the session's catalogue; plans made from them go on working."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"drop table if exists {name}")
        self.levels = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet")
        # Hashes do not compress.
        writer.option("compression", "none").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged, self.levels[level] = self.levels[level], []
        self._write(_merged([self.spark.table(name) for name in merged]), level + 1)
        for name in merged:
            self.spark.sql(f"drop table {name}")
        self._compact(level + 1)


def _merged(runs: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy(*HASH).agg(
        F.sum("n_docs").alias("n_docs"),
        F.min("arrived").alias("arrived"),
        F.min_by("keeper", "arrived").alias("keeper"),
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers are not in ``gone`` (sorted): the stretches between those."""
    stretches = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(gone, lambda at: at + 1)),
        F.concat(gone, F.array(F.size(lines))),
        lambda start, end: F.slice(lines, start + 1, end - start),
    )
    return F.when(gone.isNull(), lines).otherwise(F.flatten(stretches))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 6,
    fanout: int = 4,
    bucket_lines: int = 250_000,
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) plus n_lines, n_dropped and kept_text.

    Texts split at newlines; a line's key is the line without white space at its ends and with A-Z
    lower-cased. Keys of at least ``min_chars`` characters found in ``min_docs`` documents or more
    lose all their lines except those in the largest doc_id that has them. Other lines stay in
    order. NULL and empty texts are one empty line. A NULL doc_id counts as one document, smaller
    than all others; rows that share a doc_id count as one document. Input columns named like the
    results are replaced; names starting with ``_doc`` or ``_body`` are reserved.

    Batches are ranges of doc_id, largest first, so that the first batch that has a key also has its
    keeper. Keys are compared by 128 bits of hash. Counts are aggregated before each shuffle; the
    join of lines with dropped keys may be split by Spark at a key that many lines share. Whole
    texts move once, to meet the numbers of their dropped lines. Runs have one bucket per
    ``bucket_lines`` lines of the corpus.
    """
    spark = docs.sparkSession
    rows = docs.withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)),
            "_body": F.xxhash64(whole_text()),
        }
    )
    lines_of = F.split(whole_text(), "\n", -1)
    cuts = rows.agg(
        F.percentile_approx("_doc", [k / batches for k in range(1, batches)]).alias("cuts")
    ).first()["cuts"]
    later = sum([(F.col("_doc") <= cut).cast("int") for cut in set(cuts or [])], F.lit(0))
    keyed = (
        rows.select(*ROW, F.posexplode(lines_of).alias("at", "line"))
        .select(*ROW, "at", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(
            *ROW,
            "at",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            later.alias("batch"),
        )
    )
    folder = fresh_folder(spark, "line-hashes")
    keyed.write.partitionBy("batch").option("compression", "none").parquet(folder)
    lines = spark.read.schema(keyed.schema).parquet(folder)

    buckets = 1 + lines.count() // bucket_lines
    runs = LineRuns(spark, buckets, fanout, min_docs)
    for batch in range(len(set(cuts or [])) + 1):
        runs.add(lines.filter(F.col("batch") == batch))
    dropped = runs.totals().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper")
    gone = (
        lines.join(dropped, HASH)
        .filter(F.col("_doc") != F.col("keeper"))
        .groupBy(*ROW)
        .agg(F.array_sort(F.collect_set("at")).alias("_gone"))
    )
    joined = rows.join(gone, ROW, "left")
    runs.forget()
    return joined.withColumns(
        {
            "n_lines": F.size(lines_of).cast("bigint"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
            "kept_text": F.array_join(_without(lines_of, F.col("_gone")), "\n"),
        }
    ).drop(*ROW, "_gone")


LINES_SQL = f"""
with parted as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
),
lined as (
  select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as place from parted
),
keyed as (
  select doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              '{UPPER}', '{LOWER}') as key
  from lined
),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
),
marked as (
  select k.*, c.key is not null and doc_id <> keeper as gone
  from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), ''))
    as kept_sha256
from marked group by doc_id
"""
