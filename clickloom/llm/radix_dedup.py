"""Exact deduplication by most-significant-digit radix partitioning.

The string that is sorted is a text's byte length followed by its bytes. Length and first bytes
part nearly all texts at once, in a narrow table that is aggregated before it is shuffled; only
groups that are still larger than one are split by their next bytes, until each is a singleton
or its texts have ended. Texts are compared byte for byte and never by a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import stored, whole_text

DIGIT = ["inside", "n_bytes", "digit"]


def radix_groups(
    docs: DataFrame, first: int = 64, growth: int = 32, widest: int = 1 << 26
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal texts form a group; the row with the largest doc_id stays. NULL text counts
    as empty, a NULL doc_id as smaller than any other. Rows that repeat both doc_id and text
    share one result. Other columns are not read, whatever their names. An empty table gives an
    empty result.

    The first digit has ``first`` bytes, each further one ``growth`` times as many, so rounds grow
    with the logarithm of the longest repeated text; ``widest`` bounds what a digit holds of a row
    beside the rest of its text. Sizes are aggregated before they are shuffled, so a group that holds a third of all
    rows is one row per task. Texts of open groups move once per digit, on a join that Spark
    may split at a hot group, since nothing above it needs the group together. The tables
    between the rounds are stored in the shared folder; the text itself is dropped as it is used.
    """
    text = whole_text()
    rows = docs.select(
        "doc_id",
        F.lit(0).cast("bigint").alias("inside"),
        F.octet_length(text).alias("n_bytes"),
        F.sha2(text, 256).alias("text_sha256"),
        text.cast("binary").alias("rest"),
    )
    used, width, resolved = 0, first, []
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width))
        used += width
        sizes = rows.groupBy(*DIGIT).agg(
            F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")
        )
        groups = stored(sizes.withColumn("group", F.monotonically_increasing_id()), "radix-groups")
        is_open = (F.col("group_size") > 1) & (F.col("n_bytes") > used)
        closed = groups.filter(~is_open).drop("group")
        resolved.append(rows.drop("rest").join(closed, DIGIT).drop(*DIGIT))
        still_open = groups.filter(is_open).select(*DIGIT, "group")
        if still_open.isEmpty():
            break
        carried = rows.join(still_open, DIGIT).select(
            "doc_id",
            F.col("group").alias("inside"),
            "n_bytes",
            "text_sha256",
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        rows = stored(carried, "radix-rows")
        width = min(width * growth, widest)
    return reduce(DataFrame.unionByName, resolved).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


RADIX_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
