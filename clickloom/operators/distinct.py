"""Distinct counts that add up: exact ones from bitmaps of numbered members, and sketches.

A plain distinct count of one grouping says nothing about a coarser one. A bitmap per group does: those
of finer groups are united, and counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import fresh_folder

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below
SKETCH_BITS = 14  # 16,384 registers: a standard error of 0.8 %


def numbered_members(
    rows: DataFrame, member: str, groups: list[str], folder: str | None = None
) -> DataFrame:
    """(number, group) for each member and group it is in; numbers are dense, from 0.

    ``rows`` may repeat members and groups; rows without a member do not count. Members are brought
    together once, each with the groups it is in (as many as there are groups at most, however many
    rows a member has). They are stored in ``folder`` (by default a fresh one in the shared folder) and
    numbered by partition and place, so that nothing is sorted: the driver gets one size per partition.
    """
    spark = rows.sparkSession
    folder = f"{folder or fresh_folder(spark, 'members')}/members"
    group = F.struct(*[F.col(name) for name in groups])
    members = (
        rows.filter(F.col(member).isNotNull())
        .groupBy(member)
        .agg(F.collect_set(group).alias("groups"))
        .select("groups", F.monotonically_increasing_id().alias("place"))
    )
    members.write.parquet(folder)
    held = spark.read.schema(members.schema).parquet(folder)
    part = F.shiftright("place", _ROW_BITS)
    sizes = {row["part"]: row["count"] for row in held.groupBy(part.alias("part")).count().collect()}
    starts, total = [], 0
    for number in sorted(sizes):
        starts.append((number, total))
        total += sizes[number]
    # One row per partition of the table above.
    offsets = F.broadcast(spark.createDataFrame(starts, "part bigint, start bigint"))
    numbered = held.join(offsets, part == F.col("part")).withColumn(
        "number", F.col("start") + F.col("place") - F.shiftleft("part", _ROW_BITS)
    )
    return numbered.select("number", F.explode("groups").alias("group")).select("number", "group.*")


def member_bitmaps(numbered: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, page, members): a state that merges, one bitmap per group and 32,768 numbers.

    Bitmaps are built in the map tasks, so a group that a third of all members are in is a few
    rows per task.
    """
    return numbered.groupBy(*groups, F.bitmap_bucket_number("number").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members")
    )


def count_members(bitmaps: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct members per ``by``, any of the bitmaps' groups or none."""
    united = bitmaps.groupBy(*by, "page").agg(F.bitmap_or_agg("members").alias("members"))
    return united.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("members")), F.lit(0)).alias(name))


def sketch_of(member: str) -> Column:
    """Aggregate: a sketch of the distinct members of a group, some 10 KB at most."""
    return F.hll_sketch_agg(member, F.lit(SKETCH_BITS))


def count_of(sketch: Column) -> Column:
    """About how many members a sketch, or a union of sketches, has seen."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def distinct(member: str, approximate: bool) -> Column:
    """Aggregate: distinct members, exactly or from a sketch that is built in the map tasks."""
    return count_of(sketch_of(member)) if approximate else F.countDistinct(member)
