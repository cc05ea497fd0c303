"""Event logs in CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.clean import event_date
from clickloom.schema import (
    BAD_LINE,
    EVENT_SCHEMA,
    REJECT,
    REJECT_TYPE,
    REJECTED,
    TIME_PATTERN,
    day_column,
)
from clickloom.session import fresh_folder
from clickloom.sources.headers import files_by_header


def _checked(names: Sequence[str], path: str) -> None:
    missing = [name for name in EVENT_SCHEMA.names if names.count(name) != 1]
    if missing:
        raise ValueError(f"{path}: no single column for each of {', '.join(missing)}")


def read_events(
    spark: SparkSession, path: str, file_format: str = "csv", rejects: bool = False
) -> DataFrame:
    """Events at any path Spark can reach: the nine columns, found by name.

    CSV columns are bound by each file's header, whatever their order; columns besides the nine are
    left out. Files of one header are read together, and a file that lacks one of the nine is named
    in the error. Lines that do not parse are kept: the bad values are NULL and the line's text is in
    ``_corrupt_record``. With ``rejects`` such a line also has ``_reject``: its file and the columns that
    failed, from which the pipeline makes a table.

    Parquet keeps the types that its files have; ``clean`` accepts text, numbers and all kinds of time.
    """
    if file_format == "parquet":
        found = spark.read.parquet(path)
        _checked(found.columns, path)
        return found.select(EVENT_SCHEMA.names)
    if file_format != "csv":
        raise ValueError(f"no such event format: {file_format}")
    groups = files_by_header(spark, path)
    for header, files in groups.items():
        _checked(header, ", ".join(files[:3]))
    if not groups:
        raise ValueError(f"{path}: no header in any file")
    return reduce(
        DataFrame.unionByName,
        [_read_csv(spark, header, files, rejects) for header, files in groups.items()],
    )


def _reject(header: tuple[str, ...]) -> Column:
    """A bad line's file and failed columns; good lines are not looked at again."""
    fields = ", ".join(f"c{place} string" for place in range(len(header)))

    def failed(raw: Column) -> Column:
        """Values that are there as text, but not as what they should be."""
        names = [
            F.when((raw[f"c{place}"] != "") & F.col(name).isNull(), F.lit(name))
            for place, name in enumerate(header)
            if name in EVENT_SCHEMA.names
        ]
        return F.concat_ws(",", *names)

    found = F.transform(F.array(F.from_csv(F.col(BAD_LINE), F.lit(fields))), failed)[0]
    both = F.struct(F.col("_metadata.file_path").alias("file"), found.alias("failed_columns"))
    return F.when(F.col(BAD_LINE).isNotNull(), both).cast(REJECT_TYPE).alias(REJECT)


def _read_csv(
    spark: SparkSession, header: tuple[str, ...], files: list[str], rejects: bool
) -> DataFrame:
    """Files of one header; Spark compares it with every file's again."""
    declared = {field.name: field for field in EVENT_SCHEMA}
    columns = [
        declared.get(name, T.StructField(f"{name or 'unnamed'} {place}", T.StringType()))
        for place, name in enumerate(header)
    ]
    return (
        spark.read.schema(T.StructType([*columns, T.StructField(BAD_LINE, T.StringType())]))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .option("timestampFormat", TIME_PATTERN)
        .csv(files)
        .select(*EVENT_SCHEMA.names, BAD_LINE, *([_reject(header)] if rejects else []))
    )


def stage_events(events: DataFrame, zone: str | None = None) -> tuple[DataFrame, str]:
    """Write events once as Parquet in the shared folder; returns the table and its path.

    Worth it for CSV input: the file is parsed once, and each analysis then reads only its own
    columns. Unlike a cache the table survives the loss of executors. Stage events as read:
    derived columns would double the table and are cheap to add. Bad lines read with ``rejects`` get
    files of their own on the way.

    With ``zone`` the table is laid by date in that zone, so that one day or all days up to one are
    read without opening other days' files. This moves the events once; Spark splits dates with
    many events and joins small ones, without looking at the events before.
    """
    spark = events.sparkSession
    folder = fresh_folder(spark, "events")
    laid = []
    if REJECT in events.columns:
        events = events.withColumn(REJECTED, F.col(REJECT).isNotNull())
        laid.append(REJECTED)
    if zone is not None:
        day = day_column(zone)
        events = events.withColumn(day, event_date(events, zone)).hint("rebalance", F.col(f"`{day}`"))
        laid.append(day)
    events.write.partitionBy(*laid).parquet(folder)
    return spark.read.schema(events.schema).parquet(folder), folder
