"""Typed and enriched events, and audits of the raw input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.clickstream import (
    main_category,
    parsed_time,
    sub_category,
    wall_clock,
    weekday_name,
)
from clickloom.functions.exact import number, to_micros
from clickloom.schema import BAD_LINE, EVENT_SCHEMA, REJECT, REJECTED, day_column

AUDITED = tuple(EVENT_SCHEMA.names)
KEYS = ("product_id", "category_id", "user_id")


def clean(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add calendar, category and money columns; the calendar is read in ``zone``.

    One projection: each analysis reads only the columns it names, so unused ones cost nothing.
    Values that do not parse become NULL. ``price_read`` is the price as it was read, which
    filters and brackets use, ``price_micros`` what sums use, ``price`` a double for display.
    Times may be text, instants or clock readings, prices text or numbers, keys text or integers.
    Of events laid by date in this zone, ``date`` is what they are laid by, so that filters on it
    choose files.
    """
    kinds = {field.name: field.dataType for field in events.schema}
    keys = [name for name in KEYS if kinds[name] != T.LongType()]
    typed = events.withColumns(
        {
            "event_time": parsed_time(F.col("event_time"), kinds["event_time"]),
            "price_read": number(F.col("price"), kinds["price"]),
            "price_micros": to_micros(F.col("price")),
            **{name: F.col(name).try_cast("bigint") for name in keys},
        }
    )
    session_zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    kind = typed.schema["event_time"].dataType
    clock = wall_clock(F.col("event_time"), kind, zone, session_zone)
    return typed.withColumns(
        {
            "price": F.col("price_read").cast("double"),
            "year": F.year(clock),
            "month": F.month(clock),
            "day_of_week": F.dayofweek(clock),
            "hour": F.hour(clock),
            "date": F.col(f"`{day}`") if (day := day_column(zone)) in kinds else F.to_date(clock),
            "day_name": weekday_name(F.dayofweek(clock)),
            "category_main": main_category(F.col("category_code")),
            "category_sub": sub_category(F.col("category_code")),
        }
    )


def event_date(events: DataFrame, zone: str) -> Column:
    """The date that ``clean`` gives to raw events."""
    time = parsed_time(F.col("event_time"), events.schema["event_time"].dataType)
    kind = events.select(time.alias("time")).schema["time"].dataType
    session_zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    return F.to_date(wall_clock(time, kind, zone, session_zone))


def rejects(events: DataFrame) -> DataFrame:
    """Lines that did not parse in full, of events read with ``rejects``: file, line, failed_columns.

    failed_columns names those whose value is there but is none of its type, in file order, and is empty
    if the line only has more or fewer fields than its header. Of staged events only the files of
    bad lines are read.
    """
    is_bad = F.col(REJECTED) if REJECTED in events.columns else F.col(REJECT).isNotNull()
    return events.filter(is_bad).select(
        F.col(f"{REJECT}.file").alias("file"),
        F.col(BAD_LINE).alias("line"),
        F.col(f"{REJECT}.failed_columns").alias("failed_columns"),
    )


def null_counts(columns: tuple[str, ...]) -> list:
    return [F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in columns]


def bad_lines(events: DataFrame) -> Column:
    """Lines that did not parse in full; 0 for input that does not come as lines."""
    bad = F.col(BAD_LINE).isNotNull() if BAD_LINE in events.columns else F.lit(False)
    return F.count_if(bad).alias("bad_lines")


def null_audit(events: DataFrame, columns: tuple[str, ...] = AUDITED) -> DataFrame:
    """Row count, NULLs per column and bad lines, in one pass.

    A value that does not parse is a NULL after ``clean`` and counts as one.
    """
    return events.agg(F.count("*").alias("row_count"), *null_counts(columns), bad_lines(events))


def row_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("total_events"))
