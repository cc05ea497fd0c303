"""Column expressions of the clickstream domain."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.schema import TIME_PATTERN

# Event types that are counted, weekday names from day 1, price brackets with the
# lowest price of each, segments with the scores they need (the first match wins).
VIEW, CART, PURCHASE = "view", "cart", "purchase"

WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

PRICE_BRACKETS = (
    ("Budget (<$50)", 0),
    ("Mid ($50-$200)", 50),
    ("Premium ($200-$500)", 200),
    ("Luxury ($500-$1000)", 500),
    ("Ultra Luxury (>$1000)", 1000),
)

SEGMENTS = (
    # label, recency scores, frequency scores, monetary scores
    ("Champion", (5, 5), (5, 5), (5, 5)),
    ("Loyal Customer", (4, 5), (4, 5), (1, 5)),
    ("Potential Loyalist", (3, 5), (3, 5), (1, 5)),
    ("At Risk", (1, 2), (3, 5), (1, 5)),
    ("Lost", (1, 2), (1, 2), (1, 5)),
    ("Window Shopper", (3, 5), (1, 2), (1, 5)),
)


def is_event(kind: str) -> Column:
    return F.col("event_type") == kind


def count_events(kind: str) -> Column:
    """Number of rows of this event type; 0 where there is none."""
    return F.count_if(is_event(kind))


def parsed_time(time: Column, kind: T.DataType) -> Column:
    """Text to an instant, NULL where it does not parse; typed times pass through."""
    return F.try_to_timestamp(time, F.lit(TIME_PATTERN)) if kind == T.StringType() else time


def wall_clock(time: Column, kind: T.DataType, zone: str, session_zone: str | None = None) -> Column:
    """The clock reading of an instant in ``zone``, whatever the session's own zone is.

    Where that is the same zone the instant itself will do: Spark reads its calendar in the
    zone that the session has when the expression is made, and dates reach the scan.
    """
    if kind == T.TimestampNTZType() or zone == session_zone:
        return time
    utc = F.timestamp_add(
        "MICROSECOND", F.unix_micros(time), F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    )
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def weekday_name(day_of_week: Column) -> Column:
    """1 is Sunday; NULL for an unknown day."""
    return F.get(F.array(*[F.lit(name) for name in WEEKDAYS]), day_of_week - 1)


def main_category(code: Column) -> Column:
    """First segment of a dotted category code."""
    return F.substring_index(code, ".", 1)


def sub_category(code: Column) -> Column:
    """Second segment of a dotted category code; NULL where there is only one."""
    return F.get(F.split(code, r"\."), F.lit(1))


def price_bracket_number(price: Column) -> Column:
    """0 for the cheapest bracket; each holds its lower bound and not its upper one."""
    steps = [(price >= bound).cast("int") for _, bound in PRICE_BRACKETS[1:]]
    return reduce(add, steps)


def price_bracket_label(number: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label, _ in PRICE_BRACKETS]), number)


def segment_label(recency: Column, frequency: Column, monetary: Column) -> Column:
    labels = [
        F.when(recency.between(*r) & frequency.between(*f) & monetary.between(*m), F.lit(label))
        for label, r, f, m in SEGMENTS
    ]
    return F.coalesce(*labels)
