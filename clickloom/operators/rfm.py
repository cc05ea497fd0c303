"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.clickstream import PURCHASE, is_event, segment_label
from clickloom.functions.exact import in_cents, money, to_cents
from clickloom.operators.tiles import rank_tiles


def _customers(
    events: DataFrame, as_of: datetime.date | None, days: DataFrame | None = None
) -> DataFrame:
    """Per purchasing user: last purchase as a day number, purchase rows, millionths spent."""
    if days is None:
        purchases, counted = events.filter(is_event(PURCHASE)), F.count("*")
        spent = F.sum("price_micros")
    else:
        purchases, counted, spent = days.filter("bought"), F.sum("events"), F.sum("micros")
    if as_of is not None:
        purchases = purchases.filter(F.col("date").isNull() | (F.col("date") <= F.lit(as_of)))
    return purchases.groupBy("user_id").agg(
        F.max(F.unix_date("date")).alias("last_day"),
        counted.alias("frequency"),
        spent.alias("micros"),
    )


def _recency(last_day: Column, reference_day: Column) -> Column:
    return (reference_day - last_day).cast("int").alias("recency_days")


def _as_day(as_of: datetime.date) -> Column:
    return F.unix_date(F.lit(as_of))


def rfm_base(
    events: DataFrame, as_of: datetime.date | None = None, days: DataFrame | None = None
) -> DataFrame:
    """The three measures before scoring.

    Recency counts from ``as_of``, and purchases after that day are left out, or else from the
    last purchase in the data. That is a scalar subquery: a second scan of two columns without a
    shuffle, or none if ``days`` gives a stored ``user_days``.
    """
    customers = _customers(events, as_of, days)
    if as_of is None:
        purchases = events.filter(is_event(PURCHASE)) if days is None else days.filter("bought")
        reference_day = purchases.agg(F.max(F.unix_date("date"))).scalar()
    else:
        reference_day = _as_day(as_of)
    return customers.select(
        "user_id",
        _recency(F.col("last_day"), reference_day),
        "frequency",
        money(F.col("micros")).alias("monetary"),
    )


def rfm_segments(
    events: DataFrame,
    as_of: datetime.date | None = None,
    days: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Scores 1 to 5 per measure and the customer's segment. Ties are settled by user_id.

    ``as_of`` and ``days`` as in ``rfm_base``. Calling this runs jobs: customers are stored in
    ``folder`` and counted (see ``rank_tiles``), and the result reads them there. The last purchase
    day orders customers just as recency does, so scoring does not wait for the reference date; that is
    taken from the stored customers, and events are read once. Customers without a known
    purchase day, or without any price, score lowest on that measure.
    """
    customers = _customers(events, as_of, days).select(
        "user_id", "last_day", "frequency", to_cents(F.col("micros")).alias("cents")
    )
    scored = rank_tiles(customers, "user_id", ["last_day", "frequency", "cents"], folder=folder)
    latest = scored.agg(F.max("last_day")).scalar()
    reference_day = latest if as_of is None else _as_day(as_of)
    r, f, m = F.col("last_day_tile"), F.col("frequency_tile"), F.col("cents_tile")
    return scored.select(
        "user_id",
        _recency(F.col("last_day"), reference_day),
        "frequency",
        in_cents(F.col("cents")).alias("monetary"),
        r.alias("r_score"),
        f.alias("f_score"),
        m.alias("m_score"),
        (r * 100 + f * 10 + m).alias("rfm_score"),
        segment_label(r, f, m).alias("segment"),
    )


def rfm_segment_distribution(segments: DataFrame) -> DataFrame:
    """Customers per segment, from the result of ``rfm_segments``."""
    return segments.groupBy("segment").agg(F.count("*").alias("count"))
