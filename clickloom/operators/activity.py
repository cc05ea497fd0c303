"""Activity by hour and weekday, revenue by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.clickstream import CART, PURCHASE, VIEW, count_events, is_event, weekday_name
from clickloom.functions.exact import mean_money, money
from clickloom.operators.clean import bad_lines, null_counts
from clickloom.operators.distinct import count_of, sketch_of
from clickloom.operators.funnel import session_masks
from clickloom.operators.masks import members_per_slot, seen_slots

NO_HOUR = 24  # slot of events without a time
NO_WEEKDAY = 0
MEASURES = ("total_events", "views", "carts", "purchases")


def activity_counts(events: DataFrame, audited: tuple[str, ...] = ()) -> list[Column]:
    """Aggregates: events by kind and, for ``audited`` columns, NULLs and bad lines."""
    audit = [*null_counts(audited), bad_lines(events)] if audited else []
    return [
        F.count("*").alias("total_events"),
        count_events(VIEW).alias("views"),
        count_events(CART).alias("carts"),
        count_events(PURCHASE).alias("purchases"),
        *audit,
    ]


def activity_grid(events: DataFrame, audited: tuple[str, ...] = ()) -> DataFrame:
    """Event counts per hour and weekday: 25 x 8 rows at most, in one pass.

    Adds the NULLs of ``audited`` columns and bad lines, so that the audit needs no pass of its own.
    """
    return events.groupBy("hour", "day_of_week").agg(*activity_counts(events, audited))


def _totals(grid: DataFrame, slot: str, missing: int) -> DataFrame:
    return grid.groupBy(F.coalesce(F.col(slot), F.lit(missing)).alias("slot")).agg(
        *[F.sum(name).alias(name) for name in MEASURES]
    )


def _hours() -> Column:
    return seen_slots(F.coalesce(F.col("hour"), F.lit(NO_HOUR)))


def _bought() -> Column:
    return F.coalesce(is_event(PURCHASE), F.lit(False))


def user_days(events: DataFrame) -> DataFrame:
    """What users did: one row per user for all other events, and one per day with purchases.

    Hourly users, customers and daily revenue can all start from it, so that events are scanned
    and shuffled by user once for the three. Purchases without a time have a NULL date.
    """
    return user_sums(events, F.when(_bought(), F.col("date")))


def user_sums(events: DataFrame, date: Column) -> DataFrame:
    """What users did, by whether they bought and by ``date``: hours seen, events, money."""
    paid = F.col("price_read") > 0
    return events.groupBy("user_id", _bought().alias("bought"), date.alias("date")).agg(
        _hours().alias("hours"),
        F.count("*").alias("events"),
        F.sum("price_micros").alias("micros"),
        F.count_if(paid).alias("paid"),
        F.sum(F.when(paid, F.col("price_micros"))).alias("paid_micros"),
    )


def hourly_activity(
    events: DataFrame,
    grid: DataFrame | None = None,
    days: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Events and distinct users per hour of day; events without a time form a NULL hour.

    Distinct within an hour, so hours do not add up to the number of users. ``grid`` and ``days``
    take a ready ``activity_grid`` and ``user_days``. With ``approximate`` users are estimated by
    sketches, in the pass that counts events.
    """
    if approximate:
        sketched = events.groupBy("hour").agg(
            *activity_counts(events), sketch_of("user_id").alias("users")
        )
        return sketched.select("hour", *MEASURES, count_of(F.col("users")).alias("unique_users"))
    if grid is None:
        grid = activity_grid(events)
    seen = events if days is None else days
    users = (
        seen.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg((_hours() if days is None else F.bit_or("hours")).alias("hours"))
        .withColumn("users", F.lit(1).cast("bigint"))
    )
    per_hour = members_per_slot(users, "hours", NO_HOUR + 1, "users", "unique_users")
    # The broadcast side has one row per slot.
    return (
        _totals(grid, "hour", NO_HOUR)
        .join(F.broadcast(per_hour), "slot")
        .select(F.nullif("slot", F.lit(NO_HOUR)).alias("hour"), *MEASURES, "unique_users")
    )


def weekday_activity(
    events: DataFrame, grid: DataFrame | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """Events and distinct sessions per weekday, 1 is Sunday.

    ``grid`` and ``sessions`` take a ready ``activity_grid`` and ``session_profile``.
    """
    if grid is None:
        grid = activity_grid(events)
    masks = session_masks(events) if sessions is None else sessions
    per_day = members_per_slot(masks, "weekdays", 8, "sessions", "unique_sessions")
    day = F.nullif("slot", F.lit(NO_WEEKDAY))
    return (
        _totals(grid, "day_of_week", NO_WEEKDAY)
        .join(F.broadcast(per_day), "slot")
        .select(
            day.alias("day_of_week"),
            weekday_name(day).alias("day_name"),
            *MEASURES,
            "unique_sessions",
        )
    )


def daily_revenue(events: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Revenue, purchases and buyers per date, from purchases with a price above zero.

    ``days`` takes a ready ``user_days``, which has one row per buyer and date.
    """
    if days is None:
        sold = events.filter(is_event(PURCHASE) & (F.col("price_read") > 0))
        totals = sold.groupBy("date").agg(
            F.sum("price_micros").alias("micros"),
            F.count("*").alias("total_purchases"),
            F.countDistinct("user_id").alias("unique_buyers"),
        )
    else:
        totals = (
            days.filter(F.col("bought") & (F.col("paid") > 0))
            .groupBy("date")
            .agg(
                F.sum("paid_micros").alias("micros"),
                F.sum("paid").alias("total_purchases"),
                F.count("user_id").alias("unique_buyers"),
            )
        )
    return totals.select(
        "date",
        money(F.col("micros")).alias("daily_revenue"),
        "total_purchases",
        "unique_buyers",
        mean_money(F.col("micros"), F.col("total_purchases")).alias("avg_order_value"),
    )
