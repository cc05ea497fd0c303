"""Session funnel: which of the steps view, cart, purchase each session contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.clickstream import CART, PURCHASE, VIEW, is_event
from clickloom.functions.exact import percent
from clickloom.operators.masks import has_slot, seen_slots

STEPS = (VIEW, CART, PURCHASE)


def _step_bits() -> Column:
    """The steps of a group as bits; other event types add none."""
    step = F.coalesce(*[F.when(is_event(kind), F.lit(1 << i)) for i, kind in enumerate(STEPS)])
    return F.coalesce(F.bit_or(step), F.lit(0))


def session_bits() -> list[Column]:
    """Aggregates: steps and weekdays seen, as bits. Weekday slot 0 stands for events without a time."""
    return [
        _step_bits().alias("steps"),
        seen_slots(F.coalesce(F.col("day_of_week"), F.lit(0))).alias("weekdays"),
    ]


def session_masks(events: DataFrame) -> DataFrame:
    """One row per session: steps and weekdays seen, as bits. ``sessions`` is always 1."""
    return (
        events.filter(F.col("user_session").isNotNull())
        .groupBy("user_session")
        .agg(*session_bits())
        .withColumn("sessions", F.lit(1).cast("bigint"))
    )


def session_profile(events: DataFrame) -> DataFrame:
    """Sessions per combination of steps and weekdays: 8 x 256 rows at most.

    Funnel and weekday activity can both start from it, so that sessions are shuffled once.
    """
    return (
        session_masks(events)
        .groupBy("steps", "weekdays")
        .agg(F.sum("sessions").alias("sessions"))
    )


def session_flags(events: DataFrame) -> DataFrame:
    """Drill-down table behind the funnel, one row per session."""
    flags = [
        has_slot(F.col("steps"), i).cast("int").alias(f"has_{kind}") for i, kind in enumerate(STEPS)
    ]
    return (
        events.filter(F.col("user_session").isNotNull())
        .groupBy("user_session")
        .agg(
            _step_bits().alias("steps"),
            F.countDistinct("user_id").alias("distinct_users"),
            F.count("*").alias("total_events"),
        )
        .select("user_session", *flags, "distinct_users", "total_events")
    )


def funnel_summary(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Sessions per step and conversion rates, one row.

    Steps are independent of each other: a purchase without a cart counts, so a rate can exceed
    100. A rate is NULL when no session has the step it starts from. ``sessions`` takes a
    ready ``session_profile``.
    """
    masks = session_masks(events) if sessions is None else sessions

    def having(step: int) -> Column:
        found = F.when(has_slot(F.col("steps"), step), F.col("sessions"))
        return F.coalesce(F.sum(found), F.lit(0)).alias(f"sessions_with_{STEPS[step]}")

    view, cart, bought, every = (
        F.col(name)
        for name in (
            "sessions_with_view",
            "sessions_with_cart",
            "sessions_with_purchase",
            "total_sessions",
        )
    )
    return masks.agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"),
        *[having(step) for step in range(len(STEPS))],
    ).select(
        "*",
        percent(cart, view).alias("view_to_cart_rate"),
        percent(bought, cart).alias("cart_to_purchase_rate"),
        percent(bought, every).alias("overall_conversion_rate"),
    )
