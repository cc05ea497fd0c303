"""Money, means and percentages on integers, so that results do not depend on row order.

Sums of money are counted in millionths, in a bigint: integer sums are exact and need no decimal
buffers. Filters and brackets look at the price as it is. Results are rounded to cents, and doubles
appear only in the last step, when a finished number of cents is divided by 100.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
CENT = MICROS // 100


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Nearest integer to numerator / denominator, both non-negative; NULL on zero."""
    return F.call_function(
        "div", numerator * 2 + denominator, F.nullif(denominator, F.lit(0)) * 2
    )


def number(price: Column, kind: T.DataType) -> Column:
    """A price as it was read, text as an exact decimal; NULL where it is no number."""
    return price.try_cast("decimal(38,18)") if kind == T.StringType() else price


def to_micros(price: Column) -> Column:
    """A price in whole millionths, to add up; the 7th decimal is rounded."""
    return (price.try_cast("decimal(18,6)") * MICROS).cast("bigint")


def to_cents(micros: Column) -> Column:
    """Millionths in whole cents, ties away from zero."""
    size = _half_up(F.abs(micros), F.lit(CENT))
    return F.when(micros < 0, -size).otherwise(size)


def in_cents(cents: Column) -> Column:
    return cents / F.lit(100.0)


def money(micros: Column) -> Column:
    """Millionths as a double of two decimals."""
    return in_cents(to_cents(micros))


def mean_money(total_micros: Column, count: Column) -> Column:
    """Mean price to two decimals, ties away from zero; NULL when nothing was counted."""
    size = _half_up(F.abs(total_micros), count * CENT)
    return in_cents(F.when(total_micros < 0, -size).otherwise(size))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals, half up; NULL when whole is 0."""
    return _half_up(part * 10_000, whole) / F.lit(100.0)


def percent_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(percent(part, whole), F.lit(0.0))
