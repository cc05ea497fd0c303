"""Exact distinct counts over a handful of slots, with one row per member.

Counting distinct users per hour the usual way shuffles every (hour, user) pair. With few slots
one integer per user can hold all hours the user was seen in: map tasks combine the bits, the
shuffle carries at most one narrow row per user and task, and a hot user or slot stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), slot)


def seen_slots(slot: Column) -> Column:
    """Aggregate: the set of slots of a group, one bit each (up to 31 slots)."""
    return F.bit_or(slot_bit(slot))


def has_slot(mask: Column, slot: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << slot)) != 0


def members_per_slot(masks: DataFrame, mask: str, slots: int, weight: str, name: str) -> DataFrame:
    """(slot, members) for every slot; ``weight`` is how many members a row stands for."""
    listed = ", ".join(
        f"coalesce(sum(if({mask} & {1 << slot} != 0, {weight}, 0)), 0)" for slot in range(slots)
    )
    return masks.agg(F.expr(f"array({listed})").alias("members")).select(
        F.posexplode("members").alias("slot", name)
    )
