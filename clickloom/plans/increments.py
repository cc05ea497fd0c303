"""Runs that read new events only: stored states per event date, from which all tables follow."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.activity import (
    MEASURES,
    activity_counts,
    daily_revenue,
    hourly_activity,
    user_sums,
    weekday_activity,
)
from clickloom.operators.clean import AUDITED, clean
from clickloom.operators.funnel import funnel_summary, session_bits
from clickloom.operators.merchandise import (
    BRAND_SUMS,
    PRICE_SUMS,
    brand_category_insight,
    brand_users,
    price_products,
    price_sensitivity,
)
from clickloom.operators.rfm import rfm_segment_distribution, rfm_segments
from clickloom.plans.pipeline import audit_of
from clickloom.schema import (
    AUDIT,
    BRANDS,
    FUNNEL,
    HOURS,
    PRICES,
    REVENUE,
    RFM,
    RUN_LOG,
    RUN_LOG_SCHEMA,
    SEGMENTS,
    WEEKDAYS,
)
from clickloom.session import delete_folder, fresh_folder
from clickloom.sources.sinks import ParquetLoad, ParquetSink, Sink, resolved

NO_DATE = "none"  # the day of events without a time
WHOLE = "whole"  # the batch that stands for all events of its dates


def _sums(names: Iterable[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


@dataclass(frozen=True)
class State:
    """What is kept of one date's events: a row per ``keys``, and how rows of equal keys merge."""

    name: str
    keys: tuple[str, ...]
    of: Callable[[DataFrame], DataFrame]
    merged: tuple[Column, ...]


def _states() -> list[State]:
    counted = (*MEASURES, *[f"null_{name}" for name in AUDITED], "bad_lines")
    bits = [F.bit_or(name).alias(name) for name in ("steps", "weekdays")]
    return [
        State(
            "grid",
            ("date", "hour", "day_of_week"),
            lambda e: e.groupBy("date", "hour", "day_of_week").agg(*activity_counts(e, AUDITED)),
            tuple(_sums(counted)),
        ),
        State(
            "sessions",
            ("date", "user_session"),
            lambda e: e.filter("user_session is not null")
            .groupBy("date", "user_session")
            .agg(*session_bits()),
            tuple(bits),
        ),
        State(
            "days",
            ("date", "user_id", "bought"),
            lambda e: user_sums(e, F.col("date")),
            (F.bit_or("hours").alias("hours"), *_sums(("events", "micros", "paid", "paid_micros"))),
        ),
        State(
            "brands",
            ("date", "brand", "category_main", "user_id"),
            lambda e: brand_users(e, "date"),
            tuple(_sums(BRAND_SUMS)),
        ),
        State(
            "prices",
            ("date", "bracket", "product_id"),
            lambda e: price_products(e, "date"),
            tuple(_sums(PRICE_SUMS)),
        ),
    ]


def _entry(state: str, day: str) -> str:
    return f"state/{state}/{day}"


def _batch(path: str) -> str:
    return next(part[6:] for part in path.split("/") if part.startswith("batch="))


def _bring(load: ParquetLoad, state: State, frame: DataFrame, batch: str) -> tuple[str, T.StructType]:
    """Write a state's rows, one folder per date."""
    place = load.place(f"{state.name}/batch={batch}")
    by_day = frame.withColumn("day", F.coalesce(F.col("date").cast("string"), F.lit(NO_DATE)))
    # Files of a size that suits reading, however many tasks have rows of a date.
    by_day.hint("rebalance", "day").write.partitionBy("day").parquet(f"{load.sink.folder}/{place}")
    return place, frame.schema


def _derived(
    states: dict[str, DataFrame], pool: ThreadPoolExecutor, folder: str
) -> dict[str, Callable[[], DataFrame]]:
    grid, days = states["grid"], states["days"]
    masks = (
        states["sessions"]
        .groupBy("user_session")
        .agg(F.bit_or("steps").alias("steps"), F.bit_or("weekdays").alias("weekdays"))
    )

    def profile() -> DataFrame:
        """At most 2,048 rows, stored since two tables use them."""
        found = masks.groupBy("steps", "weekdays").agg(F.count("*").alias("sessions"))
        found.write.parquet(f"{folder}/sessions")
        return found.sparkSession.read.schema(found.schema).parquet(f"{folder}/sessions")

    sessions = pool.submit(profile)
    segments = pool.submit(lambda: rfm_segments(days, None, days, f"{folder}/tiles"))
    return {
        RFM: segments.result,
        SEGMENTS: lambda: rfm_segment_distribution(segments.result()),
        BRANDS: lambda: brand_category_insight(days, states["brands"]),
        PRICES: lambda: price_sensitivity(days, states["prices"]),
        REVENUE: lambda: daily_revenue(days, days),
        HOURS: lambda: hourly_activity(days, grid, days),
        WEEKDAYS: lambda: weekday_activity(days, grid, sessions.result()),
        FUNNEL: lambda: funnel_summary(days, sessions.result()),
        AUDIT: lambda: audit_of(grid),
    }


def _on(dates: Iterable[datetime.date | None]) -> Column:
    """Events of these dates; a range around them reaches the scan."""
    known = sorted(date for date in dates if date is not None)
    chosen = F.lit(False)
    if known:
        inside = F.col("date").between(F.lit(known[0]), F.lit(known[-1]))
        chosen = inside & F.col("date").isin(known) if len(known) > 1 else inside
    return chosen | F.col("date").isNull() if None in dates else chosen


def states_of(
    spark: SparkSession, store: ParquetSink, entries: dict[str, dict]
) -> dict[str, DataFrame]:
    """The states of all dates that the manifest's entries name, each merged per date.

    Only dates that came in several batches are grouped again.
    """
    found = {}
    for state in _states():
        mine = [entry for name, entry in entries.items() if name.startswith(_entry(state.name, ""))]
        if not mine:
            continue
        schema = mine[0]["schema"]
        single = [entry["paths"][0] for entry in mine if len(entry["paths"]) == 1]
        several = [path for entry in mine if len(entry["paths"]) > 1 for path in entry["paths"]]
        parts = [resolved(spark, store.folder, {"paths": single, "schema": schema})] if single else []
        if several:
            rows = resolved(spark, store.folder, {"paths": several, "schema": schema})
            parts.append(rows.groupBy(*state.keys).agg(*state.merged))
        found[state.name] = reduce(DataFrame.unionByName, parts)
    return found


def run_increment(
    spark: SparkSession,
    source: DataFrame,
    store: ParquetSink,
    dates: Iterable[datetime.date | None] | None = None,
    batch: str | None = None,
    sink: Sink | None = None,
    zone: str = "UTC",
    parallel: int = 4,
) -> dict[str, DataFrame]:
    """Take in new events and bring all result tables up to date; returns the tables by name.

    Events are reduced to states per date, which ``store`` keeps next to the tables: activity, sessions,
    users, brands' users and brackets' products. Only ``source`` is scanned, and of it only ``dates``
    if given (None stands for events without a time); all tables are derived from states.

    Without ``batch`` the events are all there are of their dates: states of these dates, and of those
    in ``dates`` that have no event any more, are replaced. With ``batch`` they come on top: the date
    keeps its other batches, and running the same batch again replaces what it brought. So in both
    cases a rerun changes nothing.

    States, tables and run log become current together (see ``ParquetSink``); a failed run leaves
    everything as it was and raises. Two runs at once: the one that ends last raises, since its
    tables would lack the other's events. ``sink`` gets a copy of the tables afterwards.
    """
    events = clean(source, zone)
    if dates is not None:
        dates = set(dates)
        events = events.filter(_on(dates))
    named = batch or WHOLE
    if "/" in named:
        raise ValueError("a batch's name has no slash")
    before = store.manifests(spark).newest()[1]
    before = {name: entry for name, entry in before.items() if name.startswith("state/")}
    run_id, folder = uuid.uuid4().hex, fresh_folder(spark, "increment")
    try:
        with store.load(spark) as load, ThreadPoolExecutor(parallel) as pool:
            states = _states()
            brought = list(pool.map(lambda s: _bring(load, s, s.of(events), named), states))
            entries = dict(before)
            written = [_days(spark, f"{store.folder}/{place}") for place, _ in brought]
            touched = {NO_DATE if date is None else str(date) for date in dates or ()}.union(*written)
            if batch:  # dates that an earlier run of this batch had
                touched |= {
                    name.split("/")[2]
                    for name, entry in before.items()
                    if named in map(_batch, entry["paths"])
                }
            for state, (place, schema), new in zip(states, brought, written, strict=True):
                for day in touched:
                    name = _entry(state.name, day)
                    paths = before.get(name, {"paths": []})["paths"]
                    kept = [path for path in paths if batch and _batch(path) != named]
                    kept += [f"{place}/day={day}"] if day in new else []
                    if kept:
                        entries[name] = {"paths": kept, "schema": schema.jsonValue()}
                        load.put(name, kept, schema)
                    elif name in before:
                        del entries[name]
                        load.drop(name)

            def unchanged(now: dict) -> None:
                if {n: e for n, e in now.items() if n.startswith("state/")} != before:
                    raise RuntimeError("another run has changed the states meanwhile")

            load.check(unchanged)
            whole = states_of(spark, store, entries)
            for state, (_, schema) in zip(states, brought, strict=True):
                whole.setdefault(state.name, spark.createDataFrame([], schema))
            derived = _derived(whole, pool, folder)

            def write(table: str) -> tuple:
                load.write(derived[table](), table)
                now = datetime.datetime.now(datetime.timezone.utc)
                return run_id, table, "loaded", load.count(table), None, now

            log = list(pool.map(write, derived))
            load.write(spark.createDataFrame(log, RUN_LOG_SCHEMA), RUN_LOG, "append")
    finally:
        delete_folder(spark, folder)
    tables = {table: load.read(table) for table in derived}
    if sink is not None:
        with sink.load(spark) as copy:
            for table, frame in tables.items():
                copy.write(frame, table)
    return tables


def _days(spark: SparkSession, folder: str) -> set[str]:
    """The dates that a state was written for, from the names of its folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [status.getPath().getName() for status in found]
    return {name[4:] for name in names if name.startswith("day=")}
