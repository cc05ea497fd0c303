"""The whole run: clean, analyse, store every result, then load the sink."""

from __future__ import annotations

import contextlib
import datetime
import logging
import traceback
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed, wait

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.activity import (
    MEASURES,
    activity_grid,
    daily_revenue,
    hourly_activity,
    user_days,
    weekday_activity,
)
from clickloom.operators.clean import AUDITED, clean, rejects
from clickloom.operators.funnel import funnel_summary, session_profile
from clickloom.operators.merchandise import brand_category_insight, price_sensitivity
from clickloom.operators.rfm import rfm_segment_distribution, rfm_segments
from clickloom.schema import (
    AUDIT,
    BAD_LINE,
    BRANDS,
    FUNNEL,
    HOURS,
    PRICES,
    REJECT,
    REJECTS,
    REVENUE,
    RFM,
    RUN_LOG,
    RUN_LOG_SCHEMA,
    SEGMENTS,
    WEEKDAYS,
)
from clickloom.plans.stored_run import StoredRun
from clickloom.session import delete_folder, fresh_folder
from clickloom.sources.events import stage_events
from clickloom.sources.sinks import JdbcSink, Sink

log = logging.getLogger(__name__)

STAGES = ("none", "table", "dates", "memory")

RESULTS = (RFM, BRANDS, PRICES, REVENUE, HOURS, WEEKDAYS, FUNNEL, SEGMENTS, AUDIT)


def audit_of(grid: DataFrame) -> DataFrame:
    """Rows, NULLs and bad lines of the whole input, added up from the activity grid."""
    counted = {"row_count": MEASURES[0]} | {f"null_{name}": f"null_{name}" for name in AUDITED}
    counted["bad_lines"] = "bad_lines"
    return grid.agg(
        *[F.coalesce(F.sum(of), F.lit(0)).alias(name) for name, of in counted.items()]
    )


def _analyses(
    events: DataFrame, pool: ThreadPoolExecutor, folder: str
) -> dict[str, Callable[[], DataFrame]]:
    """What to run for each result table.

    Three stored tables feed most results: counts per hour and weekday, sessions per combination of
    steps and weekdays, and users per day of purchase. With brands and prices that makes five
    scans of the events, one shuffle by session and one by user. Shared tables are started first;
    analyses that need none do not wait for them.
    """

    def shared(name: str, frame: DataFrame):
        return pool.submit(lambda: _store(events.sparkSession, frame, f"{folder}/{name}")[0])

    grid = shared("grid", activity_grid(events, AUDITED))
    sessions = shared("sessions", session_profile(events))
    days = shared("days", user_days(events))
    segments = pool.submit(lambda: rfm_segments(events, None, days.result(), f"{folder}/tiles"))
    return {
        RFM: lambda: segments.result(),
        BRANDS: lambda: brand_category_insight(events),
        PRICES: lambda: price_sensitivity(events),
        REVENUE: lambda: daily_revenue(events, days.result()),
        HOURS: lambda: hourly_activity(events, grid.result(), days.result()),
        WEEKDAYS: lambda: weekday_activity(events, grid.result(), sessions.result()),
        FUNNEL: lambda: funnel_summary(events, sessions.result()),
        SEGMENTS: lambda: rfm_segment_distribution(segments.result()),
        AUDIT: lambda: audit_of(grid.result()),
        REJECTS: lambda: rejects(events),
    }


def _store(spark: SparkSession, frame: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Write a result, counting its rows on the way."""
    written = Observation()
    frame.observe(written, F.count("*").alias("rows")).write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder), written.get["rows"]


@contextlib.contextmanager
def _warning(message: str):
    try:
        yield
    except Exception:
        log.warning(message, exc_info=True)


def run_pipeline(
    spark: SparkSession,
    source: DataFrame,
    sink: Sink,
    stage: str | None = None,
    zone: str = "UTC",
    parallel: int = 4,
    resume: str | None = None,
) -> dict[str, DataFrame]:
    """Run all analyses on raw events and load their tables; returns the tables by name.

    ``stage`` says how events are shared between the analyses:

    * ``none``: each reads the columns it needs from the source; the default, for Parquet.
    * ``table``: events are written once as Parquet to the shared folder; the default for events
      that ``read_events`` has read from CSV.
    * ``dates``: the same, laid by date, see ``stage_events``.
    * ``memory``: they are cached; only for input that fits the executors.

    Up to ``parallel`` tables are computed, then loaded, side by side, so that the last tasks of
    one do not leave the cluster idle.

    The sink is touched only after every result has been computed and stored, and every table
    is counted after loading. A ``ParquetSink`` then makes all tables and the run log current at
    once, so a run that fails at any point leaves the tables of the run before. Each table's outcome is
    appended to the run log, a failure with its traceback.

    Events read with ``rejects`` give one more table, the lines that did not parse; staged, it reads only
    the files of these.

    The results of a failed run stay in the shared folder, also if the driver is lost, until the run is
    resumed or discarded (see ``StoredRun``). ``resume`` names such a run by its id, which is logged at
    the start, is in the run log, and noted on the error: what is stored is loaded as it is, and ``source``
    is only read for what is not. It must hold the same events. The log then has both attempts.
    """
    if stage is None:
        stage = "table" if BAD_LINE in source.columns else "none"
    if stage not in STAGES:
        raise ValueError(f"stage is one of {STAGES}")
    run = StoredRun(spark, resume or uuid.uuid4().hex, zone)
    run_id, attempt = run.run_id, uuid.uuid4().hex
    done = run.tables()
    if resume and not done:
        raise ValueError(f"run {resume} has no stored results")
    wanted = [*RESULTS, *([REJECTS] if REJECT in source.columns else [])]
    left = [table for table in wanted if table not in done]
    log.info("run %s: %d tables to compute, %d stored", run_id, len(left), len(done))
    entries: list[tuple] = []
    folders: list[str] = []
    cached = None
    current = "events"

    def note(table: str, status: str, rows: int | None, error: str | None = None) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        entries.append((run_id, table, status, rows, error, now))

    def outcome() -> DataFrame:
        return spark.createDataFrame(entries, RUN_LOG_SCHEMA)

    def each(pool: ThreadPoolExecutor, work: Callable[[str], object], tables: list[str]) -> dict:
        """Do one step for all tables. When one fails, those not yet started are left out."""
        nonlocal current
        running = {pool.submit(work, table): table for table in tables}
        done = {}
        try:
            for step in as_completed(running):
                current = running[step]
                done[current] = step.result()
        finally:
            for step in running:
                step.cancel()
            wait(running)  # nothing may be written after the load has been taken back
        return done

    try:
        if left and stage in ("table", "dates"):
            source, folder = stage_events(source, zone if stage == "dates" else None)
            folders.append(folder)
        elif left and stage == "memory":
            source = cached = source.persist(StorageLevel.MEMORY_AND_DISK)
        shared = fresh_folder(spark, "shared")
        folders.append(shared)
        with ThreadPoolExecutor(parallel) as pool:
            analyses = _analyses(clean(source, zone), pool, shared) if left else {}

            def compute(table: str) -> tuple[DataFrame, int]:
                place = f"{attempt}/{table}"
                frame, rows = _store(spark, analyses[table](), f"{run.folder}/{place}")
                run.add(table, place, frame.schema, rows)
                return frame, rows

            stored = run.read() | each(pool, compute, left)
            with sink.load(spark) as load:

                def bring(table: str) -> DataFrame:
                    frame, rows = stored[table]
                    load.write(frame, table)
                    loaded = load.count(table)
                    if loaded != rows:
                        raise RuntimeError(f"{table}: {rows} rows computed, {loaded} loaded")
                    note(table, "loaded", rows)
                    return load.read(table)

                tables = each(pool, bring, wanted)
                current = RUN_LOG
                load.write(outcome(), RUN_LOG, "append")
        folders.append(run.folder)
    except Exception as error:
        # What was loaded is in the log of a database only: a Parquet load takes all tables back.
        entries[:] = entries if isinstance(sink, JdbcSink) else []
        note(current, "failed", None, traceback.format_exc())
        # Neither a failing log nor a failing clean-up may hide what went wrong.
        with _warning("the run log was not written"):
            sink.write(outcome(), RUN_LOG, "append")
        with _warning(f"cannot tell what run {run_id} has stored"):
            if kept := run.tables():
                error.add_note(f"run {run_id} can be resumed, {len(kept)} tables are stored")
            else:
                folders.append(run.folder)
        raise
    finally:
        if cached is not None:
            cached.unpersist()
        for folder in folders:
            with _warning(f"{folder} was not deleted"):
                delete_folder(spark, folder)
    return {table: tables[table] for table in wanted}


def in_order(table: str, frame: DataFrame) -> DataFrame:
    """A result in its reading order; stored tables have none."""
    orders = {
        RFM: ["user_id"],
        SEGMENTS: [F.desc("count"), "segment"],
        BRANDS: [F.desc_nulls_last("total_revenue"), "brand", "category_main"],
        PRICES: ["avg_price", "price_bracket"],
        HOURS: ["hour"],
        WEEKDAYS: ["day_of_week"],
        REVENUE: ["date"],
    }
    return frame.orderBy(*orders[table]) if table in orders else frame


def preview(tables: dict[str, DataFrame], rows: int = 20) -> None:
    """Print the first rows of each table in its reading order."""
    for table, frame in tables.items():
        print(table)
        in_order(table, frame).show(rows, truncate=False)
