"""Clickstream analytics as plain Spark DataFrame jobs."""

from clickloom.operators.activity import daily_revenue, hourly_activity, weekday_activity
from clickloom.operators.clean import clean, null_audit, rejects, row_counts
from clickloom.operators.funnel import funnel_summary, session_flags
from clickloom.operators.merchandise import (
    brand_category_insight,
    brand_category_rollup,
    price_bracketed,
    price_sensitivity,
    top_brands,
)
from clickloom.operators.rfm import rfm_base, rfm_segment_distribution, rfm_segments
from clickloom.operators.tiles import rank_tiles
from clickloom.plans.increments import run_increment
from clickloom.plans.pipeline import in_order, preview, run_pipeline
from clickloom.plans.stored_run import StoredRun
from clickloom.session import create_session
from clickloom.sources.events import read_events
from clickloom.sources.sinks import JdbcSink, ParquetSink

__all__ = [
    "JdbcSink",
    "ParquetSink",
    "StoredRun",
    "brand_category_insight",
    "brand_category_rollup",
    "clean",
    "create_session",
    "daily_revenue",
    "funnel_summary",
    "hourly_activity",
    "in_order",
    "null_audit",
    "preview",
    "price_bracketed",
    "price_sensitivity",
    "rank_tiles",
    "read_events",
    "rejects",
    "rfm_base",
    "rfm_segment_distribution",
    "rfm_segments",
    "row_counts",
    "run_increment",
    "run_pipeline",
    "session_flags",
    "top_brands",
    "weekday_activity",
]
