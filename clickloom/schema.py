"""Declared schemas: what comes in and the names of what goes out."""

from pyspark.sql import types as T

# Input columns, in file order.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DecimalType(38, 18)),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# Where the CSV reader keeps the text of a line it could not parse in full.
BAD_LINE = "_corrupt_record"

# Of a bad line, on request: struct<file, failed_columns>. NULL for all others.
REJECT = "_reject"
REJECT_TYPE = "struct<file:string,failed_columns:string>"

# Whether a staged event comes from a bad line; bad lines have files of their own.
REJECTED = "_rejected"


def day_column(zone: str) -> str:
    """The column by which staged events are laid, their date in ``zone``."""
    return f"_date {zone}"


# Fixed value: how event times are written in the CSV files.
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss z"

# Names of the result tables.
FUNNEL = "tbl_funnel_analysis"
SEGMENTS = "tbl_rfm_segment_distribution"
RFM = "tbl_rfm_segments"
BRANDS = "tbl_brand_category_insight"
PRICES = "tbl_price_sensitivity"
HOURS = "tbl_hourly_activity"
WEEKDAYS = "tbl_daily_activity"
REVENUE = "tbl_daily_revenue"

# Tables that describe a run.
AUDIT = "tbl_event_audit"
REJECTS = "tbl_event_rejects"
RUN_LOG = "tbl_run_log"

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
