
from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickloom.functions.clickstream import wall_clock  # noqa: E402
from clickloom.operators import activity, funnel, merchandise, rfm  # noqa: E402
from clickloom.operators.clean import clean, null_audit, row_counts  # noqa: E402
from clickloom.plans.increments import run_increment  # noqa: E402
from clickloom.plans.pipeline import run_pipeline  # noqa: E402
from clickloom.schema import (  # noqa: E402
    AUDIT,
    BRANDS,
    EVENT_SCHEMA,
    FUNNEL,
    HOURS,
    PRICES,
    REJECTS,
    REVENUE,
    RFM,
    RUN_LOG,
    SEGMENTS,
    WEEKDAYS,
)
from clickloom.session import fresh_folder, set_folder_if_unset  # noqa: E402
from clickloom.sources.events import read_events, stage_events  # noqa: E402
from clickloom.sources.fixture import FINE_PRICE, PRICE, read_fixture  # noqa: E402
from clickloom.sources.sinks import ParquetSink  # noqa: E402

try:
    from clickloom.llm import queries as llm  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("clickloom.llm", "corpus_pipeline"):
        raise
    llm = None  # the subpackage is not there; everything else works without it

CLEAN_COLUMNS = (
    "event_id",
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
    "year",
    "month",
    "day_of_week",
    "hour",
    "date",
    "day_name",
    "category_main",
    "category_sub",
)


# Fixed value: the day of the one-day query.
ONE_DAY = datetime.date(2024, 1, 15)


def _on(analysis: Callable[[DataFrame], DataFrame], price: str = PRICE):
    """A query that runs one analysis on the cleaned test events."""
    return lambda spark, sf_dir: analysis(clean(read_fixture(spark, sf_dir, price)))


def _as_text(events: DataFrame) -> DataFrame:
    """Events with times as shops export them, to the whole second: the layout has no more."""
    written = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'")
    return events.withColumns({"event_time": written, "_index": F.col("event_id")})


def _exported(spark: SparkSession, events: DataFrame, rejects: bool = False) -> DataFrame:
    """Events written as CSV, columns in another order and one more, and read back."""
    folder = fresh_folder(spark, "csv")
    events.select("_index", *sorted(EVENT_SCHEMA.names)).write.option("header", "true").csv(folder)
    return read_events(spark, folder, rejects=rejects)


def _with_bad_lines(spark: SparkSession, sf_dir: str, rejects: bool = False) -> DataFrame:
    """A CSV file in which some times, prices and users are not what they should be."""
    events = _as_text(read_fixture(spark, sf_dir))
    planted = {
        "event_time": F.expr("if(event_id % 13 = 0, 'soon', event_time)"),
        "price": F.expr("if(event_id % 17 = 0, 'oops', cast(price as string))"),
        "user_id": F.expr("if(event_id % 19 = 0, concat('u', user_id), cast(user_id as string))"),
    }
    return _exported(spark, events.withColumns(planted), rejects)


def _csv_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_audit(clean(_with_bad_lines(spark, sf_dir)))


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's table of bad lines, next to the number of them that its audit has."""
    sink = ParquetSink(fresh_folder(spark, "tables"))
    tables = run_pipeline(spark, _with_bad_lines(spark, sf_dir, rejects=True), sink)
    event = F.split("line", ",")[0].cast("bigint").alias("event_id")
    lines = tables[REJECTS].select(event, "failed_columns", (F.col("file") != "").alias("named"))
    return lines.filter("named").drop("named").join(tables[AUDIT].select("bad_lines"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events as other jobs leave them: Parquet, instants, prices as doubles, more columns."""
    folder = fresh_folder(spark, "parquet")
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', event_time)"
    events = read_fixture(spark, sf_dir).withColumns(
        {
            "event_time": F.expr(f"timestamp_micros({since})"),  # UTC in any session's zone
            "price": F.col("price").cast("double"),
        }
    )
    events.write.parquet(folder)
    return clean(read_events(spark, folder, "parquet"))


def _parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from stored events; the purchase filter reaches the scan."""
    return rfm.rfm_base(_stored(spark, sf_dir))


def _revenue_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of stored events; its range of instants reaches the scan."""
    events = _stored(spark, sf_dir)
    return activity.daily_revenue(events.filter(F.col("date") == F.lit(ONE_DAY)))


def _laid(analysis: Callable[[DataFrame], DataFrame]):
    """A query on events staged by date; filters on dates choose files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged, _ = stage_events(read_fixture(spark, sf_dir), "UTC")
        return analysis(clean(staged))

    return run


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the test events as CSV, read them back by their header and clean them.

    Without event_id, which the layout does not have.
    """
    scanned = _exported(spark, _as_text(read_fixture(spark, sf_dir)))
    kind = scanned.schema["event_time"].dataType
    return (
        clean(scanned)
        .withColumn("event_time", wall_clock(F.col("event_time"), kind, "UTC"))
        .select(*EVENT_SCHEMA.names, "year", "month", "day_of_week", "hour", "date")
    )


def _parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load a result table twice; the second load must replace the first."""
    sink = ParquetSink(fresh_folder(spark, "tables"))
    revenue = activity.daily_revenue(clean(read_fixture(spark, sf_dir)))
    for _ in range(2):
        sink.write(revenue, "daily_revenue")
    return sink.read(spark, "daily_revenue")


def _pipeline(stage: str | None, table: str | None = None):
    """The whole run on the test events; returns one of its tables, or its log."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sink = ParquetSink(fresh_folder(spark, "tables"))
        tables = run_pipeline(spark, read_fixture(spark, sf_dir), sink, stage=stage)
        if table is not None:
            return tables[table]
        return sink.read(spark, RUN_LOG).select("table_name", "status", "row_count")

    return run


def _increments(table: str, on_top: bool):
    """Runs on the events of three periods, the first without its late events, which come at the end.

    They come as a batch of their own, or the first period is brought again with them.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = ParquetSink(fresh_folder(spark, "increments"))
        events = read_fixture(spark, sf_dir)
        date, late = F.to_date("event_time"), F.col("event_id") % 7 == 0
        first, second = F.lit(ONE_DAY), F.lit(ONE_DAY + datetime.timedelta(days=7))
        early = date < first
        run_increment(spark, events.filter(early & ~late), store)
        run_increment(spark, events.filter((date >= first) & (date < second)), store)
        run_increment(spark, events.filter((date >= second) | date.isNull()), store)
        if on_top:
            return run_increment(spark, events.filter(early & late), store, batch="late")[table]
        return run_increment(spark, events.filter(early), store)[table]

    return run


def _with_folder(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        set_folder_if_unset(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = _analyses() | (llm.queries() if llm else {})
    return {name: _with_folder(query) for name, query in registered.items()}


def _analyses() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "events_clean": _on(lambda e: e.select(*CLEAN_COLUMNS)),
        "null_audit": _on(null_audit),
        "row_counts": _on(row_counts),
        "session_flags": _on(funnel.session_flags),
        "funnel_summary": _on(funnel.funnel_summary),
        "rfm_base": _on(rfm.rfm_base),
        "rfm_segments": _on(rfm.rfm_segments),
        "rfm_segment_distribution": _on(
            lambda e: rfm.rfm_segment_distribution(rfm.rfm_segments(e))
        ),
        "brand_category_insight": _on(merchandise.brand_category_insight),
        "top_brands": _on(merchandise.top_brands),
        "price_bracketed": _on(
            lambda e: merchandise.price_bracketed(e).select("event_id", "price", "price_bracket")
        ),
        "price_sensitivity": _on(merchandise.price_sensitivity),
        "hourly_activity": _on(activity.hourly_activity),
        "weekday_activity": _on(activity.weekday_activity),
        "daily_revenue": _on(activity.daily_revenue),
        "csv_scan": _csv_scan,
        "parquet_round_trip": _parquet_round_trip,
        "price_brackets_fine": _on(merchandise.price_sensitivity, FINE_PRICE),
        "daily_revenue_fine": _on(activity.daily_revenue, FINE_PRICE),
        "rfm_as_of": _on(lambda e: rfm.rfm_segments(e, ONE_DAY)),
        "csv_bad_lines": _csv_bad_lines,
        "parquet_scan": _parquet_scan,
        "revenue_of_day": _revenue_of_day,
        "revenue_of_laid_day": _laid(
            lambda e: activity.daily_revenue(e.filter(F.col("date") == F.lit(ONE_DAY)))
        ),
        "rfm_as_of_laid": _laid(lambda e: rfm.rfm_segments(e, ONE_DAY)),
        "csv_rejects": _csv_rejects,
        "run_log": _pipeline(None),
        "pipeline_weekdays": _pipeline("table", WEEKDAYS),
        "pipeline_hours": _pipeline("memory", HOURS),
        "pipeline_funnel": _pipeline("none", FUNNEL),
        "pipeline_audit": _pipeline("table", AUDIT),
        "pipeline_rfm": _pipeline("none", RFM),
        "pipeline_segments": _pipeline("memory", SEGMENTS),
        "pipeline_brands": _pipeline("memory", BRANDS),
        "pipeline_prices": _pipeline("table", PRICES),
        "pipeline_revenue": _pipeline("none", REVENUE),
        "brand_category_rollup": _on(merchandise.brand_category_rollup),
        "increment_rfm": _increments(RFM, on_top=True),
        "increment_hours": _increments(HOURS, on_top=True),
        "increment_brands": _increments(BRANDS, on_top=False),
        "increment_funnel": _increments(FUNNEL, on_top=False),
    }


def entry(spark: SparkSession) -> DataFrame:
    return queries()["rfm_segments"](spark, "/root/testdata/sf0.001")


# --- SQL side -----------------------------------------------------------------------------

# Weekday, bracket and segment labels and their bounds, as in
# clickloom/functions/clickstream.py.


def _fixture(price: str) -> str:
    return f"""
with keyed as (
  select e.*, cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) as bigint) as k from events e
),
raw as (
  select event_id,
    case when event_id % 211 = 0 then null else ts end as event_time,
    case when event_type = 'click' then 'cart' else event_type end as event_type,
    k as product_id,
    cast(p_size as bigint) as category_id,
    case when k % 7 = 0 then null
         when k % 5 = 0 then lower(p_type)
         else lower(p_type) || '.' || split_part(p_name, ' ', 2) end as category_code,
    case when k % 10 = 3 then null else p_brand end as brand,
    case when event_id % 97 = 0 then null
         when event_id % 50 = 0 then 0
         else {price} end as price,
    user_id,
    case when event_id % 101 = 0 then null
         else cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') end as user_session
  from keyed left join part on p_partkey = k
),
clean as (
  select *, cast(price * 1000000 as bigint) as micros,
    cast(year(event_time) as integer) as year,
    cast(month(event_time) as integer) as month,
    cast(dayofweek(event_time) + 1 as integer) as day_of_week,
    cast(hour(event_time) as integer) as hour,
    cast(event_time as date) as date,
    case dayofweek(event_time) when 0 then 'Sunday' when 1 then 'Monday' when 2 then 'Tuesday'
      when 3 then 'Wednesday' when 4 then 'Thursday' when 5 then 'Friday' when 6 then 'Saturday'
      end as day_name,
    split_part(category_code, '.', 1) as category_main,
    case when category_code like '%.%' then split_part(category_code, '.', 2) end as category_sub
  from raw
)
"""


_EVENTS = _fixture(PRICE)
_FINE_EVENTS = _fixture(FINE_PRICE)


def _half_up(numerator: str, denominator: str) -> str:
    n, d = numerator, denominator
    return f"((2 * cast({n} as bigint) + cast({d} as bigint)) // (2 * nullif({d}, 0))) / 100.0"


def _percent(part: str, whole: str) -> str:
    return f"cast({_half_up(f'10000 * ({part})', whole)} as double)"


def _money(micros: str) -> str:
    return f"cast({_half_up(micros, '10000')} as double)"


def _mean(micros: str, count: str) -> str:
    return f"cast({_half_up(micros, f'10000 * {count}')} as double)"


def _events(kind: str) -> str:
    return f"count(*) filter (where event_type = '{kind}')"


_FLAGS = """,
flags as (
  select user_session,
    cast(max(case when event_type = 'view' then 1 else 0 end) as integer) as has_view,
    cast(max(case when event_type = 'cart' then 1 else 0 end) as integer) as has_cart,
    cast(max(case when event_type = 'purchase' then 1 else 0 end) as integer) as has_purchase,
    count(distinct user_id) as distinct_users,
    count(*) as total_events
  from clean where user_session is not null group by user_session
)
"""

_FUNNEL = f""",
steps as (
  select count(*) as total_sessions,
    cast(sum(has_view) as bigint) as sessions_with_view,
    cast(sum(has_cart) as bigint) as sessions_with_cart,
    cast(sum(has_purchase) as bigint) as sessions_with_purchase
  from flags
)
select *,
  {_percent("sessions_with_cart", "sessions_with_view")} as view_to_cart_rate,
  {_percent("sessions_with_purchase", "sessions_with_cart")} as cart_to_purchase_rate,
  {_percent("sessions_with_purchase", "total_sessions")} as overall_conversion_rate
from steps
"""

_CUSTOMERS = """,
base as (
  select user_id,
    cast((select max(date) from clean where event_type = 'purchase') - max(date) as integer)
      as recency_days,
    count(*) as frequency,
    cast(sum(micros) as bigint) as micros
  from clean where event_type = 'purchase' group by user_id
)
"""

_CUSTOMERS_AS_OF = f""",
base as (
  select user_id, cast(date '{ONE_DAY}' - max(date) as integer) as recency_days,
    count(*) as frequency, cast(sum(micros) as bigint) as micros
  from clean
  where event_type = 'purchase' and (date is null or date <= date '{ONE_DAY}')
  group by user_id
)
"""

_SCORED = f""",
scored as (
  select user_id, recency_days, frequency, {_money("micros")} as monetary,
    cast(ntile(5) over (order by recency_days desc nulls first, user_id nulls first) as integer)
      as r_score,
    cast(ntile(5) over (order by frequency, user_id nulls first) as integer) as f_score,
    cast(ntile(5) over (order by {_money("micros")} nulls first, user_id nulls first) as integer)
      as m_score
  from base
),
segments as (
  select *, 100 * r_score + 10 * f_score + m_score as rfm_score,
    case when r_score = 5 and f_score = 5 and m_score = 5 then 'Champion'
         when r_score >= 4 and f_score >= 4 then 'Loyal Customer'
         when r_score >= 3 and f_score >= 3 then 'Potential Loyalist'
         when r_score <= 2 and f_score >= 3 then 'At Risk'
         when r_score <= 2 then 'Lost'
         else 'Window Shopper' end as segment
  from scored
)
"""

_BRANDS = f""",
brands as (
  select brand, category_main, {_events("view")} as total_views,
    {_events("cart")} as total_carts, {_events("purchase")} as total_purchases,
    {_money("sum(case when event_type = 'purchase' then micros else 0 end)")} as total_revenue,
    {_mean("sum(micros)", "count(micros)")} as avg_price,
    count(distinct user_id) as unique_users,
    coalesce({_percent(_events("purchase"), _events("view"))}, 0) as view_to_purchase_rate
  from clean where brand is not null and category_code is not null
  group by brand, category_main
)
"""

_ROLLUP = f"""
select case when grouping(brand) = 0 and grouping(category_main) = 0 then 'brand and category'
            when grouping(brand) = 0 then 'brand'
            when grouping(category_main) = 0 then 'category' else 'all' end as level,
    brand, category_main, {_events("view")} as total_views,
    {_events("cart")} as total_carts, {_events("purchase")} as total_purchases,
    {_money("sum(case when event_type = 'purchase' then micros else 0 end)")} as total_revenue,
    {_mean("sum(micros)", "count(micros)")} as avg_price,
    count(distinct user_id) as unique_users,
    coalesce({_percent(_events("purchase"), _events("view"))}, 0) as view_to_purchase_rate
from clean where brand is not null and category_code is not null
group by grouping sets ((brand, category_main), (brand), (category_main), ())
"""

_BRACKETS = """,
priced as (
  select *, case when price < 50 then 'Budget (<$50)'
                 when price < 200 then 'Mid ($50-$200)'
                 when price < 500 then 'Premium ($200-$500)'
                 when price < 1000 then 'Luxury ($500-$1000)'
                 else 'Ultra Luxury (>$1000)' end as price_bracket
  from clean where brand is not null and category_code is not null and price > 0
)
"""

_ACTIVITY = f"""count(*) as total_events, {_events("view")} as views,
    {_events("cart")} as carts, {_events("purchase")} as purchases"""

_REVENUE = f""",
revenue as (
  select date, {_money("sum(micros)")} as daily_revenue, count(*) as total_purchases,
    count(distinct user_id) as unique_buyers, {_mean("sum(micros)", "count(*)")} as avg_order_value
  from clean where event_type = 'purchase' and price > 0 group by date
)
"""

_BY_BRACKET = f"""
select price_bracket, count(*) as total_events, {_events("view")} as views,
  {_events("purchase")} as purchases, {_mean("sum(micros)", "count(*)")} as avg_price,
  count(distinct product_id) as distinct_products,
  coalesce({_percent(_events("purchase"), _events("view"))}, 0) as purchase_rate_pct
from priced group by price_bracket
"""

_BY_HOUR = f"""
select hour, {_ACTIVITY}, count(distinct user_id) as unique_users from clean group by hour
"""


def _audit(table: str, bad_lines: str) -> str:
    nulls = ", ".join(
        f"count(*) filter (where {name} is null) as null_{name}" for name in EVENT_SCHEMA.names
    )
    return f"select count(*) as row_count, {nulls}, {bad_lines} as bad_lines from {table}"


_AUDIT = _audit("clean", "cast(0 as bigint)")

_DISTRIBUTION = "select segment, count(*) as count from segments group by segment"

_BY_WEEKDAY = f"""
select day_of_week, day_name, {_ACTIVITY}, count(distinct user_session) as unique_sessions
from clean group by day_of_week, day_name
"""


def _logged(table: str, rows: str) -> str:
    return f"select '{table}' as table_name, 'loaded' as status, cast(({rows}) as bigint) as row_count"


def oracle_sql() -> dict[str, str]:
    return _analyses_sql() | (llm.oracle_sql() if llm else {})


def _analyses_sql() -> dict[str, str]:
    columns = ", ".join(CLEAN_COLUMNS).replace("price,", "cast(price as double) as price,")
    return {
        "events_clean": f"{_EVENTS} select {columns} from clean",
        "null_audit": f"{_EVENTS} {_AUDIT}",
        "row_counts": f"{_EVENTS} select event_type, count(*) as total_events from clean group by 1",
        "session_flags": f"{_EVENTS}{_FLAGS} select * from flags",
        "funnel_summary": f"{_EVENTS}{_FLAGS}{_FUNNEL}",
        "rfm_base": f"""{_EVENTS}{_CUSTOMERS}
            select user_id, recency_days, frequency, {_money("micros")} as monetary from base""",
        "rfm_segments": f"{_EVENTS}{_CUSTOMERS}{_SCORED} select * from segments",
        "rfm_segment_distribution": f"{_EVENTS}{_CUSTOMERS}{_SCORED} {_DISTRIBUTION}",
        "rfm_as_of": f"{_EVENTS}{_CUSTOMERS_AS_OF}{_SCORED} select * from segments",
        "parquet_scan": f"""{_EVENTS}{_CUSTOMERS}
            select user_id, recency_days, frequency, {_money("micros")} as monetary from base""",
        "revenue_of_day": f"{_EVENTS}{_REVENUE} select * from revenue where date = date '{ONE_DAY}'",
        "revenue_of_laid_day": f"""{_EVENTS}{_REVENUE}
            select * from revenue where date = date '{ONE_DAY}'""",
        "rfm_as_of_laid": f"{_EVENTS}{_CUSTOMERS_AS_OF}{_SCORED} select * from segments",
        "csv_rejects": f"""{_EVENTS}
            select event_id, concat_ws(',',
                if(event_id % 13 = 0, 'event_time', null), if(event_id % 17 = 0, 'price', null),
                if(event_id % 19 = 0, 'user_id', null)) as failed_columns,
              count(*) over () as bad_lines
            from clean where event_id % 13 = 0 or event_id % 17 = 0 or event_id % 19 = 0""",
        "csv_bad_lines": f"""{_EVENTS},
            planted as (
              select * replace (
                if(event_id % 13 = 0, null, event_time) as event_time,
                if(event_id % 17 = 0, null, price) as price,
                if(event_id % 19 = 0, null, user_id) as user_id),
                event_id % 13 = 0 or event_id % 17 = 0 or event_id % 19 = 0 as bad
              from clean)
            {_audit("planted", "count(*) filter (where bad)")}""",
        "brand_category_insight": f"{_EVENTS}{_BRANDS} select * from brands",
        "top_brands": f"""{_EVENTS}{_BRANDS}
            select * from brands order by total_revenue desc nulls last, brand, category_main
            limit 10""",
        "price_bracketed": f"""{_EVENTS}{_BRACKETS}
            select event_id, cast(price as double) as price, price_bracket from priced""",
        "price_sensitivity": f"{_EVENTS}{_BRACKETS}{_BY_BRACKET}",
        "price_brackets_fine": f"{_FINE_EVENTS}{_BRACKETS}{_BY_BRACKET}",
        "daily_revenue_fine": f"{_FINE_EVENTS}{_REVENUE} select * from revenue",
        "hourly_activity": f"{_EVENTS}{_BY_HOUR}",
        "weekday_activity": f"{_EVENTS}{_BY_WEEKDAY}",
        "daily_revenue": f"{_EVENTS}{_REVENUE} select * from revenue",
        "csv_scan": f"""{_EVENTS}
            select date_trunc('second', event_time) as event_time, event_type, product_id,
              category_id, category_code, brand, cast(price as double) as price, user_id,
              user_session, year, month, day_of_week, hour, date
            from clean""",
        "parquet_round_trip": f"{_EVENTS}{_REVENUE} select * from revenue",
        "run_log": " union all ".join(
            [
                f"{_EVENTS}{_CUSTOMERS}{_SCORED}{_BRANDS}{_BRACKETS}{_REVENUE}"
                + _logged("tbl_event_audit", "1"),
                _logged(
                    "tbl_rfm_segment_distribution", "select count(distinct segment) from segments"
                ),
                _logged("tbl_funnel_analysis", "1"),
                _logged("tbl_rfm_segments", "select count(*) from base"),
                _logged("tbl_brand_category_insight", "select count(*) from brands"),
                _logged(
                    "tbl_price_sensitivity", "select count(distinct price_bracket) from priced"
                ),
                _logged(
                    "tbl_hourly_activity",
                    "select count(distinct coalesce(hour, -1)) from clean",
                ),
                _logged(
                    "tbl_daily_activity",
                    "select count(distinct coalesce(day_of_week, -1)) from clean",
                ),
                _logged("tbl_daily_revenue", "select count(*) from revenue"),
            ]
        ),
        "pipeline_weekdays": f"{_EVENTS}{_BY_WEEKDAY}",
        "pipeline_hours": f"{_EVENTS}{_BY_HOUR}",
        "pipeline_funnel": f"{_EVENTS}{_FLAGS}{_FUNNEL}",
        "pipeline_audit": f"{_EVENTS} {_AUDIT}",
        "pipeline_rfm": f"{_EVENTS}{_CUSTOMERS}{_SCORED} select * from segments",
        "pipeline_segments": f"{_EVENTS}{_CUSTOMERS}{_SCORED} {_DISTRIBUTION}",
        "pipeline_brands": f"{_EVENTS}{_BRANDS} select * from brands",
        "pipeline_prices": f"{_EVENTS}{_BRACKETS}{_BY_BRACKET}",
        "pipeline_revenue": f"{_EVENTS}{_REVENUE} select * from revenue",
        "brand_category_rollup": f"{_EVENTS}{_ROLLUP}",
        "increment_rfm": f"{_EVENTS}{_CUSTOMERS}{_SCORED} select * from segments",
        "increment_hours": f"{_EVENTS}{_BY_HOUR}",
        "increment_brands": f"{_EVENTS}{_BRANDS} select * from brands",
        "increment_funnel": f"{_EVENTS}{_FLAGS}{_FUNNEL}",
    }
