"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from clickloom import (
    clean,
    daily_revenue,
    funnel_summary,
    hourly_activity,
    price_sensitivity,
    rfm_base,
)
from clickloom.operators.activity import activity_grid
from clickloom.plans.increments import _states
from clickloom.schema import EVENT_SCHEMA
from clickloom.session import input_size
from clickloom.sources.fixture import read_fixture

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_PRODUCTS = [
    "row_counts",
    "session_flags",
    "funnel_summary",
    "rfm_base",
    "hourly_activity",
    "weekday_activity",
    "daily_revenue",
]
LAZY = [*WITHOUT_PRODUCTS, "null_audit", "brand_category_insight", "price_sensitivity", "top_brands"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Events as a shop would keep them: nine plain Parquet columns."""
    path = str(tmp_path_factory.mktemp("stored") / "events")
    raw = read_fixture(spark, SF_DIR).select(EVENT_SCHEMA.names)
    raw.withColumn("event_time", F.col("event_time").cast("timestamp")).write.parquet(path)
    return clean(spark.read.parquet(path))


def columns_read(text):
    return [
        set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*)>", text)
    ]


def test_purchase_filter_reaches_the_scan(stored):
    for frame in (rfm_base(stored), daily_revenue(stored)):
        text = plan(frame)
        scans = text.count("FileScan")
        assert text.count("EqualTo(event_type,purchase)") == scans > 0
    assert "GreaterThan(price,0" in plan(daily_revenue(stored))
    assert "GreaterThan(price,0" in plan(price_sensitivity(stored))


def test_dates_reach_the_scan(stored):
    text = plan(stored.filter("date = date'2024-01-15'").select("event_type"))
    assert "GreaterThanOrEqual(event_time,2024-01-15" in text
    assert "LessThan(event_time" in text


def test_registered_query_pushes_its_filters(spark):
    text = plan(driver.queries()["parquet_scan"](spark, SF_DIR))
    assert text.count("EqualTo(event_type,purchase)") == text.count("FileScan") > 0
    assert "GreaterThanOrEqual(event_time," in plan(driver.queries()["revenue_of_day"](spark, SF_DIR))


def test_only_needed_columns_are_read(stored):
    assert columns_read(plan(funnel_summary(stored))) == [{"event_type", "user_session"}]
    assert columns_read(plan(activity_grid(stored))) == [{"event_time", "event_type"}]
    assert sorted(map(sorted, columns_read(plan(hourly_activity(stored))))) == [
        ["event_time", "event_type"],
        ["event_time", "user_id"],
    ]
    assert {"event_type", "event_time"} in columns_read(plan(rfm_base(stored)))


@pytest.mark.parametrize("name", [*LAZY, "rfm_segments"])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", WITHOUT_PRODUCTS)
def test_products_are_joined_only_where_used(spark, name):
    assert "part.parquet" not in plan(driver.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", LAZY)
def test_rows_are_combined_before_every_shuffle(spark, name):
    """Each hash exchange stands on a partial aggregate, so hot keys shrink in the map tasks."""
    lines = plan(driver.queries()[name](spark, SF_DIR)).split("\n")
    exchanges = [i for i, line in enumerate(lines) if re.search(r"\bExchange hash", line)]
    for i in exchanges:
        assert re.search(r"Aggregate\(key.*(partial_|merge_|functions=\[\])", lines[i + 1]), lines[i]


def test_customers_are_never_in_one_task(spark):
    """Single-partition steps of the result see partial aggregates only, and nothing is sorted."""
    text = plan(driver.queries()["rfm_segments"](spark, SF_DIR))
    lines = text.split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    below = [lines[i + 1] for i in single]
    assert len(single) == 1
    assert all("functions=[partial_max" in line for line in below)
    assert "rangepartitioning" not in text and "Sort" not in text


def test_many_parts_are_not_sent_to_the_driver(spark, tmp_path):
    """1.3 MB of files, which Spark alone would broadcast, each time that brands are needed."""
    parts = spark.range(200_000).selectExpr(
        "id as p_partkey",
        "concat('large ', hash(id)) as p_name",
        "concat('Brand#', id % 25) as p_brand",
        "'LARGE' as p_type",
        "cast(id % 50 as int) as p_size",
    )
    parts.write.parquet(str(tmp_path / "part.parquet"))
    (tmp_path / "events.parquet").symlink_to(f"{SF_DIR}/events.parquet")
    assert 1 << 20 < input_size(spark, str(tmp_path / "part.parquet")) < 10 << 20
    many = clean(read_fixture(spark, str(tmp_path)))
    few = clean(read_fixture(spark, SF_DIR))
    for state in _states():
        text = plan(state.of(many))
        assert "Broadcast" not in text
        assert ("SortMergeJoin" in text) == ("BroadcastHashJoin" in plan(state.of(few)))
    assert "Join" not in plan(funnel_summary(many))


def test_top_brands_sorts_only_what_it_keeps(spark):
    assert "TakeOrderedAndProject" in plan(driver.queries()["top_brands"](spark, SF_DIR))
