import datetime

import pytest
from pyspark.sql import functions as F
from rows import at, events, one

from clickloom import clean, null_audit, row_counts


def test_calendar(spark):
    row = one(clean(events(spark, {"event_time": at(6, 23)})))  # a Saturday
    assert (row["year"], row["month"], row["hour"]) == (2024, 1, 23)
    assert (row["day_of_week"], row["day_name"]) == (7, "Saturday")
    assert row["date"] == datetime.date(2024, 1, 6)


def test_unknown_time_has_no_weekday(spark):
    row = one(clean(events(spark, {"event_type": "view"})))
    for name in ("day_of_week", "day_name", "hour", "date", "year", "month"):
        assert row[name] is None


@pytest.mark.parametrize(
    "code, main, sub",
    [
        ("electronics", "electronics", None),
        ("a.b", "a", "b"),
        ("a.b.c", "a", "b"),
        ("a.", "a", ""),
        (".x", "", "x"),
        (None, None, None),
    ],
)
def test_category(spark, code, main, sub):
    row = one(clean(events(spark, {"category_code": code})))
    assert (row["category_main"], row["category_sub"]) == (main, sub)


def test_text_columns_are_parsed(spark):
    raw = events(spark, {"user_id": 1}, {"user_id": 2}).withColumns(
        {
            "event_time": F.when(F.col("user_id") == 1, "2019-12-01 07:30:00 UTC").otherwise("bad"),
            "price": F.when(F.col("user_id") == 1, "174.76").otherwise("oops"),
        }
    )
    good, bad = clean(raw).orderBy("user_id").collect()
    assert (good["hour"], good["price"], good["price_micros"]) == (7, 174.76, 174_760_000)
    assert (bad["event_time"], bad["hour"], bad["price"]) == (None, None, None)


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Jakarta", "America/New_York"])
@pytest.mark.parametrize(
    "zone, hour, day", [("UTC", 20, 5), ("Asia/Jakarta", 3, 6), ("America/New_York", 15, 5)]
)
def test_calendar_zone_does_not_depend_on_the_session(spark, session_zone, zone, hour, day):
    before = spark.conf.get("spark.sql.session.timeZone")
    raw = events(spark, {"event_time": at(5, 20)})
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        row = one(clean(raw, zone).select("hour", "date"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row["hour"], row["date"]) == (hour, datetime.date(2024, 1, day))


def test_null_audit(spark):
    frame = clean(events(spark, {"brand": "x"}, {"price": "1.00"}, {"event_time": at(1)}))
    others = dict.fromkeys(("event_type", "product_id", "category_id", "user_id"), 3)
    known = {"event_time": 2, "category_code": 3, "brand": 2, "price": 2, "user_session": 3}
    assert one(null_audit(frame)) == {"row_count": 3, "bad_lines": 0} | {
        f"null_{name}": count for name, count in (others | known).items()
    }


def test_keys_may_be_text_and_prices_doubles(spark):
    raw = spark.createDataFrame(
        [("2019-12-01 07:30:00 UTC", "view", "5", "6", "a.b", "x", 49.996, "u77", "s")],
        "event_time string, event_type string, product_id string, category_id string, "
        "category_code string, brand string, price double, user_id string, user_session string",
    )
    row = one(clean(raw))
    assert (row["product_id"], row["user_id"]) == (5, None)
    assert (row["price"], row["price_read"], row["price_micros"]) == (49.996, 49.996, 49_996_000)
    assert one(null_audit(clean(raw)))["null_user_id"] == 1


def test_row_counts(spark):
    frame = events(spark, {"event_type": "view"}, {"event_type": "view"}, {"event_type": None})
    assert {tuple(row) for row in row_counts(frame).collect()} == {("view", 2), (None, 1)}
