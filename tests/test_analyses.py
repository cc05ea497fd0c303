import datetime

from rows import at, by, events, one

from clickloom import (
    brand_category_insight,
    clean,
    daily_revenue,
    funnel_summary,
    hourly_activity,
    price_sensitivity,
    rfm_base,
    rfm_segment_distribution,
    rfm_segments,
    session_flags,
    top_brands,
    weekday_activity,
)
from clickloom.operators.activity import activity_grid, user_days
from clickloom.operators.funnel import session_profile


def act(kind, session="s", user=1, **more):
    return {"event_type": kind, "user_session": session, "user_id": user, **more}


def bought(user, day, price="10.00"):
    return act("purchase", user=user, event_time=day and at(day), price=price)


# Funnel


def test_funnel_without_carts_does_not_fail(spark):
    row = one(funnel_summary(clean(events(spark, act("view")))))
    assert row["view_to_cart_rate"] == 0.0
    assert row["cart_to_purchase_rate"] is None
    assert row["overall_conversion_rate"] == 0.0


def test_funnel_of_nothing(spark):
    row = one(funnel_summary(clean(events(spark))))
    assert row["total_sessions"] == row["sessions_with_purchase"] == 0
    assert row["overall_conversion_rate"] is None


def test_purchase_without_cart_counts(spark):
    frame = clean(
        events(spark, act("purchase", "a"), act("cart", "b"), act("purchase", "c"), act("x", "d"))
    )
    row = one(funnel_summary(frame))
    assert (row["total_sessions"], row["sessions_with_cart"]) == (4, 1)
    assert row["cart_to_purchase_rate"] == 200.0
    flags = by(session_flags(frame), "user_session")
    assert (flags["a"]["has_purchase"], flags["a"]["has_cart"]) == (1, 0)
    assert [flags["d"][f"has_{kind}"] for kind in ("view", "cart", "purchase")] == [0, 0, 0]


def test_events_without_session_are_left_out(spark):
    frame = clean(events(spark, act("view", None), act("view", "a", 1), act("cart", "a", 2)))
    assert one(funnel_summary(frame))["total_sessions"] == 1
    row = one(session_flags(frame))
    assert (row["distinct_users"], row["total_events"]) == (2, 2)


def test_ready_tables_give_the_same_result(spark):
    frame = clean(
        events(
            spark,
            *[
                act(
                    kind,
                    f"s{i % 5}" if i % 4 else None,
                    None if i % 13 == 0 else i % 3,
                    event_time=None if i % 11 == 0 else at(1 + i % 9, i % 24),
                    price=[None, "0.00", "1.005", "49.996"][i % 4],
                )
                for i, kind in enumerate(["view", "cart", "purchase", "other", "view"] * 12)
            ],
            act("view", "s1"),
        )
    )
    sessions, grid = session_profile(frame), activity_grid(frame)
    assert one(funnel_summary(frame, sessions)) == one(funnel_summary(frame))
    assert by(weekday_activity(frame, grid, sessions), "day_of_week") == by(
        weekday_activity(frame), "day_of_week"
    )
    assert by(hourly_activity(frame, grid), "hour") == by(hourly_activity(frame), "hour")
    days = user_days(frame)
    assert by(hourly_activity(frame, grid, days), "hour") == by(hourly_activity(frame), "hour")
    assert by(daily_revenue(frame, days), "date") == by(daily_revenue(frame), "date")
    assert by(rfm_segments(frame, days=days), "user_id") == by(rfm_segments(frame), "user_id")
    assert by(rfm_base(frame, days=days), "user_id") == by(rfm_base(frame), "user_id")


# Customers


def test_ties_are_settled_by_user(spark):
    found = by(rfm_segments(clean(events(spark, *[bought(u, 1) for u in range(1, 6)]))), "user_id")
    assert [found[u]["f_score"] for u in range(1, 6)] == [1, 2, 3, 4, 5]


def test_unknown_purchase_day_scores_lowest(spark):
    rows = [bought(u, None if u == 3 else u) for u in range(1, 6)]
    found = by(rfm_segments(clean(events(spark, *rows))), "user_id")
    assert (found[3]["recency_days"], found[3]["r_score"]) == (None, 1)
    assert (found[5]["recency_days"], found[5]["r_score"]) == (0, 5)


def test_unknown_prices_score_lowest(spark):
    rows = [bought(u, 1, None if u == 4 else "5.00") for u in range(1, 6)]
    found = by(rfm_segments(clean(events(spark, *rows))), "user_id")
    assert (found[4]["monetary"], found[4]["m_score"]) == (None, 1)


def test_money_is_exact(spark):
    rows = [bought(1, 1, "0.10"), bought(1, 1, "0.20"), bought(1, 1, None)]
    assert one(rfm_base(clean(events(spark, *rows))))["monetary"] == 0.3


def test_reference_date(spark):
    frame = clean(events(spark, bought(1, 30), bought(2, 1), act("view", event_time=at(31))))
    assert by(rfm_base(frame), "user_id")[1]["recency_days"] == 0
    segments = by(rfm_segments(frame), "user_id")
    assert (segments[1]["recency_days"], segments[2]["recency_days"]) == (0, 29)
    before = datetime.date(2024, 1, 10)
    assert by(rfm_base(frame, before), "user_id").keys() == {2}
    assert by(rfm_segments(frame, before), "user_id")[2]["recency_days"] == 9
    later = datetime.date(2024, 2, 9)
    assert by(rfm_base(frame, later), "user_id")[1]["recency_days"] == 10
    assert by(rfm_segments(frame, later), "user_id")[1]["recency_days"] == 10


def test_no_purchases(spark):
    frame = clean(events(spark, act("view")))
    assert rfm_segments(frame).collect() == []
    assert rfm_base(frame).collect() == []


def test_segment_distribution(spark):
    segments = rfm_segments(clean(events(spark, *[bought(u, u) for u in range(1, 11)])))
    counts = {row["segment"]: row["count"] for row in rfm_segment_distribution(segments).collect()}
    assert sum(counts.values()) == 10
    # Frequency ties follow user_id, so all three scores agree here.
    assert counts == {"Champion": 2, "Loyal Customer": 2, "Potential Loyalist": 2, "Lost": 4}


# Brands and prices


def item(kind, price, brand="b", code="c.d", user=1, product=1):
    return act(kind, user=user, price=price, brand=brand, category_code=code, product_id=product)


def test_brand_measures(spark):
    frame = clean(
        events(
            spark,
            item("purchase", "0.10"),
            item("purchase", "0.20", user=2),
            item("cart", None),
            item("view", "9.00", brand=None),
            item("view", "9.00", code=None),
        )
    )
    assert one(brand_category_insight(frame)) == {
        "brand": "b",
        "category_main": "c",
        "total_views": 0,
        "total_carts": 1,
        "total_purchases": 2,
        "total_revenue": 0.3,
        "avg_price": 0.15,
        "unique_users": 2,
        "view_to_purchase_rate": 0.0,
    }


def test_group_without_any_price(spark):
    row = one(brand_category_insight(clean(events(spark, item("view", None)))))
    assert (row["total_revenue"], row["avg_price"]) == (0.0, None)


def test_top_brands(spark):
    rows = [item("purchase", f"{n}.00", brand=f"b{n:02}") for n in range(1, 31)]
    rows += [item("purchase", "30.00", brand="a")]
    top = top_brands(clean(events(spark, *rows)), 3).collect()
    assert [row["brand"] for row in top] == ["a", "b30", "b29"]


def test_price_sensitivity_ignores_free_and_unpriced(spark):
    rows = [item("view", p, product=i) for i, p in enumerate(["0.00", None, "-3.00", "5", "6"])]
    row = one(price_sensitivity(clean(events(spark, *rows))))
    assert (row["total_events"], row["distinct_products"], row["avg_price"]) == (2, 2, 5.5)


def test_prices_are_not_cut(spark):
    rows = [item("purchase", p) for p in ("49.996", "0.004", "199.995")]
    frame = clean(events(spark, *rows))
    assert {r["price_bracket"]: r["total_events"] for r in price_sensitivity(frame).collect()} == {
        "Budget (<$50)": 2,
        "Mid ($50-$200)": 1,
    }
    row = one(daily_revenue(frame))
    assert (row["total_purchases"], row["daily_revenue"]) == (3, 250.0)


# Activity


def test_hours(spark):
    rows = [act("view", user=u, event_time=at(1, h)) for u, h in [(1, 0), (1, 0), (2, 0), (1, 23)]]
    rows += [act("cart", user=None, event_time=at(1, 5)), act("purchase", user=7)]
    found = by(hourly_activity(clean(events(spark, *rows))), "hour")
    assert {h: (r["total_events"], r["unique_users"]) for h, r in found.items()} == {
        0: (3, 2),
        23: (1, 1),
        5: (1, 0),
        None: (1, 1),
    }
    assert (found[5]["carts"], found[None]["purchases"]) == (1, 1)


def test_weekdays(spark):
    rows = [act("view", s, event_time=at(d)) for s, d in [("a", 6), ("a", 7), ("b", 7), (None, 7)]]
    rows += [act("view", "a")]
    found = by(weekday_activity(clean(events(spark, *rows))), "day_name")
    assert {n: (r["total_events"], r["unique_sessions"]) for n, r in found.items()} == {
        "Saturday": (1, 1),
        "Sunday": (3, 2),
        None: (1, 1),
    }


def test_daily_revenue(spark):
    rows = [bought(1, 2, "1.00"), bought(2, 2, "1.01"), bought(1, 2, "0.00"), bought(1, None, "5")]
    found = by(daily_revenue(clean(events(spark, *rows, act("view", price="9.00")))), "date")
    assert set(found) == {datetime.date(2024, 1, 2), None}
    day = found[datetime.date(2024, 1, 2)]
    assert day["daily_revenue"] == 2.01
    assert (day["total_purchases"], day["unique_buyers"]) == (2, 2)
    assert day["avg_order_value"] == 1.01
