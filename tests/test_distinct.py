"""Distinct counts that merge: exact ones from bitmaps, estimated ones from sketches."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from rows import events

from clickloom import brand_category_insight, brand_category_rollup, clean, hourly_activity, price_sensitivity
from clickloom.operators.distinct import (
    count_members,
    count_of,
    member_bitmaps,
    numbered_members,
    sketch_of,
)


def test_numbers_are_dense_and_groups_whole(spark):
    rows = spark.range(5000).selectExpr(
        "if(id % 3 = 0, 7, id % 401) as member", "if(id % 11 = 0, null, id % 13) as g"
    )
    found = numbered_members(rows.repartition(6), "member", ["g"])
    numbers = sorted({row["number"] for row in found.collect()})
    assert numbers == list(range(rows.select("member").distinct().count()))
    assert found.count() == rows.distinct().count()


@pytest.mark.parametrize("members", [1, 300, 70_000])
def test_every_grouping_from_the_same_bitmaps(spark, members):
    """More than two pages of numbers, a third of all rows on one member and one group."""
    rows = spark.range(max(members, 2000)).selectExpr(
        f"if(id % 3 = 0, 0, id % {members}) as member",
        "if(id % 3 = 0, 'hot', string(id % 5)) as a",
        "if(id % 7 = 0, null, id % 4) as b",
    )
    with_null = rows.unionByName(rows.limit(3).withColumn("member", F.lit(None).cast("bigint")))
    bitmaps = member_bitmaps(numbered_members(with_null, "member", ["a", "b"]), ["a", "b"])
    for by in (["a", "b"], ["a"], ["b"], []):
        found = count_members(bitmaps, by, "n").collect()
        expected = rows.groupBy(*by).agg(F.countDistinct("member").alias("n")).collect()
        assert sorted(map(str, found)) == sorted(map(str, expected))


def test_rollup_against_plain_sets(spark):
    listed = [
        {
            "event_type": ("view", "purchase")[i % 2],
            "brand": None if i % 17 == 0 else "hot" if i % 3 == 0 else f"b{i % 4}",
            "category_code": None if i % 19 == 0 else f"c{i % 3}.x",
            "user_id": None if i % 23 == 0 else 1 if i % 3 == 0 else i % 37,
            "price": "1.50",
        }
        for i in range(600)
    ]
    users, counts = defaultdict(set), defaultdict(int)
    for row in listed:
        if row["brand"] and row["category_code"]:
            category = row["category_code"][:2]
            for key in (
                ("brand and category", row["brand"], category),
                ("brand", row["brand"], None),
                ("category", None, category),
                ("all", None, None),
            ):
                users[key] |= {row["user_id"]} - {None}
                counts[key] += row["event_type"] == "view"
    found = brand_category_rollup(clean(events(spark, *listed))).collect()
    assert {(r["level"], r["brand"], r["category_main"]): r["unique_users"] for r in found} == {
        key: len(seen) for key, seen in users.items()
    }
    assert {(r["level"], r["brand"], r["category_main"]): r["total_views"] for r in found} == counts


def test_rollup_of_nothing_and_of_nobody(spark):
    assert brand_category_rollup(clean(events(spark))).collect() == []
    nobody = {"event_type": "view", "brand": "b", "category_code": "c"}
    found = brand_category_rollup(clean(events(spark, nobody))).collect()
    assert {row["level"]: row["unique_users"] for row in found} == dict.fromkeys(
        ("brand and category", "brand", "category", "all"), 0
    )


def test_estimates_are_within_two_percent(spark):
    """A third of all events on one user, product, brand and hour; groups up to 100,000 users."""
    rows = spark.range(600_000).selectExpr(
        "timestamp_seconds(1700000000 + if(id % 3 = 0, 0, id % 6) * 3600) as event_time",
        "'view' as event_type",
        "if(id % 3 = 0, 1, id div 7) as product_id",
        "1L as category_id",
        "if(id % 3 = 0, 'hot.x', concat('c', id % 2, '.x')) as category_code",
        "if(id % 3 = 0, 'hot', concat('b', id % 5)) as brand",
        "cast(if(id % 3 = 0, 10, 1 + id % 1500) as decimal(38,18)) as price",
        "if(id % 3 = 0, 1, id div 4) as user_id",
        "'s' as user_session",
    )
    known = clean(rows)
    for analysis, key, name in (
        (brand_category_insight, ["brand", "category_main"], "unique_users"),
        (price_sensitivity, ["price_bracket"], "distinct_products"),
        (hourly_activity, ["hour"], "unique_users"),
    ):
        exact, about = analysis(known), analysis(known, approximate=True)
        assert exact.dtypes == about.dtypes
        joined = exact.join(about.select(*key, F.col(name).alias("about")), key)
        assert joined.count() == exact.count()
        worst = joined.agg(F.max(F.abs(F.col("about") / F.col(name) - 1))).first()[0]
        assert worst < 0.02, (name, worst)


def test_sketches_merge(spark):
    rows = spark.range(90_000).selectExpr("id div 2 as member", "id % 7 as part")
    parts = rows.groupBy("part").agg(sketch_of("member").alias("sketch"))
    about = parts.agg(count_of(F.hll_union_agg("sketch")).alias("n")).first()["n"]
    assert abs(about / 45_000 - 1) < 0.02
    assert rows.filter("part > 9").agg(count_of(sketch_of("member")).alias("n")).first()["n"] == 0
