"""Brand and category performance, price sensitivity."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.clickstream import (
    CART,
    PURCHASE,
    VIEW,
    count_events,
    is_event,
    price_bracket_label,
    price_bracket_number,
)
from clickloom.functions.exact import mean_money, money, percent_or_zero
from clickloom.operators.distinct import count_members, distinct, member_bitmaps, numbered_members
from clickloom.session import fresh_folder


def _catalogued(events: DataFrame) -> DataFrame:
    return events.filter(F.col("brand").isNotNull() & F.col("category_code").isNotNull())


BRAND_SUMS = ("total_views", "total_carts", "total_purchases", "sold_micros", "micros", "priced")


def _brand_sums() -> list[Column]:
    micros = F.col("price_micros")
    return [
        count_events(VIEW).alias("total_views"),
        count_events(CART).alias("total_carts"),
        count_events(PURCHASE).alias("total_purchases"),
        F.sum(F.when(is_event(PURCHASE), micros).otherwise(0)).alias("sold_micros"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("priced"),
    ]


def brand_users(events: DataFrame, *by: str) -> DataFrame:
    """Sums per brand, main category and user, and further columns: rows that add up."""
    return _catalogued(events).groupBy(*by, "brand", "category_main", "user_id").agg(*_brand_sums())


def brand_category_insight(
    events: DataFrame, users: DataFrame | None = None, approximate: bool = False
) -> DataFrame:
    """Events, revenue and users per brand and main category.

    ``avg_price`` is over all events of the group, views included; revenue over purchases only.
    ``users`` takes ready ``brand_users``, any number of rows per brand, category and user. With
    ``approximate`` users are estimated by sketches, which saves the shuffle of users.
    """
    group = ["brand", "category_main"]
    if users is None:
        totals = _catalogued(events).groupBy(*group).agg(
            *_brand_sums(), distinct("user_id", approximate).alias("unique_users")
        )
    else:
        sums = [F.sum(name).alias(name) for name in BRAND_SUMS]
        totals = (
            users.groupBy(*group, "user_id")
            .agg(*sums)
            .groupBy(*group)
            .agg(*sums, F.count("user_id").alias("unique_users"))
        )
    return _brand_results(totals, group)


def _brand_results(totals: DataFrame, group: list[str]) -> DataFrame:
    return totals.select(
        *group,
        "total_views",
        "total_carts",
        "total_purchases",
        money(F.col("sold_micros")).alias("total_revenue"),
        mean_money(F.col("micros"), F.col("priced")).alias("avg_price"),
        "unique_users",
        percent_or_zero(F.col("total_purchases"), F.col("total_views")).alias(
            "view_to_purchase_rate"
        ),
    )


def brand_category_rollup(events: DataFrame, folder: str | None = None) -> DataFrame:
    """``brand_category_insight`` with subtotals per brand, per category and over all.

    ``level`` says which: "brand and category", "brand", "category" or "all"; columns that a level
    does not group by are NULL (a category of its own may be NULL too). Users are exact at every level,
    though they do not add up: all levels unite the same bitmaps (see ``numbered_members``, which
    runs jobs and stores users in ``folder``), so events are shuffled by user once.
    """
    group = ["brand", "category_main"]
    spark, folder = events.sparkSession, folder or fresh_folder(events.sparkSession, "rollup")
    known = _catalogued(events)
    # A row per brand and category, and per page of users: what the levels are made of.
    sums = _kept(spark, known.groupBy(*group).agg(*_brand_sums()), f"{folder}/sums")
    numbered = numbered_members(known, "user_id", group, folder)
    bitmaps = _kept(spark, member_bitmaps(numbered, group), f"{folder}/bitmaps")
    levels = {"brand and category": group, "brand": group[:1], "category": group[1:], "all": []}
    parts = []
    for level, by in levels.items():
        totals = sums.groupBy(*by).agg(*[F.sum(name).alias(name) for name in BRAND_SUMS])
        users = count_members(bitmaps, by, "unique_users")
        if by:
            named = users.withColumnsRenamed({name: f"{name}_of" for name in by})
            same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"{name}_of")) for name in by))
            whole = totals.join(named, same, "left").drop(*[f"{name}_of" for name in by])
        else:
            whole = totals.withColumn("unique_users", users.scalar()).filter("total_views is not null")
        none = {name: F.lit(None).cast("string") for name in group if name not in by}
        whole = whole.withColumns(none | {"unique_users": F.coalesce("unique_users", F.lit(0).cast("bigint"))})
        parts.append(_brand_results(whole.withColumn("level", F.lit(level)), ["level", *group]))
    return reduce(DataFrame.unionByName, parts)


def _kept(spark: SparkSession, frame: DataFrame, folder: str) -> DataFrame:
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def top_brands(events: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` brand and category pairs with the highest revenue."""
    return (
        brand_category_insight(events)
        .orderBy(F.desc_nulls_last("total_revenue"), "brand", "category_main")
        .limit(k)
    )


def price_bracketed(events: DataFrame) -> DataFrame:
    """Catalogued events with a price above zero, and the bracket of each."""
    priced = _catalogued(events).filter(F.col("price_read") > 0)
    return priced.withColumn("bracket", price_bracket_number(F.col("price_read"))).withColumn(
        "price_bracket", price_bracket_label(F.col("bracket"))
    )


PRICE_SUMS = ("total_events", "views", "purchases", "micros")


def _price_sums() -> list[Column]:
    return [
        F.count("*").alias("total_events"),
        count_events(VIEW).alias("views"),
        count_events(PURCHASE).alias("purchases"),
        F.sum("price_micros").alias("micros"),
    ]


def price_products(events: DataFrame, *by: str) -> DataFrame:
    """Sums per bracket's number and product, and further columns: rows that add up."""
    return price_bracketed(events).groupBy(*by, "bracket", "product_id").agg(*_price_sums())


def price_sensitivity(
    events: DataFrame, products: DataFrame | None = None, approximate: bool = False
) -> DataFrame:
    """Events, products and purchase rate per price bracket.

    Groups by the bracket's number: the label is added to the finished rows. ``products`` takes
    ready ``price_products``, any number of rows per bracket and product. With ``approximate`` products
    are estimated by sketches.
    """
    if products is None:
        totals = price_bracketed(events).groupBy("bracket").agg(
            *_price_sums(), distinct("product_id", approximate).alias("distinct_products")
        )
    else:
        sums = [F.sum(name).alias(name) for name in PRICE_SUMS]
        totals = (
            products.groupBy("bracket", "product_id")
            .agg(*sums)
            .groupBy("bracket")
            .agg(*sums, F.count("product_id").alias("distinct_products"))
        )
    return totals.select(
        price_bracket_label(F.col("bracket")).alias("price_bracket"),
        "total_events",
        "views",
        "purchases",
        mean_money(F.col("micros"), F.col("total_events")).alias("avg_price"),
        "distinct_products",
        percent_or_zero(F.col("purchases"), F.col("views")).alias("purchase_rate_pct"),
    )
