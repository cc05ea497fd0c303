"""The test tables ``events`` and ``part`` in the layout of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import input_size

# Declared, so that reading needs no look into the files first.
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"

# Size of the part files up to which parts may be broadcast. Spark goes by the files as well, where rows
# take some 20 times less than in memory, and would send hundreds of MB through the driver.
MOST_BROADCAST = 1 << 20


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts.

    The grouping tells Spark that keys are unique, so that it drops the join from queries that
    use no product column. Many parts are joined by a merge, so that the driver never gets them.
    """
    path = f"{sf_dir}/part.parquet"
    part = spark.read.schema(PART).parquet(path)
    named = part.selectExpr(
        "p_partkey as product_id",
        "cast(p_size as bigint) as category_id",
        "p_brand",
        "lower(p_type) as kind",
        "get(split(p_name, ' '), 1) as word",
    )
    unique = named.dropDuplicates(["product_id"])
    return unique.hint("merge") if input_size(spark, path) > MOST_BROADCAST else unique


# Fixed value: how the test events' prices are made.
PRICE = "cast(value as decimal(12,2)) * 3"
# The same with more places than cents, and around the bounds of brackets.
FINE_PRICE = """case when event_id % 89 = 0 then 49.996 when event_id % 83 = 0 then 0.004
  when event_id % 79 = 0 then 199.995 else cast(value as decimal(12,2)) * 2.9987 end"""


def read_fixture(spark: SparkSession, sf_dir: str, price: str = PRICE) -> DataFrame:
    """Raw events of the test data, with planted NULLs, zero prices and short category codes.

    Event types are not stored as they come out, so filters on them are not pushed down to the
    scan; see ``read_events`` for tables where they are. A product that is no part has no
    category and no brand.
    """
    events = (
        spark.read.schema(EVENTS)
        .parquet(f"{sf_dir}/events.parquet")
        .withColumn("k", F.expr(r"""try_cast(regexp_extract(props, r'"k":\s*(\d+)', 1) as bigint)"""))
        .selectExpr(
            "event_id",
            "if(event_id % 211 = 0, null, ts) as event_time",
            "if(event_type = 'click', 'cart', event_type) as event_type",
            "k as product_id",
            f"""case when event_id % 97 = 0 then null
                     when event_id % 50 = 0 then 0
                     else {price} end as price""",
            "user_id",
            """if(event_id % 101 = 0, null,
                  concat(user_id, '-', date_format(ts, 'yyyyMMdd'))) as user_session""",
        )
    )
    return events.join(_catalogue(spark, sf_dir), "product_id", "left").selectExpr(
        "event_id",
        "event_time",
        "event_type",
        "product_id",
        "category_id",
        """case when product_id % 7 = 0 then null
                when product_id % 5 = 0 then kind
                else concat(kind, '.', word) end as category_code""",
        "if(product_id % 10 = 3, null, p_brand) as brand",
        "price",
        "user_id",
        "user_session",
    )
