import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom import rank_tiles
from clickloom.operators.tiles import tile_starts


def plain(rows, measures, tiles):
    """The same scores from one window per measure, which sorts all rows in one task."""
    for name in measures:
        order = Window.orderBy(F.asc_nulls_first(name), F.asc_nulls_first("id"))
        rows = rows.withColumn(f"{name}_tile", F.ntile(tiles).over(order))
    return rows


def check(rows, measures, tiles=5):
    names = ["id", *measures, *[f"{name}_tile" for name in measures]]
    found = rank_tiles(rows, "id", measures, tiles).select(names)
    expected = plain(rows, measures, tiles).select(names)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_tile_sizes(spark):
    for rows, sizes in [(0, {}), (1, {1: 1}), (3, {1: 1, 2: 1, 3: 1}), (7, {1: 2, 2: 2, 3: 1, 4: 1, 5: 1})]:
        frame = spark.range(rows).withColumn("m", F.col("id") * 3)
        found = rank_tiles(frame, "id", ["m"]).groupBy("m_tile").count().collect()
        assert dict(tuple(row) for row in found) == sizes


@pytest.mark.parametrize("rows", [1, 4, 150, 5000])
@pytest.mark.parametrize("tiles", [1, 5, 7])
def test_same_as_plain_ntile(spark, rows, tiles):
    frame = spark.range(rows).selectExpr(
        "id",
        "if(hash(id) % 11 = 0, null, hash(id, 1) % 40) as few",
        "hash(id, 2) as many",
    )
    check(frame.repartition(7), ["few", "many"], tiles)


def test_one_value_for_all(spark):
    """However many rows tie, the search goes on among their keys."""
    frame = spark.range(20_000).selectExpr("id", "1L as m", "if(id % 3 = 0, 5, id) as third")
    check(frame, ["m", "third"])


def test_null_key_is_a_row_like_others(spark):
    frame = spark.createDataFrame([(None, 1), (1, 1), (2, None), (3, 0)], "id bigint, m bigint")
    check(frame, ["m"], 4)


def test_extreme_values_and_keys(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1]
    rows = [(key, value) for key, value in zip(ends, reversed(ends), strict=True)]
    frame = spark.createDataFrame([*rows, (5, None), (6, None), (None, 7)], "id bigint, m bigint")
    for tiles in (2, 5, 10):
        check(frame, ["m"], tiles)


def test_all_values_null(spark):
    check(spark.range(40).selectExpr("id", "cast(null as bigint) as m"), ["m"])


def test_ties_are_split_at_the_same_place_by_few_buckets(spark):
    """A third of all rows on one value; two buckets a pass need many passes and find the same."""
    frame = spark.range(3000).selectExpr("id * 7 as id", "if(id % 3 = 0, 5, hash(id)) as m").cache()
    found = tile_starts(frame, "id", ["m"], 7, buckets=2)
    assert found == tile_starts(frame, "id", ["m"], 7)
    assert sorted(found["m"]) == list(range(7))


def test_nothing_is_sorted(spark):
    frame = spark.range(100).selectExpr("id", "id % 7 as m")
    plan = rank_tiles(frame, "id", ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan


def test_keys_are_integers(spark):
    with pytest.raises(ValueError, match="no integer"):
        rank_tiles(spark.range(3).selectExpr("string(id) as id", "1 as m"), "id", ["m"])
