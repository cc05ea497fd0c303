"""Runs on new events only, against one run on all events."""

import datetime

import pytest
from pyspark.sql import functions as F
from rows import at, events

from clickloom import ParquetSink, run_increment, run_pipeline
from clickloom.plans import increments
from clickloom.schema import AUDIT, BAD_LINE, EVENT_SCHEMA, FUNNEL, HOURS, REVENUE, RUN_LOG
from clickloom.session import shared_folder
from clickloom.sources.fixture import read_fixture

SF_DIR = "/root/testdata/sf0.001"


def contents(tables):
    return {name: sorted(map(str, frame.collect())) for name, frame in tables.items()}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "events")
    read_fixture(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def expected(spark, source, tmp_path_factory):
    sink = ParquetSink(str(tmp_path_factory.mktemp("expected")))
    return contents(run_pipeline(spark, source, sink))


def day():
    return F.to_date("event_time")


def bounds(source):
    days = [row[0] for row in source.select(day().alias("d")).distinct().orderBy("d").collect()]
    days = [known for known in days if known is not None]
    return days[len(days) // 3], days[2 * len(days) // 3]


def parts(source):
    """Three periods; the last has the events without a time."""
    first, second = bounds(source)
    return [
        source.filter(day() < F.lit(first)),
        source.filter((day() >= F.lit(first)) & (day() < F.lit(second))),
        source.filter((day() >= F.lit(second)) | day().isNull()),
    ]


def test_late_events_come_on_top(spark, tmp_path, source, expected):
    """Three runs and a batch of late events of the first period equal one run on everything."""
    store = ParquetSink(str(tmp_path))
    one, two, three = parts(source)
    late = F.expr("event_id % 5 = 0")
    run_increment(spark, one.filter(~late), store)
    run_increment(spark, two, store)
    run_increment(spark, one.filter(late), store, batch="late")
    found = run_increment(spark, three, store)
    assert contents(found) == expected
    again = run_increment(spark, one.filter(late), store, batch="late")
    assert contents(again) == contents(store.snapshot(spark, list(expected))) == expected


def test_dates_are_replaced(spark, tmp_path, source, expected):
    """A date that is brought again, with its late events, replaces what was there."""
    store = ParquetSink(str(tmp_path))
    one, two, three = parts(source)
    for part in (one.filter("event_id % 5 != 0"), two.limit(7), three, two, one):
        found = run_increment(spark, part, store)
    assert contents(found) == expected
    sink = ParquetSink(str(tmp_path / "copy"))
    run_increment(spark, two, store, sink=sink)
    assert contents(sink.snapshot(spark)) == expected


def test_a_date_without_events_any_more(spark, tmp_path):
    store = ParquetSink(str(tmp_path))
    kept = {"event_time": at(3), "event_type": "purchase", "price": "2", "user_id": 1, "user_session": "a"}
    gone = kept | {"event_time": at(4), "user_id": 2, "user_session": "b", "brand": "x", "category_code": "c"}
    run_increment(spark, events(spark, kept, gone, gone | {"event_time": None}), store)
    found = run_increment(spark, events(spark), store, dates=[datetime.date(2024, 1, 4), None])
    assert [row["date"].day for row in found[REVENUE].collect()] == [3]
    assert found[FUNNEL].first()["total_sessions"] == 1
    assert found[AUDIT].first()["row_count"] == 1
    # A date whose events no longer have a brand keeps no brand of before.
    run_increment(spark, events(spark, gone), store, dates=[datetime.date(2024, 1, 4)])
    plain = gone | {"brand": None}
    found = run_increment(spark, events(spark, plain), store, dates=[datetime.date(2024, 1, 4)])
    assert found["tbl_brand_category_insight"].count() == 0


def test_a_batch_that_has_moved(spark, tmp_path):
    store = ParquetSink(str(tmp_path))
    event = {"event_time": at(3), "event_type": "purchase", "price": "2", "user_id": 1}
    run_increment(spark, events(spark, event), store, batch="b")
    found = run_increment(spark, events(spark, event | {"event_time": at(5)}), store, batch="b")
    assert [row["date"].day for row in found[REVENUE].collect()] == [5]


def test_first_run_without_events(spark, tmp_path):
    found = contents(run_increment(spark, events(spark), ParquetSink(str(tmp_path))))
    assert {name for name, rows in found.items() if rows} == {AUDIT, FUNNEL}


def test_bad_lines_are_kept_per_date(spark, tmp_path):
    store = ParquetSink(str(tmp_path))
    for number in (3, 4):
        lines = events(spark, {"event_time": at(number)}).withColumn(BAD_LINE, F.lit("x"))
        found = run_increment(spark, lines, store)
    assert found[AUDIT].first()["bad_lines"] == 2


def test_failed_run_changes_nothing(spark, tmp_path, source, monkeypatch):
    store = ParquetSink(str(tmp_path))
    one, two, _ = parts(source)
    first = contents(run_increment(spark, one, store))
    before = store.manifests(spark).newest()

    def broken(*_):
        raise ArithmeticError("no hours today")

    monkeypatch.setattr(increments, "hourly_activity", broken)
    with pytest.raises(ArithmeticError):
        run_increment(spark, two, store)
    assert store.manifests(spark).newest() == before
    assert contents(store.snapshot(spark, list(first))) == first


def test_two_runs_at_once(spark, tmp_path, source, monkeypatch):
    """The one that ends last has not seen the other's events and must not win."""
    store = ParquetSink(str(tmp_path))
    one, two, three = parts(source)
    states_of, inner = increments.states_of, []

    def meanwhile(*args):
        if not inner:
            inner.append(True)
            run_increment(spark, two, store)
        return states_of(*args)

    monkeypatch.setattr(increments, "states_of", meanwhile)
    with pytest.raises(RuntimeError, match="meanwhile"):
        run_increment(spark, one, store)
    run_increment(spark, three, store)
    assert store.read(spark, RUN_LOG).select("run_id").distinct().count() == 2


def test_only_new_dates_are_scanned(spark, tmp_path, source, monkeypatch):
    """The range of dates reaches the scan of events; tables come from states."""
    path = str(tmp_path / "events")
    time = F.col("event_time").cast("timestamp")
    source.select(EVENT_SCHEMA.names).withColumn("event_time", time).write.parquet(path)
    store, plans = ParquetSink(str(tmp_path / "tables")), []
    bring, write = increments._bring, increments.ParquetLoad.write

    def noting(load, state, frame, batch):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return bring(load, state, frame, batch)

    def deriving(self, frame, table, mode="overwrite"):
        assert path not in "".join(frame.inputFiles())
        write(self, frame, table, mode)

    monkeypatch.setattr(increments, "_bring", noting)
    monkeypatch.setattr(increments.ParquetLoad, "write", deriving)
    one = bounds(source)[0]
    shown = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    try:
        found = run_increment(spark, spark.read.parquet(path), store, dates=[one])
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", shown)
    assert {row["date"] for row in found[REVENUE].collect()} <= {one}
    assert found[HOURS].agg(F.sum("total_events")).first()[0] == source.filter(day() == F.lit(one)).count()
    assert len(plans) == 5
    for plan in plans:
        assert f"GreaterThanOrEqual(event_time,{one}" in plan and "LessThan(event_time" in plan


def test_nothing_is_left_behind(spark, tmp_path, source):
    def folders():
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {status.getPath().getName() for status in system.listStatus(path)}

    before = folders()
    run_increment(spark, source.limit(20), ParquetSink(str(tmp_path)))
    assert folders() == before


def test_batch_names(spark, tmp_path):
    with pytest.raises(ValueError, match="slash"):
        run_increment(spark, events(spark), ParquetSink(str(tmp_path)), batch="a/b")
