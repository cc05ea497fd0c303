import pathlib

import pytest
from pyspark.sql import functions as F
from rows import events

from clickloom import ParquetSink, StoredRun, in_order, preview, read_events, run_pipeline
from clickloom.operators.clean import clean, rejects
from clickloom.operators.rfm import rfm_segment_distribution, rfm_segments
from clickloom.plans import pipeline
from clickloom.schema import (
    AUDIT,
    BAD_LINE,
    BRANDS,
    EVENT_SCHEMA,
    FUNNEL,
    HOURS,
    PRICES,
    REJECTS,
    REVENUE,
    RFM,
    REJECTED,
    RUN_LOG,
    SEGMENTS,
    WEEKDAYS,
    day_column,
)
from clickloom.session import runs_folder, shared_folder
from clickloom.sources.events import stage_events
from clickloom.sources.fixture import read_fixture
from clickloom.sources.sinks import ParquetLoad

SF_DIR = "/root/testdata/sf0.001"
TABLES = {AUDIT, FUNNEL, RFM, SEGMENTS, BRANDS, PRICES, HOURS, WEEKDAYS, REVENUE}


def contents(tables):
    return {name: sorted(map(str, frame.collect())) for name, frame in tables.items()}


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    sink = ParquetSink(str(tmp_path_factory.mktemp("expected")))
    return contents(run_pipeline(spark, read_fixture(spark, SF_DIR), sink))


@pytest.mark.parametrize("stage", pipeline.STAGES)
def test_every_stage_gives_the_same_tables(spark, tmp_path, expected, stage):
    sink = ParquetSink(str(tmp_path))
    found = run_pipeline(spark, read_fixture(spark, SF_DIR), sink, stage=stage, parallel=2)
    assert set(found) == TABLES
    assert contents(found) == expected
    loaded = sink.read(spark, RUN_LOG).filter("status = 'loaded'")
    assert {row["table_name"]: row["row_count"] for row in loaded.collect()} == {
        name: len(rows) for name, rows in expected.items()
    }


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_partitioning_does_not_change_results(spark, tmp_path, expected, partitions):
    source = read_fixture(spark, SF_DIR).repartition(partitions)
    assert contents(run_pipeline(spark, source, ParquetSink(str(tmp_path)))) == expected


def test_second_run_replaces_the_first(spark, tmp_path, expected):
    sink = ParquetSink(str(tmp_path))
    source = read_fixture(spark, SF_DIR)
    run_pipeline(spark, source.limit(10), sink)
    assert contents(run_pipeline(spark, source, sink)) == expected
    assert sink.read(spark, RUN_LOG).select("run_id").distinct().count() == 2


def test_no_events(spark, tmp_path):
    found = contents(run_pipeline(spark, events(spark), ParquetSink(str(tmp_path))))
    assert {name: len(rows) for name, rows in found.items()} == {
        name: int(name in (AUDIT, FUNNEL)) for name in TABLES
    }


def test_results_add_up(spark, tmp_path):
    source = read_fixture(spark, SF_DIR)
    found = run_pipeline(spark, source, ParquetSink(str(tmp_path)))
    for name in (HOURS, WEEKDAYS):
        assert found[name].agg(F.sum("total_events")).first()[0] == source.count()
    buyers = source.filter("event_type = 'purchase'").select("user_id").distinct().count()
    assert found[RFM].count() == buyers
    distribution = rfm_segment_distribution(found[RFM])
    assert distribution.agg(F.sum("count")).first()[0] == buyers
    for score in ("r_score", "f_score", "m_score"):
        sizes = [row["count"] for row in found[RFM].groupBy(score).count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_failure_leaves_the_sink_as_it_was(spark, tmp_path, expected, monkeypatch):
    sink = ParquetSink(str(tmp_path))
    source = read_fixture(spark, SF_DIR)
    first = contents(run_pipeline(spark, source, sink))

    def broken(events):
        raise ArithmeticError("no brands today")

    monkeypatch.setattr(pipeline, "brand_category_insight", broken)
    with pytest.raises(ArithmeticError, match="no brands today"):
        run_pipeline(spark, source.limit(5), sink)
    assert contents({name: sink.read(spark, name) for name in TABLES}) == first == expected
    (failed,) = sink.read(spark, RUN_LOG).filter("status = 'failed'").collect()
    assert failed["table_name"] == BRANDS
    assert "no brands today" in failed["error_message"]


def test_failing_source_is_what_gets_raised(spark, tmp_path):
    broken = read_fixture(spark, SF_DIR).withColumn(
        "event_type", F.raise_error(F.lit("unreadable")).cast("string")
    )
    for stage in pipeline.STAGES:
        with pytest.raises(Exception, match="unreadable"):
            run_pipeline(spark, broken, ParquetSink(str(tmp_path)), stage=stage)
    assert ParquetSink(str(tmp_path)).read(spark, RUN_LOG).filter("status='failed'").count() == len(pipeline.STAGES)


def test_lost_rows_are_noticed(spark, tmp_path, monkeypatch):
    write = ParquetLoad.write

    def lossy(self, frame, table, mode="overwrite"):
        write(self, frame.limit(1) if table == HOURS else frame, table, mode)

    monkeypatch.setattr(ParquetLoad, "write", lossy)
    with pytest.raises(RuntimeError, match="rows computed, 1 loaded"):
        run_pipeline(spark, read_fixture(spark, SF_DIR), ParquetSink(str(tmp_path)))


@pytest.mark.parametrize("broken", [BRANDS, RUN_LOG])
def test_failing_load_leaves_all_old_tables(spark, tmp_path, expected, monkeypatch, broken):
    """Whichever table fails while loading, old tables and old log stay, and no new file does."""
    sink, source = ParquetSink(str(tmp_path)), read_fixture(spark, SF_DIR)
    run_pipeline(spark, source, sink)
    held = {name: frame for name, frame in sink.snapshot(spark).items() if name != RUN_LOG}
    write = ParquetLoad.write

    def failing(self, frame, table, mode="overwrite"):
        if table == broken and "failed" not in str(frame.collect()):
            raise OSError("the disk is full")
        write(self, frame, table, mode)

    before = {path.name for path in (tmp_path / "data").iterdir()}
    monkeypatch.setattr(ParquetLoad, "write", failing)
    with pytest.raises(OSError, match="the disk is full"):
        run_pipeline(spark, source.limit(10), sink, parallel=1)
    found = sink.snapshot(spark)
    assert contents({name: found[name] for name in TABLES}) == contents(held) == expected
    log = found[RUN_LOG].groupBy("status").count().collect()
    assert {row["status"]: row["count"] for row in log} == {"loaded": len(TABLES), "failed": 1}
    assert len({path.name for path in (tmp_path / "data").iterdir()} - before) == 1  # the log's


def test_readers_of_the_version_before_go_on(spark, tmp_path, expected):
    sink, source = ParquetSink(str(tmp_path)), read_fixture(spark, SF_DIR)
    first = run_pipeline(spark, source, sink)
    run_pipeline(spark, source.limit(10), sink)
    assert contents(first) == expected
    run_pipeline(spark, source.limit(10), sink)  # now the first is too old
    assert contents(sink.snapshot(spark, [HOURS])) != {HOURS: expected[HOURS]}
    with pytest.raises(Exception, match="(?i)not.*(found|exist)"):
        first[HOURS].collect()
    assert len(list((tmp_path / "manifests").glob("*.json"))) == 2


def test_nothing_is_left_behind(spark, tmp_path):
    def folders():
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {status.getPath().getName() for status in system.listStatus(path)}

    before = folders()
    for stage in pipeline.STAGES:
        run_pipeline(spark, read_fixture(spark, SF_DIR), ParquetSink(str(tmp_path)), stage=stage)
    assert folders() == before


def test_csv_is_staged_unless_told_otherwise(spark, tmp_path, monkeypatch):
    staged = []
    stage_events = pipeline.stage_events
    monkeypatch.setattr(pipeline, "stage_events", lambda *of: staged.append(1) or stage_events(*of))
    source = events(spark, {"event_type": "view"})
    run_pipeline(spark, source, ParquetSink(str(tmp_path)))
    assert not staged
    lines = source.withColumn(BAD_LINE, F.lit(None).cast("string"))
    run_pipeline(spark, lines, ParquetSink(str(tmp_path)))
    assert staged
    run_pipeline(spark, lines, ParquetSink(str(tmp_path)), stage="none")
    assert len(staged) == 1


def test_events_are_scanned_five_times(spark, tmp_path, monkeypatch):
    path, scans = str(tmp_path / "events"), []
    read_fixture(spark, SF_DIR).write.parquet(path)
    store = pipeline._store

    def scanned(plan):
        """Scans of the events, by their root path: the plan's text cuts long ones."""
        roots = plan.relation().location().rootPaths().mkString() if plan.nodeName().startswith("Scan") else ""
        children = plan.children()
        return roots.endswith(path) + sum(scanned(children.apply(i)) for i in range(children.size()))

    def counting(spark, frame, folder):
        scans.append(scanned(frame._jdf.queryExecution().sparkPlan()))
        return store(spark, frame, folder)

    monkeypatch.setattr(pipeline, "_store", counting)
    run_pipeline(spark, spark.read.parquet(path), ParquetSink(str(tmp_path / "out")))
    assert sum(scans) == 5


def unreadable(source):
    """The same events, which must not be read."""
    return source.withColumn("user_id", F.raise_error(F.lit("read again")).cast("bigint"))


@pytest.fixture
def stored_runs(spark):
    """Ids of the runs whose results are stored."""
    def ids():
        path = spark._jvm.org.apache.hadoop.fs.Path(runs_folder(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = system.listStatus(path) if system.exists(path) else []
        return {status.getPath().getName() for status in found}

    return ids


def failing_once(monkeypatch, broken):
    write = ParquetLoad.write

    def failing(self, frame, table, mode="overwrite"):
        if table == broken:
            monkeypatch.setattr(ParquetLoad, "write", write)
            raise OSError("the disk is full")
        write(self, frame, table, mode)

    monkeypatch.setattr(ParquetLoad, "write", failing)


@pytest.mark.parametrize("stage", pipeline.STAGES)
def test_a_failed_load_is_resumed_without_events(
    spark, tmp_path, expected, monkeypatch, stored_runs, stage
):
    sink, source, before = ParquetSink(str(tmp_path)), read_fixture(spark, SF_DIR), stored_runs()
    failing_once(monkeypatch, HOURS)
    with pytest.raises(OSError, match="the disk is full") as failed:
        run_pipeline(spark, source, sink, stage=stage, parallel=1)
    (run_id,) = stored_runs() - before
    assert f"run {run_id} can be resumed, {len(TABLES)} tables are stored" in failed.value.__notes__
    assert contents(run_pipeline(spark, unreadable(source), sink, stage, resume=run_id)) == expected
    log = sink.read(spark, RUN_LOG)
    assert {row["run_id"] for row in log.collect()} == {run_id}
    by_status = {row["status"]: row["count"] for row in log.groupBy("status").count().collect()}
    assert by_status == {"failed": 1, "loaded": len(TABLES)}
    assert stored_runs() == before


def test_only_what_is_missing_is_computed_again(spark, tmp_path, expected, monkeypatch, stored_runs):
    sink, source, before = ParquetSink(str(tmp_path)), read_fixture(spark, SF_DIR), stored_runs()
    with monkeypatch.context() as broken:
        broken.setattr(pipeline, "audit_of", lambda grid: 1 / 0)  # the last one
        with pytest.raises(ZeroDivisionError):
            run_pipeline(spark, source, sink, parallel=1)
    (run_id,) = stored_runs() - before
    held = set(StoredRun(spark, run_id).tables())
    assert held and AUDIT not in held
    computed, store = [], pipeline._store

    def storing(spark, frame, folder):
        computed.append(folder.rsplit("/", 1)[1])
        return store(spark, frame, folder)

    monkeypatch.setattr(pipeline, "_store", storing)
    assert contents(run_pipeline(spark, source, sink, resume=run_id)) == expected
    assert {name for name in computed if name in TABLES} == TABLES - held
    assert stored_runs() == before


def test_runs_that_cannot_be_resumed(spark, tmp_path, monkeypatch, stored_runs):
    sink, source, before = ParquetSink(str(tmp_path)), read_fixture(spark, SF_DIR), stored_runs()
    with pytest.raises(ValueError, match="no stored results"):
        run_pipeline(spark, source, sink, resume="nobody")
    with pytest.raises(Exception, match="read again"):
        run_pipeline(spark, unreadable(source), sink, stage="table")
    assert stored_runs() == before  # nothing was stored
    failing_once(monkeypatch, RUN_LOG)
    with pytest.raises(OSError):
        run_pipeline(spark, source, sink)
    (run_id,) = stored_runs() - before
    with pytest.raises(ValueError, match="in zone UTC"):
        run_pipeline(spark, source, sink, zone="Europe/Berlin", resume=run_id)
    StoredRun(spark, run_id).discard()
    assert stored_runs() == before


@pytest.mark.parametrize("stage", pipeline.STAGES)
def test_rejects_are_what_the_audit_counts(spark, tmp_path, stage):
    """Two headers; times, prices and keys that are none; too many and too few fields."""
    names = EVENT_SCHEMA.names
    good = ["2024-01-15 10:00:00 UTC", "view", "1", "2", "a.b", "x", "1.5", "7", "s"]

    def line(**bad):
        return ",".join(bad.get(name, value) for name, value in zip(names, good, strict=True))

    lines = [line(), line(price="oops", user_id="u7"), line(event_time="soon", brand=""),
             line() + ",more", line(product_id="", category_id="c")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(names), *lines]))
    turned = [",".join(reversed(text.split(","))) for text in (line(), line(price="1,5".replace(",", ";")))]
    (tmp_path / "in" / "b.csv").write_text("\n".join([",".join(reversed(names)), *turned, "s,7"]))
    source = read_events(spark, str(tmp_path / "in"), rejects=True)
    found = run_pipeline(spark, source, ParquetSink(str(tmp_path / "out")), stage=stage)
    rows = {(row["file"].rsplit("/", 1)[1], row["line"]): row["failed_columns"] for row in found[REJECTS].collect()}
    assert rows == {
        ("a.csv", lines[1]): "price,user_id", ("a.csv", lines[2]): "event_time", ("a.csv", lines[3]): "",
        ("a.csv", lines[4]): "category_id", ("b.csv", turned[1]): "price", ("b.csv", "s,7"): "",
    }
    audit = found[AUDIT].first()
    assert (audit["row_count"], audit["bad_lines"]) == (8, len(rows))


def test_rejects_of_staged_events_are_files_of_their_own(spark, tmp_path):
    """The table of bad lines opens no file of good ones."""
    path = tmp_path / "in.csv"
    path.write_text(",".join(EVENT_SCHEMA.names) + "\n" + ",,1,2,,,1,7,s\n" * 50 + ",,1,2,,,x,7,s\n")
    staged, folder = stage_events(read_events(spark, str(path), rejects=True))
    assert staged.count() == 51
    for file in pathlib.Path(folder.removeprefix("file:")).glob(f"{REJECTED}=false/*"):
        file.write_bytes(b"not Parquet")
    assert [row["failed_columns"] for row in rejects(staged).collect()] == ["price"]


def test_dates_are_files_of_their_own(spark):
    """One day's events, and those up to a day, are read when all other days' files are broken."""
    given = read_fixture(spark, SF_DIR)
    whole = clean(given)
    staged, folder = stage_events(given, "UTC")
    day = whole.agg(F.percentile_approx("date", 0.5)).first()[0]
    first, last = f"{day_column('UTC')}=", str(day)
    for file in pathlib.Path(folder.removeprefix("file:")).glob(f"{first}*/*"):
        value = file.parent.name.removeprefix(first)
        if value != "__HIVE_DEFAULT_PARTITION__" and value > last:
            file.write_bytes(b"not Parquet")
    for chosen in (F.col("date") == F.lit(day), F.col("date") <= F.lit(day), F.col("date").isNull()):
        found = clean(staged).filter(chosen).select(*whole.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.filter(chosen).collect()))
    assert rfm_segments(clean(staged), day).count() == rfm_segments(whole, day).count() > 0
    with pytest.raises(Exception, match="(?i)parquet"):
        clean(staged).filter(F.col("price") > 0).select(F.sum("price")).collect()
    with pytest.raises(Exception, match="(?i)parquet"):  # another zone's dates are not what it is laid by
        clean(staged, "Asia/Tokyo").filter(F.col("date") == F.lit(day)).select(F.sum("price")).collect()


def test_unknown_stage(spark, tmp_path):
    with pytest.raises(ValueError):
        run_pipeline(spark, events(spark), ParquetSink(str(tmp_path)), stage="disk")


def test_reading_order_and_preview(spark, tmp_path, capsys):
    found = run_pipeline(spark, read_fixture(spark, SF_DIR), ParquetSink(str(tmp_path)))
    revenue = [row["total_revenue"] for row in in_order(BRANDS, found[BRANDS]).collect()]
    assert revenue == sorted(revenue, reverse=True)
    days = [row["day_of_week"] for row in in_order(WEEKDAYS, found[WEEKDAYS]).collect()]
    assert days == [None, *range(1, 8)]
    sizes = [row["count"] for row in in_order(SEGMENTS, found[SEGMENTS]).collect()]
    assert sizes == sorted(sizes, reverse=True)
    preview(found, 24)
    printed = capsys.readouterr().out
    assert all(name in printed for name in TABLES)
