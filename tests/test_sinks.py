"""Versions of a folder's tables: one manifest names what is current."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from clickloom import ParquetSink


def numbers(frame):
    return sorted(row["id"] for row in frame.collect())


def data(tmp_path):
    return sorted(str(path.relative_to(tmp_path)) for path in tmp_path.glob("data/*/*"))


def test_tables_of_a_load_change_together(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    with sink.load(spark) as load:
        load.write(spark.range(2), "a")
        load.write(spark.range(3), "b")
        assert load.count("a") == 2
        with pytest.raises(ValueError, match="no table a"):
            sink.read(spark, "a")
    with pytest.raises(ArithmeticError), sink.load(spark) as load:
        load.write(spark.range(5), "a")
        raise ArithmeticError
    assert {name: frame.count() for name, frame in sink.snapshot(spark).items()} == {"a": 2, "b": 3}
    assert len(data(tmp_path)) == 2


def test_append_adds_files_and_keeps_the_others(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    for start in range(4):
        sink.write(spark.range(start, start + 1), "log", "append")
    assert numbers(sink.read(spark, "log")) == [0, 1, 2, 3]
    assert len(data(tmp_path)) == 4


def test_old_versions_go_when_nobody_can_resolve_them(spark, tmp_path):
    sink = ParquetSink(str(tmp_path), keep=2)
    for rows in range(1, 5):
        sink.write(spark.range(rows), "t")
    assert sink.read(spark, "t").count() == 4
    assert len(data(tmp_path)) == len(list(tmp_path.glob("manifests/*.json"))) == 2
    assert len(list(tmp_path.glob("data/*"))) == 2


def test_files_of_running_loads_stay_and_abandoned_ones_go(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    with sink.load(spark) as load:
        load.write(spark.range(2), "slow")
        sink.write(spark.range(1), "quick")
    assert sink.snapshot(spark)["slow"].count() == 2
    left = tmp_path / "data" / "broken-off"
    left.mkdir()
    (left / "part").write_text("x")
    sink.clean_up(spark)
    assert left.exists()
    os.utime(left, (time.time() - 10**6,) * 2)
    sink.clean_up(spark)
    assert not left.exists()


def test_a_manifest_that_is_not_whole_does_not_count(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    sink.write(spark.range(2), "t")
    (tmp_path / "manifests" / "0000000002.json").write_text('{"t": {"paths"')
    assert sink.read(spark, "t").count() == 2
    sink.write(spark.range(3), "u")
    assert {name: frame.count() for name, frame in sink.snapshot(spark).items()} == {"t": 2, "u": 3}


def test_writers_at_the_same_time_do_not_lose_each_other(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: sink.write(spark.range(i), f"t{i}"), range(1, 9)))
    assert {name: frame.count() for name, frame in sink.snapshot(spark).items()} == {
        f"t{i}": i for i in range(1, 9)
    }


def test_empty_folder(spark, tmp_path):
    assert ParquetSink(str(tmp_path)).snapshot(spark) == {}
    ParquetSink(str(tmp_path)).clean_up(spark)
