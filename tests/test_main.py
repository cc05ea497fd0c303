import pytest
from pyspark.sql import functions as F

from clickloom.__main__ import _arguments, _sink, main
from clickloom.schema import EVENT_SCHEMA, FUNNEL, REJECTS, REVENUE
from clickloom.sources.fixture import read_fixture

SF_DIR = "/root/testdata/sf0.001"


def test_csv_and_parquet_input_give_the_same_tables(spark, tmp_path, capsys):
    raw = read_fixture(spark, SF_DIR).select(EVENT_SCHEMA.names)
    raw.write.parquet(str(tmp_path / "parquet"))
    written = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'")
    raw.withColumn("event_time", written).write.csv(str(tmp_path / "csv"), header=True)
    # Stored as clock readings; the declared schema has instants.
    spark.read.parquet(str(tmp_path / "parquet")).withColumn(
        "event_time", F.col("event_time").cast("timestamp")
    ).write.parquet(str(tmp_path / "instants"))

    tables = {}
    for kind, folder in (("csv", "csv"), ("parquet", "instants")):
        target = str(tmp_path / f"out-{kind}")
        found = main(
            ["--input", str(tmp_path / folder), "--format", kind, "--output", target, "--preview"]
        )
        tables[kind] = {name: sorted(map(str, frame.collect())) for name, frame in found.items()}
    assert tables["csv"].pop(REJECTS) == []
    assert tables["csv"] == tables["parquet"]
    assert len(tables["csv"][FUNNEL]) == 1
    assert REVENUE in capsys.readouterr().out


def test_database_settings(monkeypatch):
    monkeypatch.setenv("SOME_PASSWORD", "secret")
    args = _arguments(
        ["--input", "x", "--jdbc-url", "jdbc:x", "--jdbc-user", "u"]
        + ["--jdbc-password-from", "SOME_PASSWORD"]
    )
    sink = _sink(args)
    assert sink.url == "jdbc:x"
    assert sink.properties == {"user": "u", "password": "secret"}


def test_a_target_is_needed():
    with pytest.raises(SystemExit):
        _arguments(["--input", "x"])
