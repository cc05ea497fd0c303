import datetime
import gzip
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F
from rows import at, by, events, one

from clickloom import JdbcSink, ParquetSink, clean, null_audit, read_events
from clickloom.schema import BAD_LINE, EVENT_SCHEMA, RFM
from clickloom.session import (
    delete_folder,
    fresh_folder,
    input_size,
    s3a_settings,
    set_folder_if_unset,
    shared_folder,
    shuffle_partitions_for,
    size_shuffles,
)
from clickloom.sources.events import stage_events

HEADER = ",".join(EVENT_SCHEMA.names)


def csv(tmp_path, *lines):
    path = tmp_path / "events.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_csv_has_the_declared_types(spark, tmp_path):
    path = csv(tmp_path, "2019-12-01 00:00:00 UTC,view,1004,20530135,a.b,apple,174.76,551,aa-bb")
    frame = read_events(spark, path)
    assert frame.schema.fields[:-1] == EVENT_SCHEMA.fields
    assert frame.columns[-1] == BAD_LINE
    row = one(clean(frame))
    assert (row["hour"], row["price"], row["brand"]) == (0, 174.76, "apple")
    assert row["date"] == datetime.date(2019, 12, 1)
    assert row[BAD_LINE] is None


def test_bad_csv_values_become_null_and_keep_their_line(spark, tmp_path):
    bad = "bad,cart,1,2,a.b,x,oops,7,s"
    path = csv(tmp_path, bad, "2019-12-01 00:00:00 UTC,view,1,2,a.b,x,1.00,8,s")
    found = by(clean(read_events(spark, path)), "user_id")
    assert (found[7]["event_time"], found[7]["price"], found[7][BAD_LINE]) == (None, None, bad)
    assert found[7]["event_type"] == "cart"
    assert (found[8]["price"], found[8][BAD_LINE]) == (1.0, None)


def test_empty_csv_fields_are_null(spark, tmp_path):
    row = one(read_events(spark, csv(tmp_path, ",view,1,,,,,7,")))
    for name in ("event_time", "category_id", "category_code", "brand", "price", "user_session"):
        assert row[name] is None


def test_csv_keeps_quoted_commas(spark, tmp_path):
    row = one(read_events(spark, csv(tmp_path, ',view,1,2,a,"x, y",1.00,7,s')))
    assert row["brand"] == "x, y"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Swapped columns, and one that is not ours, do not shift values."""
    names = ["_c0", "category_id", "product_id", "brand", "category_code", "event_time"]
    names += ["event_type", "price", "user_session", "user_id"]
    (tmp_path / "e.csv").write_text(
        ",".join(names) + "\n0,22,11,acme,a.b,2019-12-01 00:00:00 UTC,view,49.996,s,7\n"
    )
    frame = read_events(spark, str(tmp_path / "e.csv"))
    assert frame.columns == [*EVENT_SCHEMA.names, BAD_LINE]
    row = one(clean(frame))
    assert (row["product_id"], row["category_id"]) == (11, 22)
    assert (row["brand"], row["category_code"], row["user_id"]) == ("acme", "a.b", 7)
    assert (row["price"], row[BAD_LINE]) == (49.996, None)


def test_files_of_a_folder_may_have_different_headers(spark, tmp_path):
    """Three orders, an added column, one more file of a known header, one compressed, one empty."""
    values = dict(zip(EVENT_SCHEMA.names, "2019-12-01 00:00:00 UTC,view,11,22,a.b,x,1.50,7,s".split(","), strict=True))
    orders = [EVENT_SCHEMA.names, EVENT_SCHEMA.names[::-1], sorted(EVENT_SCHEMA.names)]
    orders += [["more", "", *orders[2]], orders[0]]
    for number, names in enumerate(orders):
        row = values | {"user_id": str(number), "more": "y", "": "z"}
        lines = ",".join(names) + "\r\n" + ",".join(row[name] for name in names) + "\r\n"
        if number == 2:
            (tmp_path / "c.csv.gz").write_bytes(gzip.compress(lines.encode()))
        else:
            (tmp_path / f"file {number}.csv").write_bytes(("\ufeff" if number == 1 else "").encode() + lines.encode())
    (tmp_path / "empty.csv").write_text("")
    frame = read_events(spark, str(tmp_path))
    assert frame.columns == [*EVENT_SCHEMA.names, BAD_LINE]
    rows = sorted(clean(frame).collect(), key=lambda row: row["user_id"])
    assert [row["user_id"] for row in rows] == list(range(5))
    for row in rows:
        assert (row["product_id"], row["category_id"], row["category_code"]) == (11, 22, "a.b")
        assert (row["price"], row["hour"], row[BAD_LINE]) == (1.5, 0, None)


def test_a_file_that_lacks_a_column_is_named(spark, tmp_path):
    csv(tmp_path, "2019-12-01 00:00:00 UTC,view,1,2,a.b,x,1.00,7,s")
    (tmp_path / "short.csv").write_text(HEADER.replace(",brand", "") + "\n")
    with pytest.raises(ValueError, match="short.csv: no single column for each of brand"):
        read_events(spark, str(tmp_path))


def test_no_header_at_all(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_events(spark, str(tmp_path))


def test_missing_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_time,brand\n,x\n")
    with pytest.raises(ValueError, match="user_id"):
        read_events(spark, str(tmp_path / "a.csv"))
    spark.range(1).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="user_id"):
        read_events(spark, str(tmp_path / "p"), "parquet")


def test_bad_lines_are_counted(spark, tmp_path):
    path = csv(
        tmp_path,
        "2019-12-01 00:00:00 UTC,purchase,1,2,a.b,x,1.00,u77,s",
        "2019-12-01 00:00:00 UTC,purchase,1,2,a.b,x,1.00,u78,s",
        "2019-12-01 00:00:00 UTC,purchase,1,2,a.b,x,1.00,78,s",
    )
    found = one(null_audit(clean(read_events(spark, path))))
    assert (found["row_count"], found["bad_lines"], found["null_user_id"]) == (3, 2, 2)


def test_parquet_keeps_the_types_of_its_files(spark, tmp_path):
    path = str(tmp_path / "e")
    frame = events(spark, {"event_time": at(3), "price": "1.25", "user_id": 4, "event_type": "view"})
    frame.selectExpr("'x' as more", "* except (price)", "double(price) as price").write.parquet(path)
    read = read_events(spark, path, "parquet")
    assert read.columns == EVENT_SCHEMA.names
    assert dict(read.dtypes)["price"] == "double"
    assert one(clean(read))["price_micros"] == 1_250_000


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_events(spark, "x", "avro")


def test_parquet_and_staged_events(spark, tmp_path):
    frame = events(spark, {"event_time": at(3), "price": "1.25", "user_id": 4}, {"brand": "b"})
    frame.write.parquet(str(tmp_path / "e"))
    read = read_events(spark, str(tmp_path / "e"), "parquet")
    staged, folder = stage_events(read)
    assert folder.startswith(shared_folder(spark))
    assert sorted(map(str, staged.collect())) == sorted(map(str, frame.collect()))
    assert staged.schema == EVENT_SCHEMA


def test_parquet_sink_replaces(spark, tmp_path):
    sink = ParquetSink(str(tmp_path))
    for rows in (3, 2):
        sink.write(spark.range(rows), "t")
    assert sink.count(spark, "t") == sink.read(spark, "t").count() == 2
    sink.write(spark.range(4), "t", "append")
    assert sink.count(spark, "t") == 6


def test_jdbc_sink_settings():
    """The writer gets its settings; no database is started for this."""
    frame = MagicMock()
    writer = frame.write
    writer.option.return_value = writer
    sink = JdbcSink("jdbc:x", {"user": "u", "password": "p"}, connections=3, keep_definition=True)
    sink.write(frame, "t")
    options = {call.args for call in writer.option.call_args_list}
    assert options == {("numPartitions", "3"), ("batchsize", "10000"), ("truncate", "true")}
    writer.jdbc.assert_called_once_with(
        "jdbc:x", "t", mode="overwrite", properties={"user": "u", "password": "p"}
    )
    assert "password" not in repr(sink)


def test_jdbc_sink_counts_in_the_database():
    spark = MagicMock()
    spark.read.jdbc.return_value.first.return_value = (7,)
    assert JdbcSink("jdbc:x").count(spark, "t") == 7
    assert "select count(*)" in spark.read.jdbc.call_args.args[1]


def test_jdbc_sink_reads_customers_in_ranges():
    spark = MagicMock()
    spark.read.jdbc.return_value.first.return_value = (3, 900)
    JdbcSink("jdbc:x", connections=4).read(spark, RFM)
    settings = spark.read.jdbc.call_args.kwargs
    assert (settings["column"], settings["numPartitions"]) == ("user_id", 4)
    assert (settings["lowerBound"], settings["upperBound"]) == (3, 901)
    JdbcSink("jdbc:x").read(spark, "other")
    assert "column" not in spark.read.jdbc.call_args.kwargs


def test_object_store_settings():
    settings = s3a_settings("https://host", "k", "s")
    assert all(key.startswith("spark.hadoop.fs.s3a.") for key in settings)
    assert settings["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_shuffle_partitions_grow_with_the_input():
    tib = 1024**4
    assert shuffle_partitions_for(1) == 8
    assert shuffle_partitions_for(tib) == 512
    assert shuffle_partitions_for(100 * tib) == 51_200
    assert shuffle_partitions_for(1000 * tib) == 512_000


def test_input_size_is_listed(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text("x" * 1000)
    assert input_size(spark, str(tmp_path)) == 2000
    assert input_size(spark, f"{tmp_path}/a*") == 1000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        size_shuffles(spark, 100 * 1024**3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder_is_the_configured_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_folder(spark)


def test_a_cluster_must_name_its_shared_folder():
    session = MagicMock()
    session.sparkContext.getCheckpointDir.return_value = None
    session.conf.get.return_value = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.sparkContext._jsc.sc().isLocal.return_value = False
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        set_folder_if_unset(session)
    session.sparkContext._jsc.sc().isLocal.return_value = True
    set_folder_if_unset(session)
    session.sparkContext.setCheckpointDir.assert_called_once()


def test_fresh_folder_can_be_deleted(spark):
    folder = fresh_folder(spark, "x")
    spark.range(1).write.parquet(folder)
    delete_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
    assert spark.range(1).select(F.lit(1)).count() == 1
