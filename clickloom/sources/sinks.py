"""Where result tables go: versioned Parquet tables of a folder, or a database over JDBC."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clickloom.schema import RFM
from clickloom.session import delete_folder
from clickloom.sources.manifests import Manifests


# The tables that are not bounded by hours, days or products, and an integer column of each.
SPLIT_BY = {RFM: "user_id"}

DAY = 24 * 60 * 60


@dataclass(frozen=True)
class ParquetSink:
    """Tables of one folder, replaced together.

    A load writes its tables to files of their own, ``data/<load>/<table>``, and makes them current
    by writing one small manifest at the end. Readers resolve a table's files through the newest
    manifest, so they see all tables of a load or none, and whoever reads an older version
    goes on reading it: its files stay until ``keep`` newer manifests exist.
    """

    folder: str
    keep: int = 2

    def manifests(self, spark: SparkSession) -> Manifests:
        return Manifests(spark, f"{self.folder}/manifests")

    @contextlib.contextmanager
    def load(self, spark: SparkSession) -> Iterator[ParquetLoad]:
        """All writes in this block become current together at its end, or none if it fails."""
        load = ParquetLoad(spark, self, f"{self.folder}/data/{uuid.uuid4().hex}")
        try:
            yield load
            load.commit()
        except BaseException:
            delete_folder(spark, load.folder)
            raise
        self.clean_up(spark)

    def write(self, frame: DataFrame, table: str, mode: str = "overwrite") -> None:
        """A load of one table. ``append`` adds files to it."""
        with self.load(frame.sparkSession) as load:
            load.write(frame, table, mode)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return self.snapshot(spark, [table])[table]

    def snapshot(self, spark: SparkSession, tables: list[str] | None = None) -> dict[str, DataFrame]:
        """Tables (by default all) as of one manifest, so that they belong together."""
        known = self.manifests(spark).newest()[1]
        missing = [table for table in tables or [] if table not in known]
        if missing:
            raise ValueError(f"{self.folder} has no table {', '.join(missing)}")
        names = tables or [table for table in known if "/" not in table]  # states have one
        return {table: resolved(spark, self.folder, known[table]) for table in names}

    def count(self, spark: SparkSession, table: str) -> int:
        return self.read(spark, table).count()

    def clean_up(self, spark: SparkSession, abandoned: int = DAY) -> None:
        """Remove old manifests and files that only they name.

        Files that no manifest names belong to a load that is running, or to one that broke off without
        cleaning up; they go once they are ``abandoned`` seconds old.
        """
        manifests = self.manifests(spark)
        numbers = manifests.numbers()
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        used = {path for n in kept for table in manifests.whole(n).values() for path in table["paths"]}
        once = {path for n in old for table in manifests.whole(n).values() for path in table["paths"]}
        for path in once - used:
            delete_folder(spark, f"{self.folder}/{path}")
        for number in old:
            manifests.forget(number)
        loads = {path.split("/")[1] for path in used}
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.listStatus(place) if system.exists(place) else []:
            name, idle = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
            if name not in loads and (idle > abandoned or not system.listStatus(status.getPath())):
                delete_folder(spark, f"{self.folder}/data/{name}")


def resolved(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    """The table that an entry of a manifest names."""
    schema = T.StructType.fromJson(entry["schema"])
    if not entry["paths"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{path}" for path in entry["paths"]])


class ParquetLoad:
    """The tables of one load; they can be read here before anybody else sees them."""

    def __init__(self, spark: SparkSession, sink: ParquetSink, folder: str):
        self.spark, self.sink, self.folder = spark, sink, folder
        self.written: dict[str, tuple[str, dict]] = {}
        self.checks: list[Callable[[dict], None]] = []

    def place(self, name: str) -> str:
        """Where files of this load are, below the sink's folder."""
        return f"{self.folder.removeprefix(f'{self.sink.folder}/')}/{name}"

    def write(self, frame: DataFrame, table: str, mode: str = "overwrite") -> None:
        place = self.place(table)
        frame.write.parquet(f"{self.sink.folder}/{place}")
        self.put(table, [place], frame.schema, mode)

    def put(self, table: str, paths: list[str], schema: T.StructType, mode: str = "overwrite") -> None:
        """Name files, below the sink's folder, that ``table`` consists of, or gains."""
        self.written[table] = (mode, {"paths": paths, "schema": schema.jsonValue()})

    def drop(self, table: str) -> None:
        self.written[table] = ("drop", {})

    def check(self, still: Callable[[dict], None]) -> None:
        """Have ``still`` look at the current entries when this load is committed, and raise if need be."""
        self.checks.append(still)

    def read(self, table: str) -> DataFrame:
        return resolved(self.spark, self.sink.folder, self.written[table][1])

    def count(self, table: str) -> int:
        return self.read(table).count()

    def commit(self) -> None:
        def change(tables: dict) -> dict:
            for still in self.checks:
                still(tables)
            for table, (mode, entry) in self.written.items():
                if mode == "drop":
                    tables.pop(table, None)
                    continue
                if mode == "append" and table in tables:
                    entry = entry | {"paths": [*tables[table]["paths"], *entry["paths"]]}
                tables[table] = entry
            return tables

        self.sink.manifests(self.spark).replace(change)


@dataclass(frozen=True)
class JdbcSink:
    """Tables of one database. ``properties`` holds user, password and driver.

    ``connections`` bounds the parallel writers, whatever the number of partitions. With
    ``keep_definition`` an overwrite empties the table instead of dropping it, so that its
    grants and indexes stay. A load replaces one table after the other; it is not all or nothing.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    connections: int = 8
    batch_size: int = 10_000
    keep_definition: bool = False

    @contextlib.contextmanager
    def load(self, spark: SparkSession) -> Iterator[JdbcLoad]:
        yield JdbcLoad(spark, self)

    def write(self, frame: DataFrame, table: str, mode: str = "overwrite") -> None:
        (
            frame.write.option("numPartitions", str(self.connections))
            .option("batchsize", str(self.batch_size))
            .option("truncate", str(self.keep_definition).lower())
            .jdbc(self.url, table, mode=mode, properties=self.properties)
        )

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table; one that grows with the customers is read in ranges of ``SPLIT_BY``'s column."""
        column = SPLIT_BY.get(table)
        bounds = column and self._one(spark, f"min({column}), max({column})", table)
        if not bounds or bounds[0] is None:
            return spark.read.jdbc(self.url, table, properties=self.properties)
        return spark.read.jdbc(
            self.url,
            table,
            column=column,
            lowerBound=int(bounds[0]),
            upperBound=int(bounds[1]) + 1,
            numPartitions=self.connections,
            properties=self.properties,
        )

    def count(self, spark: SparkSession, table: str) -> int:
        return int(self._one(spark, "count(*)", table)[0])

    def _one(self, spark: SparkSession, values: str, table: str):
        """A row that the database works out."""
        query = f"(select {values} from {table}) found"
        return spark.read.jdbc(self.url, query, properties=self.properties).first()


class JdbcLoad:
    def __init__(self, spark: SparkSession, sink: JdbcSink):
        self.spark, self.sink = spark, sink

    def write(self, frame: DataFrame, table: str, mode: str = "overwrite") -> None:
        self.sink.write(frame, table, mode)

    def read(self, table: str) -> DataFrame:
        return self.sink.read(self.spark, table)

    def count(self, table: str) -> int:
        return self.sink.count(self.spark, table)


Sink = ParquetSink | JdbcSink
