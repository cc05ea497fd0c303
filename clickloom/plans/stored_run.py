"""The stored results of one run, from which it can be resumed."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clickloom.session import delete_folder, runs_folder
from clickloom.sources.manifests import Manifests
from clickloom.sources.sinks import resolved


@dataclass(frozen=True)
class StoredRun:
    """Result tables of a run, below the folder that ``spark.checkpoint.dir`` names.

    A table is named in the run's manifest once its files are whole, so a run that breaks off, its driver
    included, leaves what it had. Another application finds it by ``run_id``.
    """

    spark: SparkSession
    run_id: str
    zone: str = "UTC"
    one_writer: threading.Lock = field(default_factory=threading.Lock, compare=False, repr=False)

    @property
    def folder(self) -> str:
        return f"{runs_folder(self.spark)}/{self.run_id}"

    @property
    def _manifests(self) -> Manifests:
        return Manifests(self.spark, f"{self.folder}/manifests")

    def tables(self) -> dict[str, dict]:
        """What is stored; refused if hours and dates are those of another zone."""
        found = self._manifests.newest()[1]
        others = {entry["zone"] for entry in found.values()} - {self.zone}
        if others:
            raise ValueError(f"run {self.run_id} is in zone {others.pop()}, not {self.zone}")
        return found

    def add(self, table: str, place: str, schema: T.StructType, rows: int) -> None:
        entry = {"paths": [place], "schema": schema.jsonValue(), "rows": rows, "zone": self.zone}
        with self.one_writer:
            self._manifests.replace(lambda tables: tables | {table: entry})

    def read(self) -> dict[str, tuple[DataFrame, int]]:
        """Each stored table with the number of its rows."""
        return {
            table: (resolved(self.spark, self.folder, entry), entry["rows"])
            for table, entry in self.tables().items()
        }

    def discard(self) -> None:
        """Give up on resuming."""
        delete_folder(self.spark, self.folder)
