"""Which files each table of a folder consists of, replaced as one small file."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Manifests:
    """Numbered manifests below ``folder``; the highest that is whole counts.

    A manifest is written under another name first and never changes, so readers see all of it or
    none. Where two writers want the same number, the file system gives it to one of them, and the
    other starts again from what that one has written.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str = ""):
        place = f"{self.folder}/{name}" if name else self.folder
        return self.spark._jvm.org.apache.hadoop.fs.Path(place)

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        system, place = self._system(), self._path()
        if not system.exists(place):
            return []
        names = [status.getPath().getName() for status in system.listStatus(place)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def _read(self, number: int) -> dict | None:
        system, place = self._system(), self._path(f"{number:010}.json")
        if not system.exists(place):
            return None  # too old by now
        stream = system.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None  # its writer broke off

    def newest(self) -> tuple[int, dict]:
        """(number, tables) of the current manifest; (0, {}) if there is none."""
        return self._newest(self.numbers())

    def _newest(self, numbers: list[int]) -> tuple[int, dict]:
        for number in reversed(numbers):
            tables = self._read(number)
            if tables is not None:
                return number, tables
        return 0, {}

    def whole(self, number: int) -> dict:
        return self._read(number) or {}

    def replace(self, change: Callable[[dict], dict], attempts: int = 20) -> int:
        """Write the next manifest from what ``change`` makes of the current tables."""
        system = self._system()
        for _ in range(attempts):
            numbers = self.numbers()
            tables = self._newest(numbers)[1]
            number = max(numbers, default=0) + 1
            draft, place = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{number:010}.json")
            stream = system.create(draft, False)
            try:
                stream.write(bytearray(json.dumps(change(dict(tables)), indent=1).encode()))
            finally:
                stream.close()
            if self._given(system, draft, place):
                return number
        raise RuntimeError(f"{self.folder}: other writers were faster {attempts} times")

    def _given(self, system, draft, place) -> bool:
        """Give a draft its name, unless another has it."""
        try:
            if system.getUri().getScheme() != "file":
                return not system.exists(place) and system.rename(draft, place)
            # There a rename would replace a file; a link does not.
            os.link(draft.toUri().getPath(), place.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            if system.exists(draft):
                system.delete(draft, False)

    def forget(self, number: int) -> None:
        self._system().delete(self._path(f"{number:010}.json"), False)
