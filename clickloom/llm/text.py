"""Words, hashes and stored tables that several operators share."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import fresh_folder

# White space that separates words, and the only letters that are lower-cased.
# Python's bytes.split(), bytes.strip() and bytes.lower() go by the same two sets.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is, on the driver and on all workers alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(text: str = "text") -> Column:
    """The text of a row; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` does just that to pure ASCII, and faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; NULL counts as empty."""
    return [value or b"" for value in column.cast("binary").to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``, so that a task holds little at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """Results of a pure function of a word, kept within a task.

    Emptied by ``trim`` once it holds ``most`` words, so that memory stays bounded.
    """

    def __init__(self, of, most: int = 1 << 20):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        value = self[word] = self.of(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def kept_by_worker(name: Hashable, make: Callable[[], object]):
    """Made once per Python worker and used by all tasks of an operator that it runs.

    A worker keeps one such thing: that of another operator goes when a new one is made, so that
    memory does not add up over the stages of a job. Globals of this package would not do: tasks
    bring copies of their own.
    """
    home = sys.modules.setdefault("_clickloom_worker", types.ModuleType("_clickloom_worker"))
    kept = home.__dict__.setdefault("kept", {})
    if name not in kept:
        kept.clear()
        _give_back()
        kept[name] = make()
    return kept[name]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker outlives its stage."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_hashes() -> Memo:
    return kept_by_worker("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, 1 << 19))


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write to the folder that all executors share and read back.

    Cuts the lineage: what reads the table later does not depend on any executor's disk.
    """
    spark = frame.sparkSession
    folder = fresh_folder(spark, purpose)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def shuffle_width(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
