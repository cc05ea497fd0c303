"""The header of each CSV file of an input, without reading more than its beginning."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

MOST_BYTES = 1 << 16  # of a file's beginning; a header line is expected to fit
AT_ONCE = 32


def _beginning(spark: SparkSession, file: str) -> bytes:
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    conf = spark._jsc.hadoopConfiguration()
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(MOST_BYTES))
    finally:
        stream.close()


def _names(beginning: bytes) -> tuple[str, ...]:
    text = beginning.decode("utf-8-sig", errors="replace")
    return tuple(next(csv.reader(io.StringIO(text, newline="")), ()))


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files below a path by the names in their first line; empty files are left out.

    Each file is opened once, some at a time, for its beginning only. What is kept is a name per file,
    as Spark itself keeps for the files of a scan.
    """
    jvm = spark._jvm
    listed = spark.read.text(path).inputFiles()  # as URIs
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).toString() for file in listed]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        headers = pool.map(lambda file: _names(_beginning(spark, file)), files)
        found: dict[tuple[str, ...], list[str]] = {}
        for header, file in zip(headers, files, strict=True):
            if header:
                found.setdefault(header, []).append(file)
    return found
