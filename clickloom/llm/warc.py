"""Web archives (WARC): written by many tasks (1.1), read by byte ranges, own ones and others'.

Archives are gzip files with one member per record, as crawlers write them. Readers are given byte ranges. A reader
scans its range for the gzip magic, takes a match for a record only if what it decodes to
starts like one, and owns the records that start inside the range, reading past its end to
finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.text import as_bytes, shuffle_width, stored

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWLED = "1970-01-01T00:00:00Z"  # pages carry no date

GZIP = 31  # zlib's window size for gzip members
BLOCK = 1 << 20

MANIFEST = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])
_MANIFEST_DDL = "path string, n_bytes bigint, n_records bigint"
RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("at", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
_RECORDS_DDL = (
    "path string, at bigint, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_bytes bigint, payload_digest string, payload binary"
)


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, as written by Hadoop, and the path there."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, original) -> bytes:
    """One record: a response, or a revisit of the page ``original``, without the payload."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if original is None else http
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", CRAWLED),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if original is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{original}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(content) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; returns their manifest.

    The payload is the html in UTF-8, NULL counting as empty. Of pages with equal payloads that with
    the smallest page_id becomes a response, the others revisits of it. Pages with a NULL page_id
    and rows that repeat the response's page_id become responses too. Other columns are not read.
    Only page_id and a hash of the payload are shuffled to find equal payloads, aggregated first, so
    a payload that very many pages share is one row per task.

    Each task writes a file under a name of its own attempt; the manifest (path, n_bytes,
    n_records), stored in the shared folder, lists the files of the attempts that count.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "_same", F.sha2("payload", 256)
    )
    narrow = keyed.select("page_id", "_same")
    firsts = narrow.groupBy("_same").agg(
        F.min("page_id").alias("original"), F.count("*").alias("pages")
    )
    revisits = (
        narrow.join(firsts.filter("pages > 1"), "_same")
        .filter(F.col("page_id") != F.col("original"))
        .select("page_id", "_same", "original")
        .distinct()
    )
    rows = keyed.join(revisits, ["page_id", "_same"], "left").drop("_same")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        written = count = 0
        with system.open_output_stream(f"{place}/{name}", compression=None) as out:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "original")]
                for page_id, url, original, content in zip(
                    *columns, as_bytes(batch.column("payload")), strict=True
                ):
                    written += out.write(member(record(page_id, url, content, original)))
                    count += 1
        if count:
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{name}", "n_bytes": written, "n_records": count}], MANIFEST
            )
        else:
            system.delete_file(f"{place}/{name}")

    return stored(rows.mapInArrow(write, _MANIFEST_DDL), "warc-manifest")


class RangeReader:
    """The records that start in one byte range of a file."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.start, self.end = file, start, end
        # Two bytes more, for a magic that starts inside and ends outside.
        self.data = file.read_at(end - start + len(MAGIC) - 1, start)

    def _read(self, at: int, most: int = BLOCK) -> bytes:
        inside = self.data[at - self.start : at - self.start + most]
        return inside or self.file.read_at(most, at)

    def _starts_record(self, at: int) -> bool:
        """Whether what is compressed at ``at`` starts like a record."""
        unpacker, head = zlib.decompressobj(GZIP), b""
        try:
            while len(head) < len(VERSION) and not unpacker.eof:
                packed = self._read(at, 256)
                if not packed:
                    return False
                head += unpacker.decompress(packed)
                at += len(packed)
        except zlib.error:
            return False
        return head.startswith(b"WARC/")

    def _member(self, at: int) -> tuple[bytes, int]:
        """The content of the member at ``at`` and where it ends."""
        unpacker, parts = zlib.decompressobj(GZIP), []
        while not unpacker.eof:
            packed = self._read(at)
            if not packed:
                raise ValueError(f"the record that ends at byte {at} is cut off")
            parts.append(unpacker.decompress(packed))
            at += len(packed) - len(unpacker.unused_data)
        return b"".join(parts), at

    def records(self) -> Iterator[tuple[int, bytes]]:
        at = self.data.find(MAGIC)
        while 0 <= at < self.end - self.start:
            place = self.start + at
            if self._starts_record(place):
                content, ended = self._member(place)
                yield place, content
                at = self.data.find(MAGIC, ended - self.start)
            else:
                at = self.data.find(MAGIC, at + 1)


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of a name counts, folded lines are joined."""
    found: dict[str, str] = {}
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode(errors="replace").splitlines()
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]+", text) else None


def _same_digest(said: str, payload: bytes) -> bool:
    """Digests are base32, by some writers hexadecimal."""
    return said.upper() == digest(payload) or said.lower() == hashlib.sha1(payload).hexdigest()


def parse(content: bytes) -> dict:
    """Headers and payload of one record of any type.

    The payload is what follows the HTTP headers where the block has such, else the block; a
    revisit has none, and its length is that in the HTTP headers, NULL without. Absent fields are
    NULL. ``payload_digest`` is the payload's SHA-1 in base32, for a revisit what the record says,
    with the name of the algorithm if it is another. A SHA-1 that the record gives is checked unless
    the record is truncated or its payload is transfer-encoded, of which writers take the digest
    before or after decoding; so is the length of the block.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = fields(head)
    name, kind = headers.get("warc-record-id"), headers.get("warc-type", "").lower() or None
    length = _number(headers.get("content-length"))
    block = rest[:length]
    if length is not None and len(block) < length:
        raise ValueError(f"{name}: the block is cut off")
    if length is not None and rest[length:].lstrip(b"\r\n").startswith(b"WARC/"):
        raise ValueError(f"{name}: another record follows in the same gzip member")
    http, payload = {}, block
    if headers.get("content-type", "").lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = fields(top)
    label, colon, said = headers.get("warc-payload-digest", "").partition(":")
    is_sha1 = bool(colon) and label.lower() == "sha1"
    row = {
        "record_type": kind,
        "record_id": name,
        "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
    }
    if kind == "revisit":
        stated = said if is_sha1 else headers.get("warc-payload-digest")
        size = _number(http.get("content-length"))
        return row | {"payload_bytes": size, "payload_digest": stated, "payload": None}
    as_written = "warc-truncated" not in headers and "transfer-encoding" not in http
    if is_sha1 and as_written and not _same_digest(said, payload):
        raise ValueError(f"{name}: the payload is not what was written")
    return row | {
        "payload_bytes": len(payload),
        "payload_digest": digest(payload),
        "payload": payload,
    }


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The manifest (path, n_bytes) of archives that others have written: a folder, file or pattern.

    Only the file listing is read.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes")).filter("n_bytes > 0")


def read_archives(
    manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True
) -> DataFrame:
    """The records of all archives in ``manifest`` (path, n_bytes), one row each, of every type.

    ``manifest`` comes from ``write_archives`` or ``archives``; ``parse`` says what is read of a
    record. Archives that are not compressed, or as one member, are not read: the first give no
    record, the second an error.

    Files are cut into ranges of ``split_bytes``, which are dealt out over tasks; a record belongs
    to the range that it starts in. A task holds one range and one record at a time. Without
    ``with_payload`` payloads are checked and left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                system, place = file_system(split["path"])
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    end = min(split["start"] + split_bytes, split["n_bytes"])
                    for at, content in RangeReader(file, split["start"], end).records():
                        row = {"path": split["path"], "at": at} | parse(content)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    splits = manifest.select(
        "path",
        "n_bytes",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(split_bytes))).alias(
            "start"
        ),
    )
    dealt = splits.repartition(shuffle_width(manifest), "path", "start")
    return dealt.mapInArrow(read, _RECORDS_DDL)


WARC_SQL = """
with paid as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages
),
firsts as (
  select *, min(page_id) over (partition by payload) as original from paid
)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as integer)
        >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1, 1)), '') as payload_digest,
  case when page_id is distinct from original then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from original then original end as refers_to
from firsts
"""
