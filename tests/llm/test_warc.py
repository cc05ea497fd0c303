import base64
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from texts import collected

from clickloom.llm import warc
from clickloom.session import fresh_folder


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = min((i for i in groups[html or ""] if i is not None), default=None)
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = page_id is not None and page_id != first
        yield (f"<urn:page:{page_id}>", len(payload), sha, "revisit" if again else "response",
               f"<urn:page:{first}>" if again else None)


ODD = [
    (1, "http://a/ü?x=1 2\r\nX: y", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "", "<p>same</p>"),
    (4, "http://b", ""), (5, "http://b", None), (6, "http://c", "WARC/1.1\r\n\r\n\x1f\x08 not a record \r\n\r\n"),
    (7, "http://d", "x" * 3_000_000), (8, "http://e", "".join(chr(40 + i * 7919 % 20_000) for i in range(60_000))),
    (None, None, None), (None, "http://f", "<p>same</p>"), (1, "http://again", "<p>same</p>"),
]
COLUMNS = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return frame.withColumns({"payload": F.lit("x"), "original": F.lit("y"), "path": F.lit(1)})


@pytest.mark.parametrize("split", [50, 4096, 8 << 20])
def test_odd_pages(spark, split):
    frame = pages(spark, ODD if split > 50 else [row for row in ODD if row[0] not in (7, 8)]).repartition(3)
    rows = [tuple(row) for row in frame.select("page_id", "url", "html").collect()]
    manifest = warc.write_archives(frame, fresh_folder(spark, "archives"))
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    found = warc.read_archives(manifest, split_bytes=split)
    assert collected(found, *COLUMNS) == sorted(brute(rows), key=repr)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in found.filter("payload is not null").collect()}
    by_id = {f"<urn:page:{i}>": (html or "").encode() for i, _, html in rows if i not in (None, 1)}
    assert all(payload == by_id.get(name, payload) for name, payload in payloads.items())
    assert not found.select("path", "at").exceptAll(found.select("path", "at").distinct()).collect()


def test_hot_payload(spark):
    rows = [(i, f"http://{i}", "hot" if i % 3 else f"page {i}") for i in range(400)]
    manifest = warc.write_archives(pages(spark, rows).repartition(5), fresh_folder(spark, "archives"))
    found = warc.read_archives(manifest, split_bytes=1000, with_payload=False)
    assert collected(found, *COLUMNS) == sorted(brute(rows), key=repr)
    assert found.filter("payload is not null").isEmpty()


def test_false_magic_is_no_record(spark, tmp_path):
    """Stored blocks can hold anything: a magic, a gzip member that is no record."""
    real = [warc.record(i, "http://x", f"page {i}".encode(), None) for i in range(4)]
    parts, at = [], []
    for i, content in enumerate(real):
        packer = zlib.compressobj(0, zlib.DEFLATED, warc.GZIP)  # stored, not compressed
        junk = content + warc.MAGIC * 3 + warc.member(b"no record") + b"\x1f"
        at.append(sum(map(len, parts)))
        parts.append(packer.compress(junk) + packer.flush())
        assert i < 4
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    size = path.stat().st_size
    manifest = spark.createDataFrame([(str(path), size, 4)], "path string, n_bytes bigint, n_records bigint")
    for split in (7, 64, 300, size):
        found = warc.read_archives(manifest, split_bytes=split)
        assert sorted(r["at"] for r in found.collect()) == at


def test_damage_is_noticed(spark, tmp_path):
    content = warc.record(1, "http://x", b"some page", None)
    for name, data in {
        "cut": warc.member(content)[:-9],
        "changed": warc.member(content.replace(b"some page", b"some pagE")),
    }.items():
        (tmp_path / name).write_bytes(data)
        manifest = spark.createDataFrame([(f"file:{tmp_path / name}", len(data))], "path string, n_bytes bigint")
        with pytest.raises(Exception, match="cut off|not what was written"):
            warc.read_archives(manifest).collect()


def foreign(kind, block, **headers):
    lines = [f"{name.replace('_', '-')}: {value}" for name, value in headers.items()]
    head = "\r\n".join(["WARC/1.0", f"warc-type:{kind}", *lines, f"CONTENT-LENGTH:  {len(block)}"])
    return warc.member(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    """All record types; names in any case, absent digests, folded lines, no HTTP length."""
    page, http = b"<p>page</p>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha, hexa = warc.digest(page), hashlib.sha1(page).hexdigest()
    is_http = {"Content_Type": "application/http; msgtype=response"}
    chunked = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + b"b\r\n" + page + b"\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<info>", WARC_Filename="a\r\n  b"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", WARC_Record_ID="<q>", Content_Type="application/http"),
        foreign("response", http + page, WARC_Record_ID="<none>", **is_http),
        foreign("response", http + page, warc_record_id="<b32>", warc_payload_digest=f"sha1:{sha}", **is_http),
        foreign("response", http + page, WARC_Record_ID="<hex>", WARC_Payload_Digest=f"SHA1:{hexa}", **is_http),
        foreign("response", http + page, WARC_Record_ID="<md5>", WARC_Payload_Digest="md5:00", **is_http),
        foreign("response", chunked, WARC_Record_ID="<chunked>", WARC_Payload_Digest=f"sha1:{sha}", **is_http),
        foreign("response", http + page[:4], WARC_Record_ID="<cut>", WARC_Truncated="length",
                WARC_Payload_Digest=f"sha1:{sha}", **is_http),
        foreign("resource", page, WARC_Record_ID="<res>", WARC_Target_URI="http://a", Content_Type="text/html"),
        foreign("revisit", http, WARC_Record_ID="<again>", WARC_Payload_Digest=f"sha1:{sha}", WARC_Refers_To="<b32>", **is_http),
        foreign("revisit", b"", WARC_Record_ID="<bare>", WARC_Payload_Digest="sha256:ab"),
        foreign("metadata", b"", WARC_Record_ID="<meta>"),
    ]
    (tmp_path / "crawl.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    for split in (40, 1000, 1 << 20):
        found = warc.read_archives(warc.archives(spark, str(tmp_path)), split_bytes=split)
        rows = {r["record_id"]: r for r in found.collect()}
        assert len(rows) == found.count() == len(records)
    assert all(bytes(rows[f"<{name}>"]["payload"]) == page for name in ("none", "b32", "hex", "md5", "res"))
    assert all(rows[f"<{name}>"]["payload_digest"] == sha for name in ("none", "b32", "hex", "md5", "res", "again"))
    assert [rows[f"<{n}>"]["payload_bytes"] for n in ("info", "q", "cut", "res", "again", "bare", "meta")] == [
        13, 0, 4, len(page), None, None, 0]
    assert rows["<again>"]["refers_to"] == "<b32>" and rows["<bare>"]["payload_digest"] == "sha256:ab"
    assert rows["<info>"]["target_uri"] is None and rows["<res>"]["target_uri"] == "http://a"
    assert [r["record_type"] for r in rows.values()].count("response") == 6


def test_one_member_for_all_records_is_an_error(spark, tmp_path):
    both = b"".join(warc.record(i, "http://x", b"page", None) for i in range(2))
    (tmp_path / "a.warc.gz").write_bytes(warc.member(both))
    with pytest.raises(Exception, match="same gzip member"):
        warc.read_archives(warc.archives(spark, str(tmp_path))).collect()


def test_empty_table(spark):
    manifest = warc.write_archives(pages(spark, []), fresh_folder(spark, "archives"))
    assert warc.read_archives(manifest).collect() == []
