"""Writing archives and reading them back, and archives that are not whole."""

import base64
import gzip
import hashlib
import zlib

import pytest
from glyphstream.llm import warc
from glyphstream.llm.warc import chunked, dechunked, parse, read_warc, records, write_warc

LONG = "<p>é中😀" * 20_000
ROWS = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, "same"), (1, "http://a b/1", None), (3, "x", ""), (4, "x", LONG), (7, "x", LONG), (None, "x", "same"), (None, "y", "only here"), (6, "x", "one"), (6, "x", "two"), (6, "x", "two"), (8, "x", "\r\n\r\nWARC/1.1\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(min_bytes=0):
    out = []
    for page, _, html in ROWS:
        n = len((html or "").encode())
        first = min((p for p, _, h in ROWS if p is not None and (h or "") == (html or "")), default=None)
        again = page is not None and n >= min_bytes and page > first
        out.append((page, n, digest(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def written(spark, tmp_path, rows, **options):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, refers string, SHA int").repartition(3)
    write_warc(pages, path, **options)
    return spark.read.format("binaryFile").load(path)


def test_round_trip(spark, tmp_path):
    files = written(spark, tmp_path, ROWS)
    got = read_warc(files).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected()
    by_digest = {digest(h): (h or "").encode() for _, _, h in ROWS}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    # Every record has an identifier of its own.
    names = [x["origin"] for f in files.collect() for x in parse(gzip.decompress(f.content)) if x["no"] in (None, 1)]
    assert len(names) == len(set(names)) == len(ROWS)


def test_small_payloads_and_empty_tables(spark, tmp_path):
    assert sorted((tuple(r)[:5] for r in read_warc(written(spark, tmp_path, ROWS, min_bytes=4)).collect()), key=str) == expected(4)
    assert read_warc(written(spark, tmp_path / "none", [])).count() == 0


def test_a_record_is_a_member_and_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    large = "".join(f"<p>{i} é" for i in range(400_000))
    rows = [(i, "u", f"page {i} " * 50) for i in range(100)] + [(100, "u", large)]
    files = written(spark, tmp_path, rows)
    assert {r.page_id: bytes(r.payload).decode() for r in read_warc(files).collect()} == {p: h for p, _, h in rows}
    contents = [f.content for f in files.collect()]
    held = [list(parse(gzip.decompress(c))) for c in contents]
    assert len(large.encode()) > 3 << 20 and max(map(len, held)) == 20 and sum(map(len, held)) > 250
    for content, records_ in zip(contents, held):
        # Members one by one are the records one by one.
        at, found = 0, []
        while at < len(content):
            unpack = zlib.decompressobj(31)
            found += list(parse(unpack.decompress(content[at:])))
            at = len(content) - len(unpack.unused_data)
        assert found == records_


def test_headers_longer_than_a_member(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100)
    for record in records("urn:page:1", 1, "u" * 1000, LONG.encode(), None):
        packed = list(warc.members(record))
        assert len(packed) > 1 and {m[-1] for m in packed} == {0}
        assert gzip.decompress(b"".join(packed)) == record + b"\r\n\r\n"


def archive(*some):
    return b"".join(r + b"\r\n\r\n" for r in some)


def frame(spark, *contents):
    return spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")


def test_segments_in_any_order_and_many_members(spark):
    parts = list(records("urn:page:1", 1, "u", LONG.encode(), None))
    other = list(records("urn:page:2", 2, "u", b"short", None))
    assert len(parts) > 3
    files = frame(spark, archive(*parts[2:], *other), gzip.compress(archive(parts[1])) + gzip.compress(archive(parts[0])))
    got = {r.page_id: bytes(r.payload) for r in read_warc(files).collect()}
    assert got == {1: LONG.encode(), 2: b"short"}


@pytest.mark.parametrize("break_it", ["missing", "total", "cut", "digest", "not a record"])
def test_archives_that_are_not_whole(spark, break_it):
    parts = list(records("urn:page:1", 1, "u", LONG.encode(), None))
    if break_it == "missing":
        content = archive(parts[0], *parts[2:])
    elif break_it == "total":
        content = archive(*parts).replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 1")
    elif break_it == "cut":
        content = archive(*parts)[:-2000]
    elif break_it == "digest":
        content = archive(*records("urn:page:1", 1, "u", b"short", None)).replace(b"short", b"shirt")
    else:
        content = b"HTTP/1.1 200 OK\r\n\r\n"
    with pytest.raises(Exception, match="whole|cut off|digest|not a WARC"):
        read_warc(frame(spark, content)).collect()


def test_chunked_framing():
    for payload in (b"", b"a", "é中😀".encode() * 3000):
        assert dechunked(chunked(payload)) == payload
        assert dechunked(chunked(payload, 5)) == payload
    assert dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.payload_digest(b"") == digest("")
