"""WARC archives: writing records through Spark's text writer, and reading them back.

Each record is a gzip member of its own, so that it can be read by its offset.
A member ends in its unpacked length, whose highest byte is zero below 16 MB;
that byte is the writer's line separator, so every output file is an archive on
any store that Spark can write.  Payloads are sent in chunked transfer framing.
Long records are split into segments; reading groups a record's segments by
its identifier, orders them by number and verifies the total length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import batches
from .shared import materialize, n_shuffle

BREAK = b"\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Unpacked bytes of a member, below which its last byte is zero.
MEMBER_BYTES = 1 << 24
#: Records of a file; a record has a header and a block of at most SEGMENT_BYTES.
FILE_RECORDS = 4096
DATE = b"1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about size bytes that do not split a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _cuts(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(BREAK, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != BREAK:
            raise ValueError("a chunk is not followed by a line break")
        at = end + 4 + n


def _header(kind: bytes, identifier: str, url: bytes, n: int, more: list[tuple[str, str]]) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + identifier.encode() + b">", b"WARC-Date: " + DATE, b"WARC-Target-URI: " + url]
    lines += [f"{k}: {v}".encode() for k, v in more]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % n]
    return BREAK.join(lines) + BREAK + BREAK


def records(identifier: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """A page's records, without the two line breaks after each."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "").encode() or b"urn:page:unknown"
    own = [("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _header(b"revisit", identifier, target, len(http), own) + http
        return
    block = http + chunked(payload)
    parts = list(_cuts(block, SEGMENT_BYTES))
    if len(parts) == 1:
        yield _header(b"response", identifier, target, len(block), own) + block
        return
    yield _header(b"response", identifier, target, len(parts[0]), [*own, ("WARC-Segment-Number", "1")]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{identifier}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _header(b"continuation", f"{identifier}:segment:{k}", target, len(part), more) + part


def members(record: bytes) -> Iterator[bytes]:
    """A record and its two line breaks as a gzip member; as several if its header alone is longer than MEMBER_BYTES."""
    data = record + BREAK + BREAK
    for at in range(0, len(data), MEMBER_BYTES - 1):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield pack.compress(data[at : at + MEMBER_BYTES - 1]) + pack.flush()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) to a folder of gzipped archives.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with
    the smallest page_id is a response and the others are revisits of it;
    smaller payloads are all responses.  Null html is an empty payload, a null
    url has a placeholder.  A null page_id is always a response and never
    referred to.  Rows that repeat a page_id get records of their own.  Other
    columns are left out.  A record is one gzip member; a file has at most
    FILE_RECORDS of them, and as blocks are segments of SEGMENT_BYTES, at most
    some 70 MB unpacked.  A payload is held by one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    # Payloads meet as digests; a common one is combined in each task first.
    light = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", "sha")
    firsts = light.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("sha", "first")
    again = light.join(materialize(firsts, "firsts"), "sha").filter("page_id > first")
    refers = again.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("sha", "first"))).alias("refers"))
    # This exchange, which the join takes over, brings rows of one page_id to one task; the sort puts them side by side.
    dealt = rows.filter("page_id is not null").repartition(n_shuffle(pages.sparkSession), "page_id")
    full = dealt.join(refers, "page_id", "left").sortWithinPartitions("page_id").select("page_id", "url", "html", F.col("refers")[F.col("sha")].alias("refers_to"))
    full = full.unionByName(rows.filter("page_id is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])

        def rows_() -> Iterator[dict]:
            last, n = None, 0
            for batch in it:
                for page_id, url, html, refers_to, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # Rows of a page_id lie in one task, which numbers repeated ones.
                    n = n + 1 if page_id == last and page_id is not None else 0
                    last = page_id
                    identifier = f"urn:page:{page_id}" + f":{n}" * (n > 0) if page_id is not None else f"urn:page:none:{odd}"
                    for record in records(identifier, page_id, url, html.encode("utf-8", "surrogatepass"), refers_to):
                        # The writer adds the last byte, a zero.
                        yield from ({"value": member[:-1]} for member in members(record))

        for batch in batches(rows_(), schema):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string(), safe=False)], names=["value"])

    numbered = full.withColumn("odd", F.monotonically_increasing_id())
    numbered.mapInArrow(task, "value string").write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")
SEGMENT = pa.schema([("origin", pa.string()), ("no", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
SEGMENT_SQL = "origin string, no int, total long, page_id long, kind string, digest string, n_bytes long, refers_to long, block binary"
PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
PAGE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def parse(archive: bytes | BinaryIO) -> Iterator[dict]:
    """The records of an archive, one at a time."""
    file = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = []
        while (line := file.readline()) != BREAK:
            if not line:
                raise ValueError("a record is cut off")
            lines.append(line)
        fields = {k.decode().lower(): v.decode() for k, v in FIELD.findall(b"".join(lines))}
        n = int(fields["content-length"])
        block = file.read(n)
        if len(block) != n or file.read(4) != BREAK + BREAK:
            raise ValueError("a record is cut off")
        number = lambda k: int(fields[k]) if fields.get(k) else None
        refers = fields.get("warc-refers-to")
        yield {
            "origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
            "no": number("warc-segment-number"),
            "total": number("warc-segment-total-length"),
            "page_id": number("warc-page-id"),
            "kind": fields["warc-type"],
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "n_bytes": number("warc-payload-length"),
            "refers_to": int(refers.strip("<>").split(":")[2]) if refers else None,
            "block": block,
        }


def _page(r: dict, block: bytes, with_payload: bool) -> dict:
    """A page from a whole record; its payload's digest and length are verified."""
    row = {"page_id": r["page_id"], "payload_bytes": r["n_bytes"], "payload_digest": r["digest"], "record_type": r["kind"], "refers_to": r["refers_to"], "payload": None}
    if r["kind"] == "response":
        head, _, body = block.partition(b"\r\n\r\n")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if payload_digest(payload) != r["digest"]:
            raise ValueError(f"payload of {r['origin']} does not have its digest")
        row |= {"payload_bytes": len(payload), "payload_digest": payload_digest(payload), "payload": payload if with_payload else None}
    return row


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of archives, given as rows with ``content`` as the binaryFile source gives them.

    Returns page_id, payload_bytes, payload_digest (base32 SHA-1), record_type,
    refers_to and payload (null for revisits).  A record that is cut off, has
    a missing segment or another total length or digest than stated is an error.
    A task holds an archive as it is stored and unpacks one record at a time.
    """

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in it:
                for value in batch.column(0):
                    content = value.as_py()
                    for r in parse(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else content):
                        if r["no"] is None:
                            # A whole record is a page at once; only segments carry their blocks on.
                            page = _page(r, r["block"], with_payload)
                            r |= {"n_bytes": page["payload_bytes"], "digest": page["payload_digest"], "block": page["payload"]}
                        yield r

        yield from batches(rows(), SEGMENT)

    def assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in it:
                for i in range(batch.num_rows):
                    parts = batch.column(0)[i].as_py()
                    block = b"".join(p["block"] for p in parts)
                    if [p["no"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                        raise ValueError(f"segments of {parts[0]['origin']} are not whole")
                    yield _page(parts[0], block, with_payload)

        yield from batches(rows(), PAGE)

    segments = files.select("content").mapInArrow(split, SEGMENT_SQL)
    segments = materialize(segments, "segments")
    single = segments.filter("no is null").selectExpr("page_id", "n_bytes payload_bytes", "digest payload_digest", "kind record_type", "refers_to", "block payload")
    several = segments.filter("no is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("no", "total", "origin", "page_id", "kind", "digest", "n_bytes", "refers_to", "block"))).alias("parts"))
    return single.unionByName(several.select("parts").mapInArrow(assemble, PAGE_SQL))


__all__ = ["chunked", "dechunked", "parse", "read_warc", "records", "write_warc"]
