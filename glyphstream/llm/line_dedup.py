"""Line dedup: drop lines that an earlier document already has.

Pass 1 sends hashes of lines to the task that owns them, combined over some
megabytes of text first.  The owner fills two Bloom filters, of hashes seen
once and seen again, and tells each document which of its lines the second one
holds.  Pass 2 sends only these suspected lines, as text, for exact
confirmation and the choice of the first document.  Filters are as many as
there are partitions, so none grows with the corpus, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BYTE_CODES, LOWER, SPACE, U64, Chunk, chunks, mix, prefix, runs, span_hash, string_bytes
from .repeats import DOC, batches, doc_records, usable_texts, with_keys
from .shared import by_place, materialize, n_shuffle, place_of

BITS_PER_HASH = 12
N_PROBES = 4
#: Lines whose hashes a task combines before it sends them.
COMBINED = 400_000
#: Hashes that a task remembers to have sent as found in several documents.
TOLD = 1_000_000


def lines_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and where each document's lines begin in these arrays."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.start, breaks + 1]))
    ends = np.sort(np.concatenate([breaks, chunk.end]))
    count = np.searchsorted(breaks, chunk.end) - np.searchsorted(breaks, chunk.start) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def line_keys(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stripped spans of the lines, their lengths in code points, and hashes of the lower-cased keys."""
    solid = np.flatnonzero(~SPACE[chunk.data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    lo = np.where(some, solid[np.minimum(a, len(solid) - 1)] if len(solid) else 0, starts)
    hi = np.where(some, solid[b - 1] + 1 if len(solid) else 0, starts)
    points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    return lo, hi, points[hi] - points[lo], span_hash(prefix(BYTE_CODES[LOWER[chunk.data]]), lo, hi)


class Bloom:
    """A Bloom filter over 64-bit hashes."""

    def __init__(self, n: int) -> None:
        self.n_bits = max(64, n * BITS_PER_HASH)
        self.bits = np.zeros(self.n_bits // 8 + 1, np.uint8)

    def _probes(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = mix(hashes) | U64(1)
        for i in range(N_PROBES):
            yield ((hashes + step * U64(i)) % U64(self.n_bits)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._probes(hashes):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._probes(hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


#: To an owner: part, docs (DOC records) and body; or of a document: doc_id, key and body, hashes of suspected lines.
SENT = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("docs", pa.binary()), ("body", pa.binary())])
SENT_SQL = "part int, doc_id long, key long, docs binary, body binary"
SUSPECT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("body", pa.binary())])
SUSPECT_SQL = "doc_id long, key long, body binary"


def _by_doc(docs: np.ndarray, hashes: np.ndarray) -> Iterator[dict]:
    """doc_id, key and hashes, one row for each of the DOC records."""
    order = np.lexsort((docs["key"], docs["doc_id"]))
    docs, hashes = docs[order], hashes[order]
    for a, b in zip(*runs(docs), strict=True):
        yield {"doc_id": int(docs["doc_id"][a]), "key": int(docs["key"][a]), "body": hashes[a:b].tobytes()}


def _combined(docs: np.ndarray, doc: np.ndarray, h: np.ndarray, told: np.ndarray, parts: int) -> tuple[list[dict], np.ndarray]:
    """SENT rows for lines (index into docs, hash), and the hashes found in several documents."""
    order = np.lexsort((docs["key"][doc], docs["doc_id"][doc], h))
    h, doc = h[order], doc[order]
    ids = docs["doc_id"][doc]
    first, last = runs(h)
    several = ids[last - 1] > ids[first]
    here = np.repeat(several | np.isin(h[first], told), last - first)
    rows = [r | {"part": (r["key"] ^ r["doc_id"]) % parts, "docs": None} for r in _by_doc(docs[doc[here]], h[here])]
    # Of the others, which one document alone has so far, every row of that document goes along.
    alone, told_now = ~here, np.setdiff1d(h[first][several], told)
    sent, of = np.concatenate([h[alone], told_now]), np.concatenate([doc[alone], np.full(len(told_now), -1)])
    part = (sent >> U64(33)).astype(np.int64) % parts
    order = np.lexsort((of, part))
    part, sent, of = part[order], sent[order], of[order]
    for a, b in zip(*runs(part), strict=True):
        n_told = int(np.searchsorted(of[a:b], 0))
        used, place = np.unique(of[a + n_told : b], return_inverse=True)
        body = np.array([n_told], "<u4").tobytes() + sent[a:b].tobytes() + place.astype("<u4").tobytes()
        rows.append({"part": int(part[a]), "doc_id": None, "key": None, "docs": docs[used].tobytes(), "body": body})
    return rows, told_now


def _send(place: int, min_chars: int, parts: int):
    """Pass 1, where the text is the column of that place."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            told = np.zeros(0, U64)
            docs, doc, h, n, base = [], [], [], 0, 0
            for batch in it:
                records = doc_records(batch)
                for chunk in chunks(batch.column(place)):
                    starts, ends, bounds = lines_of(chunk)
                    _, _, points, hashes = line_keys(chunk, starts, ends)
                    use = points >= min_chars
                    docs.append(records[chunk.rows])
                    doc.append(np.repeat(np.arange(len(chunk.rows)), np.diff(bounds))[use] + base)
                    h.append(hashes[use] >> U64(1))
                    base, n = base + len(chunk.rows), n + len(h[-1])
                    if n >= COMBINED:
                        out, new = _combined(np.concatenate(docs), np.concatenate(doc), np.concatenate(h), told, parts)
                        yield from out
                        # Forgotten hashes are sent once more, no more.
                        told = np.sort(np.concatenate([told, new])) if len(told) + len(new) <= TOLD else np.sort(new)
                        docs, doc, h, n, base = [], [], [], 0, 0
            if n:
                yield from _combined(np.concatenate(docs), np.concatenate(doc), np.concatenate(h), told, parts)[0]

        yield from batches(rows(), SENT)

    return task


def _suspects(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of an owner's share, what its twice-seen filter holds, by document; what is suspect already passes."""

    def rows() -> Iterator[dict]:
        held = []
        for batch in it:
            for doc_id, key, docs, body in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if docs is None:
                    yield {"doc_id": doc_id, "key": key, "body": body}
                else:
                    held.append((docs, body))
        n = sum((len(body) - 4) // 8 for _, body in held)
        once, twice = Bloom(n), Bloom(n)

        def opened() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for docs, body in held:
                n_told = int(np.frombuffer(body, "<u4", 1)[0])
                n_sent = (len(body) - 4 + 4 * n_told) // 12
                sent = np.frombuffer(body, U64, n_sent, 4)
                yield sent[:n_told], sent[n_told:], np.frombuffer(docs, DOC)[np.frombuffer(body, "<u4", offset=4 + 8 * n_sent)]

        for told, sent, _ in opened():
            twice.add(told)
            own = np.unique(sent)  # two rows of one document are no second sight
            twice.add(own[once.has(own)])
            once.add(own)
        for _, sent, docs in opened():
            hit = twice.has(sent)
            yield from _by_doc(docs[hit], sent[hit])

    yield from batches(rows(), SUSPECT)


LINE_SQL = "h long, line string, docs array<struct<doc_id:long,key:long,nos:array<int>>>"
LINE = pa.schema([("h", pa.int64()), ("line", pa.string()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.int64()), ("nos", pa.list_(pa.int32()))])))])


def _emit(place: int, min_chars: int):
    """Pass 2: the suspected lines of documents, whose hashes are in the last column; equal ones of a chunk make one row."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in it:
                records, suspected = doc_records(batch), batch.column(batch.num_columns - 1)
                for chunk in chunks(batch.column(place)):
                    starts, ends, bounds = lines_of(chunk)
                    lo, hi, points, hashes = line_keys(chunk, starts, ends)
                    hashes = hashes >> U64(1)
                    data = LOWER[chunk.data].tobytes()
                    held: dict[bytes, dict[int, list[int]]] = {}
                    told: dict[bytes, int] = {}
                    for d, row in enumerate(chunk.rows.tolist()):
                        a, b = int(bounds[d]), int(bounds[d + 1])
                        own = np.frombuffer(b"".join(suspected[row].as_py()), U64)
                        for k in (np.flatnonzero(np.isin(hashes[a:b], own) & (points[a:b] >= min_chars)) + a).tolist():
                            line = data[lo[k] : hi[k]]
                            told[line] = int(hashes[k])
                            held.setdefault(line, {}).setdefault(row, []).append(k - a)
                    for line, by_row in held.items():
                        docs = [{"doc_id": int(records["doc_id"][r]), "key": int(records["key"][r]), "nos": nos} for r, nos in by_row.items()]
                        yield {"h": told[line], "line": line.decode("utf-8", "replace"), "docs": docs}

        yield from batches(rows(), LINE)

    return task


RESULTS = (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType()))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drop every line whose key is in at least two documents, except in the one with the smallest doc_id.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased; keys of fewer than ``min_chars`` code points stay.
    Returns the columns of docs with ``text`` replaced by the lines that are
    left, joined by newlines, and n_lines, n_dropped and kept_sha256; columns
    of docs with these names, in any case, are replaced, and all others stay.

    Null text counts as empty, and an empty text as one empty line.  A null
    doc_id: the document keeps all lines and is nobody's first document.  Rows
    that repeat a doc_id are one document.  A document whose lines all go stays,
    with an empty text.  A text, with a few arrays of its length, is held by
    one task at once.
    """
    parts = n_shuffle(docs.sparkSession)
    names = [n for n, _ in RESULTS]
    plain, back = by_place(docs, names)
    at = place_of(docs, "text")
    base = plain.withColumn(f"_{at}", F.coalesce(F.col(f"_{at}").cast("string"), F.lit("")))
    base = with_keys(base, f"_{place_of(docs, 'doc_id')}", f"_{at}")
    usable = usable_texts(base)

    light = usable.select("doc_id", "key", F.col(f"_{at}").alias("text"))
    sent = light.mapInArrow(_send(2, min_chars, parts), SENT_SQL)
    suspects = materialize(sent.repartitionById(parts, F.col("part")).mapInArrow(_suspects, SUSPECT_SQL), "suspects")
    suspected = suspects.groupBy("doc_id", "key").agg(F.collect_list("body").alias("bodies"))
    # All columns go along: the last join then reuses this exchange of the texts.
    asked = base.join(suspected, ["doc_id", "key"], "left").filter("bodies is not null").select(*base.columns, "bodies")
    found = materialize(asked.mapInArrow(_emit(at, min_chars), LINE_SQL), "lines")
    # Partial aggregation combines a common line within each task.
    ids = F.transform("docs", lambda d: d["doc_id"])
    first = found.select("h", "line", F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi")).groupBy("h", "line").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last").select("h", "line", "first")
    # Both sides are read from files and dealt for the join alone, so that AQE can split a very common line.
    dropped = found.join(materialize(first, "firsts"), ["h", "line"]).select("first", F.explode("docs").alias("d")).filter("d.doc_id > first")
    by_doc = dropped.groupBy("d.doc_id", "d.key").agg(F.flatten(F.collect_list("d.nos")).alias("nos"))
    joined = base.join(by_doc, ["doc_id", "key"], "left").select(*base.columns, "nos")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = string_bytes(batch.column(at))
            texts, n_lines, n_dropped, digest = [], [], [], []
            for i, nos in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                n_lines.append(raw.count(b"\n") + 1)
                gone = set(nos or ())
                if gone:
                    raw = b"\n".join(x for k, x in enumerate(raw.split(b"\n")) if k not in gone)
                texts.append(raw)
                n_dropped.append(len(gone))
                digest.append(hashlib.sha256(raw).hexdigest())
            columns = [pa.array(texts, pa.binary()).cast(pa.string(), safe=False) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names])

    schema = joined.drop("nos").schema
    for name, kind in RESULTS:
        schema = schema.add(name, kind)
    return joined.mapInArrow(finish, schema).select(*back, *names)
