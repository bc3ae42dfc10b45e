"""Finding repeated windows of a corpus by anchors.

Both exact-duplicate operators ask the same question: which windows of ``width``
units (bytes or words) also start earlier?  They answer it in four steps, none
of which brings all occurrences of a string to one task as rows:

1. every text is cut into *contexts*: runs of consecutive windows that share an
   anchor (a short string inside them).  Equal windows have equal anchors, at
   the same place, so they lie in contexts with the same anchor hash.  A task
   settles contexts that an earlier one of the same piece of text equals, asks
   for those whose anchor several contexts of the piece have, and sends
   the anchor hashes of the others to their owners;
2. owners of anchor hashes ask for the contexts whose anchor others have too,
   and count the contexts of each anchor;
3. the text of what is asked for is dealt by anchor hash, after equal contexts
   of a task were combined once more.  Contexts of an anchor with very many of
   them are dealt window by window, by the window's hash;
4. the operator's own method settles contexts and then their windows, and what
   is settled comes back to the documents by key.

Anchor hashes only bring strings together or keep them apart; whether two are
equal is for the operator's method, which looks at their bytes.  Whole texts
that an earlier document has as well (equal SHA-256) are settled before step 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_CODES, U64, mix, prefix, ranges, run_mask, runs, span_hash
from .shared import materialize, n_shuffle

#: Contexts of one anchor above which they are dealt window by window.
HOT_CONTEXTS = 1000
#: The anchors with most contexts of which that holds at most, 4 MB in each task; others are dealt whole.
MAX_HOT = 500_000
#: Bytes of text within which equal contexts are combined before anything is sent.
SCOPE_BYTES = 12 << 20
#: Windows that a task settles at once.
AT_ONCE = 200_000
#: Bytes of each field of an anchor as it is sent: its hash (32 bits beside the
#: part it is dealt to), its document's place in the packet (the step from the
#: entry before), and bytes of hashes of what is left and right of it.
WIDTHS = {"anchor": 4, "doc": 2, "left": 1, "right": 1}
ANCHOR = U64((1 << 32) - 1)
PLACED = np.dtype([("lo", "<u4"), ("n", "<u4")])
ASKED = np.dtype("<u4")
TOLD = np.dtype([("anchor", "<u8"), ("count", "<u4"), ("left", "u1"), ("right", "u1")])
DOC = np.dtype([("doc_id", "<i8"), ("key", "<i8")])
MAX_WINDOWS = (1 << 16) - 1


@dataclass
class Contexts:
    """Contexts of a piece of text: anchor hashes, document (index into docs), first window and number of windows, bytes.

    left and right hash what lies beside the anchor, so far that a window which
    holds the anchor has one of them whole: contexts that share a window agree
    in one.
    """

    docs: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    at: np.ndarray
    size: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, which: np.ndarray) -> Contexts:
        return Contexts(self.docs, self.text, *(x[which] for x in (self.anchor, self.doc, self.lo, self.n, self.at, self.size, self.left, self.right)))


def gathered(pieces: Iterator[Contexts]) -> Iterator[Contexts]:
    """Contexts of pieces of text, put together to those of SCOPE_BYTES."""
    held: list[Contexts] = []
    size = 0
    for c in pieces:
        held.append(c)
        size += len(c.text)
        if size >= SCOPE_BYTES:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[Contexts]) -> Contexts:
    docs = np.cumsum([0] + [len(c.docs) for c in held])
    text = np.cumsum([0] + [len(c.text) for c in held])
    moved = [(c.anchor, c.doc + d, c.lo, c.n, c.at + t, c.size, c.left, c.right) for c, d, t in zip(held, docs, text, strict=False)]
    return Contexts(np.concatenate([c.docs for c in held]), np.concatenate([c.text for c in held]), *(np.concatenate(x) for x in zip(*moved, strict=True)))


def span_hashes(text: np.ndarray, at: np.ndarray, size: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the strings at ascending places, over a megabyte of text at a time."""
    out = np.empty(len(at), U64)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + piece, side="right")))
        first = at[a]
        end = at[a:b] + size[a:b]
        out[a:b] = span_hash(prefix(BYTE_CODES[text[first : end.max()]]), at[a:b] - first, end - first)
        a = b
    return out


@dataclass
class Method:
    """What the two operators have of their own.

    contexts: a batch of (doc_id, key, text) to Contexts and the rows of their
    docs in it; windows: text, at, size and n of contexts to their windows, as
    (which context, at, size);
    earlier: text, at (ascending) and size of strings and a rank of each to those that
    some string of a smaller rank equals, by comparing bytes.  own: whether an
    earlier place of the same document counts as earlier.
    """

    contexts: Callable[[pa.RecordBatch], Iterator[tuple[Contexts, np.ndarray]]]
    windows: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    earlier: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    own: bool


def to_planes(fields: dict[str, np.ndarray]) -> bytes:
    """Fields byte by byte, each byte of all records together: high bytes then compress well."""
    planes = []
    for name, width in WIDTHS.items():
        raw = np.ascontiguousarray(fields[name], "<u8").view(np.uint8).reshape(-1, 8)
        planes.append(raw[:, :width].T)
    return np.concatenate(planes).tobytes()


def from_planes(body: bytes) -> dict[str, np.ndarray]:
    planes = np.frombuffer(body, np.uint8).reshape(sum(WIDTHS.values()), -1)
    out, at = {}, 0
    for name, width in WIDTHS.items():
        raw = np.zeros((planes.shape[1], 8), np.uint8)
        raw[:, :width] = planes[at : at + width].T
        out[name] = raw.view("<u8").ravel()
        at += width
    return out


def pack_docs(docs: np.ndarray) -> bytes:
    """DOC records, compressed: steps between doc_ids by planes of bytes, and keys."""
    step = np.diff(docs["doc_id"], prepend=np.int64(0))
    zigzag = ((step << 1) ^ (step >> 63)).view(np.uint8).reshape(-1, 8)
    raw = zigzag.T.tobytes() + docs["key"].astype("<u4").tobytes()
    return np.array([len(docs)], "<u4").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack_docs(body: bytes) -> np.ndarray:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    raw = pa.decompress(body[4:], 12 * n, "zstd", asbytes=True)
    zigzag = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    out = np.zeros(n, DOC)
    out["doc_id"] = np.cumsum((zigzag >> U64(1)).view(np.int64) ^ -(zigzag & U64(1)).view(np.int64))
    out["key"] = np.frombuffer(raw, "<u4", offset=8 * n)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text and no_id: what the documents are joined by is never null, so that all joins share one exchange of the texts.

    key is a hash of the text, of 32 bits: rows that repeat a doc_id with another
    text stay apart.  A null doc_id counts as 0, with a key that no other has.
    """
    return with_keys(docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", "text")


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with doc_id, key and no_id, as in keyed."""
    own = F.col(doc_id).cast("long")
    hashed = F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1))
    return docs.withColumns({"no_id": own.isNull(), "key": F.when(own.isNull(), F.bitwise_not(hashed)).otherwise(hashed), "doc_id": F.coalesce(own, F.lit(0).cast("long"))})


def doc_records(batch: pa.RecordBatch) -> np.ndarray:
    """The DOC records of a batch of (doc_id, key, ...)."""
    out = np.zeros(batch.num_rows, DOC)
    for name in DOC.names:
        out[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return out


def batches(rows: Iterator[dict], schema: pa.Schema, at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= at_once:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rank(docs: np.ndarray, lo: np.ndarray, own: bool) -> np.ndarray:
    """What an earlier string has less of.  A row that is there twice is at one place, so it is no later than itself."""
    if not own:
        return docs["doc_id"]
    order = np.lexsort((lo, docs["doc_id"]))
    first, last = runs(docs["doc_id"][order], lo[order])
    out = np.empty(len(lo), np.int64)
    out[order] = np.repeat(np.arange(len(first)), last - first)
    return out


def _shared(anchor: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the contexts have an anchor that one of another rank has."""
    order = np.lexsort((rank, anchor))
    first, last = runs(anchor[order])
    several = rank[order][last - 1] > rank[order][first]
    out = np.empty(len(anchor), bool)
    out[order] = np.repeat(several, last - first)
    return out


def _near(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the contexts have an anchor, and what is left or right of it, that one of another rank has."""
    out = np.zeros(len(anchor), bool)
    some = np.flatnonzero(_shared(anchor, rank))
    for side in (left, right):
        out[some] |= _shared(mix(anchor[some].astype(U64) + (side[some].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), rank[some])
    return out


def _by_doc(docs: np.ndarray, name: str, records: np.ndarray) -> Iterator[dict]:
    """Records as one row for each document."""
    order = np.lexsort((docs["key"], docs["doc_id"]))
    docs, records = docs[order], records[order]
    for a, b in zip(*runs(docs), strict=True):
        yield {"part": 0, "doc_id": int(docs["doc_id"][a]), "key": int(docs["key"][a]), "done": None, "asked": None, "docs": None, "body": None} | {name: records[a:b].tobytes()}


def _asked_rows(docs: np.ndarray, anchor: np.ndarray, parts: int) -> Iterator[dict]:
    """Asked anchors as one row for each part that their documents are dealt to: documents, and the place of each anchor's."""
    if not len(docs):
        return
    bucket = (docs["doc_id"] ^ docs["key"]) % parts
    order = np.lexsort((docs["key"], docs["doc_id"], bucket))
    docs, anchor, bucket = docs[order], (anchor[order].astype(U64) & ANCHOR).astype(ASKED), bucket[order]
    for a, b in zip(*runs(bucket), strict=True):
        first, last = runs(docs[a:b])
        body = np.array([b - a], "<u4").tobytes() + (last - first).astype("<u4").tobytes() + anchor[a:b].tobytes()
        yield {"part": int(bucket[a]), "doc_id": int(bucket[a]), "key": None, "done": None, "asked": body, "docs": pack_docs(docs[a:b][first]), "body": None}


ASKED_OF_DOC = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("asked", pa.binary())])


def _asked_of_docs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows of asked anchors as one row for each document."""
    docs, anchors = [np.zeros(0, DOC)], [np.zeros(0, ASKED)]
    for batch in it:
        for body, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = unpack_docs(table)
            count = np.frombuffer(body, "<u4", len(own), 4)
            docs.append(np.repeat(own, count))
            anchors.append(np.frombuffer(body, ASKED, offset=4 + 4 * len(own)))
    rows = _by_doc(np.concatenate(docs), "asked", np.concatenate(anchors))
    yield from batches(({k: r[k] for k in ASKED_OF_DOC.names} for r in rows), ASKED_OF_DOC)


def _records(c: Contexts, kind: np.dtype) -> np.ndarray:
    out = np.zeros(len(c.lo), kind)
    for k in kind.names:
        out[k] = getattr(c, k)
    return out


def _done(docs: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[dict]:
    """Settled windows as one row for each document; docs: a DOC record for each run of them."""
    order = np.lexsort((lo, docs["key"], docs["doc_id"]))
    docs, lo, n = docs[order], lo[order].astype(np.int64), n[order].astype(np.int64)
    # Runs that touch make one record.
    new = np.ones(len(lo), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), PLACED)
    out["lo"], out["n"] = lo[first], np.add.reduceat(n, first) if len(first) else 0
    yield from _by_doc(docs[first], "done", out)


#: Of a document, done (PLACED records); of a part (as doc_id), asked anchors and their docs; or a packet for an owner: anchors (docs, body) or TOLD records (body alone).
SENT = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("done", pa.binary()), ("asked", pa.binary()), ("docs", pa.binary()), ("body", pa.binary())])
SENT_SQL = "part int, doc_id long, key long, done binary, asked binary, docs binary, body binary"
#: With neither done nor asked: an anchor with many contexts, as doc_id, and their number, as key.
SETTLED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("done", pa.binary()), ("asked", pa.binary()), ("docs", pa.binary())])
SETTLED_SQL = "doc_id long, key long, done binary, asked binary, docs binary"


def _sent(c: Contexts, method: Method, parts: int) -> Iterator[dict]:
    """Step 1 for one piece of text."""
    if not len(c.lo):
        return
    rank = _rank(c.docs[c.doc], c.lo, method.own)
    near = np.flatnonzero(_near(c.anchor, c.left, c.right, rank))
    settled = np.zeros(len(c.lo), bool)
    settled[near] = method.earlier(c.text, c.at[near], c.size[near], rank[near])
    done = c.take(settled)
    for row in _done(c.docs[done.doc], done.lo, done.n):
        yield row | {"part": (row["key"] ^ row["doc_id"]) % parts}
    c, rank = c.take(~settled), rank[~settled]
    near = _near(c.anchor, c.left, c.right, rank)
    asked = c.take(near)
    yield from _asked_rows(c.docs[asked.doc], asked.anchor, parts)
    order = np.lexsort((asked.right, asked.left, asked.anchor))
    first, last = runs(asked.anchor[order], asked.left[order], asked.right[order])
    told = np.zeros(len(first), TOLD)
    told["anchor"], told["left"], told["right"], told["count"] = (x[order][first] for x in (asked.anchor, asked.left, asked.right, asked.n))
    told["count"] = last - first
    anchors = told["anchor"]
    none = {"doc_id": None, "key": None, "done": None, "asked": None}
    part = (anchors >> U64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    for a, b in zip(*runs(part[order]), strict=True):
        yield none | {"part": int(part[order[a]]), "docs": None, "body": told[order[a:b]].tobytes()}
    c = c.take(~near)
    part = (c.anchor >> U64(32)).astype(np.int64) % parts
    order = np.lexsort((c.doc, part))
    for a, b in zip(*runs(part[order]), strict=True):
        pick = order[a:b]
        # doc places are of 16 bits: a packet holds at most so many documents
        used, place = np.unique(c.doc[pick], return_inverse=True)
        for k in range(0, len(used), 1 << 16):
            sub = (place >= k) & (place < k + (1 << 16))
            fields = {"anchor": c.anchor[pick][sub], "doc": np.diff(place[sub] - k, prepend=0), "left": c.left[pick][sub], "right": c.right[pick][sub]}
            yield none | {"part": int(part[pick[0]]), "docs": pack_docs(c.docs[used[k : k + (1 << 16)]]), "body": to_planes(fields)}


def _owned(own: bool, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 2, for one task's share of the anchors."""

    def rows(part: int, packets: list[tuple[bytes, bytes]], told: np.ndarray) -> Iterator[dict]:
        held = {k: [np.zeros(0, np.uint32)] for k in WIDTHS}
        tables, base = [np.zeros(0, DOC)], 0
        for docs, body in packets:
            fields = from_planes(body)
            fields["doc"] = np.cumsum(fields["doc"]) + U64(base)
            for k, v in fields.items():
                held[k].append(v.astype(np.uint32))
            tables.append(unpack_docs(docs))
            base += len(tables[-1])
        anchor, doc, left, right = (np.concatenate(held[k]) for k in ("anchor", "doc", "left", "right"))
        docs = np.concatenate(tables)[doc]
        # What is told stands for several documents; and any two contexts may be two places of one.
        rank = np.arange(len(anchor)) if own else docs["doc_id"]
        others = np.arange(len(told)) + (rank.max(initial=0) + 1)
        all_sides = [np.concatenate([a, told[k].astype(np.uint32)]) for a, k in ((left, "left"), (right, "right"))]
        asked = _near(np.concatenate([anchor, (told["anchor"] & ANCHOR).astype(np.uint32)]), *all_sides, np.concatenate([rank, others]))[: len(anchor)]
        out = anchor[asked].astype(U64) | U64(part << 32)
        yield from ({k: r[k] for k in SETTLED.names} for r in _asked_rows(docs[asked], anchor[asked], parts))
        # Anchors by their number of contexts.
        all_ = np.concatenate([out, told["anchor"]])
        count = np.concatenate([np.ones(len(out), np.int64), told["count"].astype(np.int64)])
        order = np.argsort(all_, kind="stable")
        first, _ = runs(all_[order])
        if len(first):
            total = np.add.reduceat(count[order], first)
            hot = total > HOT_CONTEXTS
            for anchor_, n_ in zip(all_[order][first][hot].view(np.int64).tolist(), total[hot].tolist(), strict=True):
                yield {"doc_id": anchor_, "key": n_, "done": None, "asked": None, "docs": None}

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packets, told = 0, [], []
        for batch in it:
            passed = []
            for p, doc_id, key, done, asked, docs, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    passed.append({"doc_id": doc_id, "key": key, "done": done, "asked": asked, "docs": docs})
                    continue
                part = p
                if docs is None:
                    told.append(np.frombuffer(body, TOLD))
                else:
                    packets.append((docs, body))
            yield from batches(iter(passed), SETTLED)
        # The part's number stands for the upper bits of anchors that are sent: TOLD records get it as well.
        all_ = np.concatenate([np.zeros(0, TOLD), *told])
        all_["anchor"] = (all_["anchor"] & ANCHOR) | U64(part << 32)
        yield from batches(rows(part, packets, all_), SETTLED)

    return task


#: What is sent of a context beside its bytes.
FETCHED = np.dtype([("anchor", "<u8"), ("lo", "<u4"), ("size", "<u4"), ("n", "<u2"), ("doc", "<u2")])
BYTES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("done", pa.binary()), ("docs", pa.binary()), ("body", pa.binary())])
BYTES_SQL = "part int, doc_id long, key long, done binary, docs binary, body binary"


def _by_kind(c: Contexts, method: Method, hot: np.ndarray) -> Iterator[Contexts]:
    """The contexts of other than hot anchors, and then, some at a time, the windows of the others, dealt by their own hash."""
    many = np.isin(c.anchor, hot) if len(hot) else np.zeros(len(c.lo), bool)
    if not many.all():
        yield c.take(~many)
    c = c.take(many)
    total = np.cumsum(c.n)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, total[a] - c.n[a] + AT_ONCE, side="right")))
        here = c.take(np.arange(a, b))
        of, at, size = method.windows(here.text, here.at, here.size, here.n)
        lo = here.lo[of] + np.arange(len(of)) - (np.cumsum(here.n) - here.n)[of]
        own = mix(here.anchor[of] ^ span_hashes(here.text, at, size))  # in the anchor's place
        # Equal windows side by side are one with their number, where places of one document don't count.
        first, last = runs(of, own) if not method.own else (np.arange(len(of)), np.arange(1, len(of) + 1))
        yield Contexts(here.docs, here.text, own[first], here.doc[of[first]], lo[first], last - first, at[first], size[first], here.left[of[first]], here.right[of[first]])
        a = b


def _fetched(c: Contexts, method: Method, hot: np.ndarray, parts: int) -> Iterator[dict]:
    """Step 3 for one piece of text: what is still unsettled, with its bytes."""
    for here in _by_kind(c, method, hot):
        settled = method.earlier(here.text, here.at, here.size, _rank(here.docs[here.doc], here.lo, method.own))
        done, here = here.take(settled), here.take(~settled)
        for row in _done(done.docs[done.doc], done.lo, done.n):
            yield {k: row[k] for k in BYTES.names} | {"part": (row["key"] ^ row["doc_id"]) % parts}
        # Anchors of whole contexts have their part as upper bits, windows a hash.
        part = (here.anchor >> U64(32)).astype(np.int64) % parts
        order = np.lexsort((here.doc, part))
        for a, b in zip(*runs(part[order]), strict=True):
            pick = order[a:b]
            used, place = np.unique(here.doc[pick], return_inverse=True)
            for k in range(0, len(used), 1 << 16):
                sub = pick[(place >= k) & (place < k + (1 << 16))]
                part_of = here.take(sub)
                part_of.doc = np.searchsorted(used, part_of.doc) - k
                planes = _records(part_of, FETCHED).view(np.uint8).reshape(len(sub), -1).T.tobytes()
                raw = planes + here.text[ranges(part_of.at, part_of.size)].tobytes()
                body = np.array([len(sub), len(raw)], "<u4").tobytes() + pa.compress(raw, "zstd", asbytes=True)
                yield {"part": int(part[pick[0]]), "doc_id": None, "key": None, "done": None, "docs": pack_docs(here.docs[used[k : k + (1 << 16)]]), "body": body}


def _received(packets: list[tuple[bytes, bytes]]) -> Contexts:
    """All contexts of a task, their bytes laid end to end, in the order of their anchors."""
    found, docs, text = [np.zeros(0, FETCHED)], [np.zeros(0, DOC)], [np.zeros(0, np.uint8)]
    for table, body in packets:
        n, n_bytes = np.frombuffer(body, "<u4", 2).tolist()
        raw = np.frombuffer(pa.decompress(body[8:], n_bytes, "zstd", asbytes=True), np.uint8)
        wide = FETCHED.itemsize
        found.append(np.ascontiguousarray(raw[: n * wide].reshape(wide, n).T).view(FETCHED).ravel())
        docs.append(unpack_docs(table)[found[-1]["doc"]])
        text.append(raw[n * wide :])
    f, text = np.concatenate(found), np.concatenate(text)
    size = f["size"].astype(np.int64)
    none = np.zeros(len(f), np.uint8)  # what was beside anchors has done its part
    c = Contexts(np.concatenate(docs), text, f["anchor"], np.arange(len(f)), f["lo"].astype(np.int64), f["n"].astype(np.int64), np.cumsum(size) - size, size, none, none)
    return c.take(np.argsort(c.anchor, kind="stable"))


def _resolved(method: Method) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 4, for one task's share of the contexts."""

    def block(c: Contexts) -> Iterator[dict]:
        """Contexts of some anchors, all that the task has of them: whole ones first, then the windows of what is left."""
        rank = _rank(c.docs[c.doc], c.lo, method.own)
        near = np.flatnonzero(_shared(c.anchor, rank))
        c, rank = c.take(near), rank[near]
        if not len(near):
            return
        # Only the block's bytes, so that what is made for each byte stays small.
        text, at = c.text[ranges(c.at, c.size)], np.cumsum(c.size) - c.size
        settled = method.earlier(text, at, c.size, rank)
        done = c.take(settled)
        yield from _done(c.docs[done.doc], done.lo, done.n)
        left = np.flatnonzero(~settled)
        left = left[_shared(c.anchor[left], rank[left])]
        of, w_at, w_size = method.windows(text, at[left], c.size[left], c.n[left])
        of, first = left[of], np.repeat(np.cumsum(c.n[left]) - c.n[left], c.n[left])
        lo = c.lo[of] + np.arange(len(of)) - first
        settled = np.flatnonzero(method.earlier(text, w_at, w_size, _rank(c.docs[c.doc[of]], lo, method.own)))
        yield from _done(c.docs[c.doc[of[settled]]], lo[settled], np.ones(len(settled), np.int64))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = []
        for batch in it:
            passed = []
            for _, doc_id, key, done, docs, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    passed.append({"doc_id": doc_id, "key": key, "done": done})
                else:
                    packets.append((docs, body))
            yield from batches(iter(passed), DONE)
        c = _received(packets)
        packets.clear()
        first, last = runs(c.anchor)
        total = np.concatenate([[0], np.cumsum(c.n)])

        def rows() -> Iterator[dict]:
            a = 0
            while a < len(first):
                b = int(np.searchsorted(total[last], total[first[a]] + AT_ONCE, side="right"))
                b = max(b, a + 1)
                yield from ({k: r[k] for k in DONE.names} for r in block(c.take(np.arange(first[a], last[b - 1]))))
                a = b

        yield from batches(rows(), DONE)

    return task


DONE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("done", pa.binary())])
DONE_SQL = "doc_id long, key long, done binary"


def whole_copies(texts: DataFrame) -> DataFrame:
    """doc_id and key of texts that a document with a smaller doc_id has as well."""
    light = usable_texts(texts).select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"))
    # Copies are counted in each task first; the join is one that AQE can split.
    firsts = light.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first")
    return materialize(light.join(firsts, "sha").filter("doc_id > first").select("doc_id", "key").distinct(), "copies")


def covered_windows(texts: DataFrame, method: Method, copies: DataFrame) -> DataFrame:
    """doc_id, key and ``done``: PLACED records of the windows that also start earlier; of copies, not all of them."""
    spark = texts.sparkSession
    parts = n_parts(texts)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((row for c in gathered(c for batch in it for c, _ in method.contexts(batch)) for row in _sent(c, method, parts)), SENT)

    usable = usable_texts(texts)
    # A packet's part is its task: the number of parts follows the input.
    sent = usable.select("doc_id", "key", "text").mapInArrow(send, SENT_SQL)
    settled = materialize(sent.repartitionById(parts, F.col("part")).mapInArrow(_owned(method.own, parts), SETTLED_SQL), "settled")
    most = settled.filter("done is null and asked is null").orderBy(F.col("key").desc(), "doc_id").limit(MAX_HOT)
    hot = np.unique(np.array([r.doc_id for r in most.select("doc_id").collect()], np.int64).view(U64))
    sent_hot = spark.sparkContext.broadcast(hot)
    # Asked anchors travel by part, and become rows of documents where all of a document's are together.
    packed = settled.filter("asked is not null").select("asked", "docs", F.col("doc_id").cast("int").alias("part")).repartitionById(parts, F.col("part"))
    asked = packed.select("asked", "docs").mapInArrow(_asked_of_docs, "doc_id long, key long, asked binary")

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[Contexts]:
            for batch in it:
                lists = batch.column(batch.schema.get_field_index("asked"))
                for c, of in method.contexts(batch):
                    mine = [np.frombuffer(lists[i].as_py(), ASKED) for i in of.tolist()]
                    asked_ = np.repeat(np.arange(len(mine)), [len(x) for x in mine]).astype(U64) << U64(32) | np.concatenate(mine)
                    c = c.take(np.isin((c.doc.astype(U64) << U64(32)) | (c.anchor & ANCHOR), asked_))
                    # Owners know an anchor by its part and its lower bits.
                    c.anchor = (c.anchor & ANCHOR) | ((c.anchor >> U64(32)) % U64(parts) << U64(32))
                    yield c

        yield from batches((row for c in gathered(wanted()) for row in _fetched(c, method, sent_hot.value, parts)), BYTES)

    # Copies have no part in it: the document with the smallest doc_id speaks for their text.
    asked = asked.join(copies.withColumn("copied", F.lit(True)), ["doc_id", "key"], "left").filter("copied is null").drop("copied")
    # The same exchange of the texts serves this join and the last one.
    fetched = texts.join(asked, ["doc_id", "key"], "left").filter("asked is not null").select("doc_id", "key", "text", "no_id", "asked").mapInArrow(fetch, BYTES_SQL)
    resolved = fetched.repartitionById(parts, F.col("part")).mapInArrow(_resolved(method), DONE_SQL)
    return settled.filter("done is not null").select("doc_id", "key", "done").unionByName(resolved)


def n_parts(texts: DataFrame) -> int:
    return n_shuffle(texts.sparkSession)


def usable_texts(texts: DataFrame) -> DataFrame:
    return texts.filter(~F.col("no_id"))


def with_covered(texts: DataFrame, covered: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id (null again where no_id), text, done (the list of its PLACED records) and copy (whether all its windows are covered) of every row of texts."""
    told = covered.select("doc_id", "key", "done", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "key", F.lit(None).cast("binary").alias("done"), F.lit(True).alias("copy")))
    by_doc = told.groupBy("doc_id", "key").agg(F.collect_list("done").alias("done"), F.max("copy").alias("copy"))
    return texts.join(by_doc, ["doc_id", "key"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "done", "copy")


def covered_units(lists: list[bytes] | None, copy: bool | None, n: int, width: int) -> np.ndarray:
    """Which of a document's n bytes or words lie in covered windows."""
    if copy:
        return np.full(n, n >= width)
    all_ = np.frombuffer(b"".join(lists or ()), PLACED)
    lo = all_["lo"].astype(np.int64)
    return run_mask(lo, lo + all_["n"] + width - 1, n) if len(lo) else np.zeros(n, bool)
