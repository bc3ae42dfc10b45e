"""Substring dedup by difference-cover anchors, over words.

With D = {0, 1, 3, 9} modulo 13, any two places have a common shift below 13
that brings both into D.  Hashing 8 words only at places in D therefore leaves
every pair of equal 20-word windows an aligned pair of anchors, inside both.
An anchor extends to the left and to the right as far as windows that hold it
reach; contexts that extend alike, and then the windows in the others, are
brought together by hash and compared byte by byte, on texts whose words are
joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import BYTE_CODES, U64, Chunk, chunks, prefix, ranges, runs, same_bytes, span_hash, string_bytes, words
from .repeats import MAX_WINDOWS, Contexts, Method, batches, covered_units, covered_windows, doc_records, keyed, span_hashes, whole_copies, with_covered

PERIOD = 13
#: A perfect difference set modulo PERIOD (fixed values).
COVER = (0, 1, 3, 9)
#: Bytes of text that are cut into contexts at once, but for a longer single text.
PIECE_BYTES = 2 << 20


def joined_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one space after each word, the words' starts and ends in it, and where each document's words begin and end in these."""
    starts, ends, bounds = words(chunk)
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    text[ranges(to, size)] = chunk.data[ranges(starts, size)]
    return text, to, to + size, bounds


def _contexts(width: int):
    length = width - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def of(batch: pa.RecordBatch) -> Iterator[tuple[Contexts, np.ndarray]]:
        docs = doc_records(batch)
        for chunk in chunks(batch.column(batch.schema.get_field_index("text")), PIECE_BYTES):
            text, starts, ends, bounds = joined_words(chunk)
            if len(starts) < width:
                continue
            count = np.diff(bounds)
            doc = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(starts)) - bounds[doc]
            use = np.flatnonzero(in_cover[place % PERIOD] & (place + length <= count[doc]) & (count[doc] >= width))
            doc, place = doc[use], place[use]
            pre = prefix(BYTE_CODES[text])
            anchor = span_hash(pre, starts[use], ends[use + length - 1])
            lo = np.maximum(place - (PERIOD - 1), 0)
            n = np.minimum(place, count[doc] - width) - lo + 1
            at = starts[bounds[doc] + lo]
            # Of a window's other words half are on one side of its anchor.
            half, end = (PERIOD - 1) // 2, lo + n + width - 1
            sides = []
            for beside, inside in ((use - half, place - half >= lo), (use + length, place + length + half <= end)):
                beside = np.where(inside, beside, 0)
                told = span_hash(pre, starts[beside], ends[np.minimum(beside + half - 1, len(ends) - 1)])
                sides.append(np.where(inside, told >> U64(56), U64(0)).astype(np.uint8))
            yield Contexts(docs[chunk.rows], text, anchor, doc, lo, n, at, ends[bounds[doc] + end - 1] - at, *sides), chunk.rows

    return of


def _windows(width: int):
    def of(text: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words end before spaces and where contexts end."""
        spaces = np.flatnonzero(text == 32)
        which = np.repeat(np.arange(len(n)), n)
        k = ranges(np.zeros(len(n), np.int64), n)
        first = np.searchsorted(spaces, at)  # the space after the context's first word
        start = np.where(k == 0, at[which], spaces[np.minimum(first[which] + k - 1, len(spaces) - 1)] + 1)
        end = np.where(k == n[which] - 1, (at + size)[which], spaces[np.minimum(first[which] + k + width - 1, len(spaces) - 1)])
        return which, start, end - start

    return of


def _earlier(text: np.ndarray, at: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings, of at least 8 bytes, some one of a smaller rank equals: those of one hash are compared with the first of them."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    hashes = span_hashes(text, at, size)
    order = np.lexsort((rank, hashes))
    while len(order):
        first, last = runs(hashes[order])
        to = np.repeat(order[first], last - first)
        equal = size[order] == size[to]
        equal[equal] = same_bytes(text, at[order[equal]], at[to[equal]], size[order[equal]])
        out[order] = equal & (rank[order] > rank[to])
        # Strings that only the hash of the first one equals are compared among themselves.
        order = order[~equal]
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def substring_dedup(docs: DataFrame, width: int = 20, with_kept: bool = True) -> DataFrame:
    """Remove every word that lies in a ``width``-word window which also starts earlier.

    Earlier: in a document with a smaller doc_id, or at a smaller place of the
    same document.  Words are runs of bytes other than ASCII white space.
    Returns doc_id, n_words, n_removed, kept_sha256 and, with with_kept, the
    kept words joined by one space.  Windows are judged on the input.

    Null or empty text: no words.  A null doc_id: the text is returned whole
    and is nobody's earlier copy.  Rows that repeat a doc_id are one document:
    equal rows get equal results.  Other columns of docs are left out.  One
    task holds a text, with some 100 bytes for each of its words and bytes.
    """
    if not PERIOD < width < MAX_WINDOWS:
        raise ValueError(f"width must be over {PERIOD} and below {MAX_WINDOWS}")
    texts = keyed(docs)
    copies = whole_copies(texts)
    covered = covered_windows(texts, Method(_contexts(width), _windows(width), _earlier, own=True), copies)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in it:
                ids = batch.column(0).to_pylist()
                data, offsets = string_bytes(batch.column(1))
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    text, starts, ends, _ = joined_words(Chunk(raw, np.zeros(1, np.int64), np.array([len(raw)]), np.zeros(1, np.int64)))
                    gone = covered_units(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), len(starts), width)
                    # Each kept word with the space after it, but for the last one's.
                    kept = text[ranges(starts[~gone], ends[~gone] - starts[~gone] + 1)[:-1]].tobytes()
                    yield {"doc_id": ids[i], "n_words": len(starts), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept.decode("utf-8", "replace")} if with_kept else {})

        yield from batches(rows(), RESULT if with_kept else pa.schema(list(RESULT)[:-1]))

    return with_covered(texts, covered, copies).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept)
