"""Suffix-array dedup: remove byte strings that an earlier document already has.

Suffixes are dealt to tasks by the minimum hash of the short strings that lie
in their first ``width`` bytes, so equal ones always meet (see ``repeats``).
Each task puts its suffixes into suffix order, as far as the strings it asks
about reach, works out the longest common prefixes of neighbours, and from the
previous and next smaller positions (the nearest suffixes in that order which
belong to an earlier document) each suffix's longest previous factor.  What is
as long as the string asked about is a later copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import U64, chunks, mix, ranges, run_mask, runs, same_bytes, string_bytes
from .repeats import MAX_WINDOWS, Contexts, Method, batches, covered_units, covered_windows, doc_records, keyed, span_hashes, whole_copies, with_covered

GRAM = 16
#: Bytes of text that are cut into contexts at once; a longer text is cut piece by piece.
PIECE_BYTES = 1 << 20
#: Bytes of suffixes that are put into order at once.
ORDER_BYTES = 4 << 20
#: Windows of one context at most.
CONTEXT_WINDOWS = 4096
_PLACE = U64((1 << 31) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", raw, strides=(1,)).astype(U64)
    return mix(eight[:n] * U64(0x9E3779B97F4A7C15) + (eight[8 : 8 + n] ^ (eight[8 : 8 + n] >> U64(29))) * U64(0xC2B2AE3D27D4EB4F))


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window, the place of its least gram, the first one on a tie."""
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (least & _PLACE).astype(np.int64)


def _contexts(width: int):
    per_window = width - GRAM + 1

    def of(batch: pa.RecordBatch) -> Iterator[tuple[Contexts, np.ndarray]]:
        docs = doc_records(batch)
        for chunk in chunks(batch.column(batch.schema.get_field_index("text")), PIECE_BYTES):
            # Windows that begin in a piece, and the bytes of the last one.
            for begin in range(0, max(1, len(chunk.data) - width + 1), PIECE_BYTES):
                data = chunk.data[begin : begin + PIECE_BYTES + width - 1]
                if len(data) >= width:
                    yield from piece(docs[chunk.rows], data, chunk.start - begin, chunk.end - begin, chunk.rows)

    def piece(docs: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> Iterator[tuple[Contexts, np.ndarray]]:
        grams = _grams(data)
        at = _window_minima(grams, per_window)
        valid = np.flatnonzero(run_mask(np.clip(start, 0, len(at)), np.clip(end - width + 1, np.maximum(start, 0), len(at)), len(at)))
        if not len(valid):
            return
        at = at[valid]
        first, last = runs(at)
        lo, n, at = valid[first], last - first, at[first]
        doc = np.searchsorted(start, lo, side="right") - 1
        size = n + width - 1
        # Of a window's other bytes half at least are on one side of its anchor.
        sides = []
        for beside, inside in ((at - GRAM, at - GRAM >= lo), (at + GRAM, at + 2 * GRAM <= lo + size)):
            told = inside & (width >= 3 * GRAM)
            sides.append(np.where(told, grams[np.where(told, beside, 0)] >> U64(56), U64(0)).astype(np.uint8))
        # In repeated bytes neighbours have one anchor hash and the same beside it: they are one context.
        first, _ = runs(grams[at], doc, *sides, lo - np.append(0, np.cumsum(n)[:-1]))
        within = lo - np.repeat(lo[first], np.diff(np.append(first, len(lo))))
        new = within // CONTEXT_WINDOWS != np.append(-1, within[:-1] // CONTEXT_WINDOWS)
        new[first] = True
        first = np.flatnonzero(new)
        lo, n, at, doc, sides = lo[first], np.add.reduceat(n, first), at[first], doc[first], [x[first] for x in sides]
        yield Contexts(docs, data, grams[at], doc, lo - start[doc], n, lo, n + width - 1, *sides), rows

    return of


def _windows(width: int):
    def of(text: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A context of one window's size is that window, n times beside itself."""
        which = np.repeat(np.arange(len(n)), n)
        return which, at[which] + np.where(size[which] == width, 0, ranges(np.zeros(len(n), np.int64), n)), np.full(len(which), width)

    return of


def suffix_order(text: np.ndarray, at: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the given places in lexicographic order, each ending after size bytes, and the common prefix of each with the one before it.

    Equal ones are ordered by rank.
    """
    n, reach = len(at), int(size.max(initial=0))
    # A suffix's bytes, zeros beyond its end, and its size, which tells zeros of the text from those.
    table = np.zeros((n, reach + 4), np.uint8)
    table[np.repeat(np.arange(n), size), ranges(np.zeros(n, np.int64), size)] = text[ranges(at, size)]
    table[:, reach:] = size.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(table.view(f"S{reach + 4}").ravel())
    table = table[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
    common = np.concatenate([[0], np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))])
    class_ = np.cumsum(np.concatenate([[True], differ.any(axis=1)]))
    return order[np.lexsort((rank[order], class_))], common


def _to_smaller(rank: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place, the longest common prefix with the nearest place before it that has a smaller rank.

    Places between two have no smaller rank than the later one, so pointers to
    candidates can be followed from candidate to candidate, all at once.
    common: with the place before.  Prefixes below least count as none, so
    nothing needs to be followed beyond one.
    """
    to, low = np.arange(-1, len(rank) - 1), common.copy()
    going = np.flatnonzero((to >= 0) & (rank[to] >= rank))
    while len(going):
        by = to[going]
        low[going] = np.minimum(low[going], low[by])
        to[going] = to[by]
        going = going[(to[going] >= 0) & (low[going] >= least) & (rank[to[going]] >= rank[going])]
    return np.where((to >= 0) & (rank[to] < rank) & (low >= least), low, 0)


def previous_factors(text: np.ndarray, at: np.ndarray, size: np.ndarray, rank: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix: its longest prefix, of at most size bytes, that some suffix of a smaller rank begins with.

    Factors below least bytes count as none.
    """
    order, common = suffix_order(text, at, size, rank)
    ranks = rank[order]
    before = _to_smaller(ranks, common, least)
    after = _to_smaller(ranks[::-1], np.concatenate([[0], common[1:][::-1]]), least)[::-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _earlier(text: np.ndarray, at: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings some one of a smaller rank equals.

    Equal strings of one rank are the same case and enter the order once.  A
    string whose hash no other has cannot be equal to one; the others are taken
    some megabytes at a time, equal hashes together.
    """
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    hashes = span_hashes(text, at, size)
    order = np.lexsort((rank, hashes))
    first, last = runs(hashes[order], rank[order])
    to = np.repeat(order[first], last - first)
    alike = (order != to) & (size[order] == size[to])
    alike[alike] = same_bytes(text, at[order[alike]], at[to[alike]], size[order[alike]])
    same, to, order = order[alike], to[alike], order[~alike]
    first, last = runs(hashes[order])
    twice = last - first > 1
    first, last = first[twice], last[twice]
    total = np.concatenate([[0], np.cumsum(size[order])])
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total[last], total[first[a]] + ORDER_BYTES, side="right")))
        pick = order[ranges(first[a:b], last[a:b] - first[a:b])]
        for part in _parts(text, at, size, pick):
            out[part] |= previous_factors(text, at[part], size[part], rank[part], int(size[part].min())) >= size[part]
        a = b
    out[same] = out[to]
    return out


def _parts(text: np.ndarray, at: np.ndarray, size: np.ndarray, pick: np.ndarray) -> Iterator[np.ndarray]:
    """pick as it is, or, if its strings are too many for one order, in parts that all hold the first of those that it equals."""
    while len(pick):
        if int(size[pick].sum()) <= 2 * ORDER_BYTES:
            yield pick
            return
        equal = size[pick] == size[pick[0]]
        equal[equal] = same_bytes(text, at[pick[equal]], np.full(int(equal.sum()), at[pick[0]]), size[pick[equal]])
        rest = pick[equal][1:]
        step = max(1, ORDER_BYTES // int(size[pick[0]]))
        for k in range(0, len(rest), step):
            yield np.append(pick[0], rest[k : k + step])
        pick = pick[~equal]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def suffix_array_dedup(docs: DataFrame, width: int = 50, with_kept: bool = True) -> DataFrame:
    """Remove every byte that lies in a ``width``-byte string which also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with with_kept, the kept bytes (cutting may split a
    character, so they are binary).  Strings are judged on the input.

    Null or empty text: zero bytes, nothing removed.  A null doc_id: the text
    is returned whole and is nobody's earlier copy.  Rows that repeat a doc_id
    do not remove each other's bytes and each gets its own result row.  Texts
    shorter than width keep all bytes.  Other columns of docs are left out.
    One task holds a text; beside it, some 100 bytes for each byte of a
    megabyte of text, and for each context of 12 MB of texts, which hold up to
    CONTEXT_WINDOWS windows where bytes repeat.
    """
    if not GRAM < width < MAX_WINDOWS:
        raise ValueError(f"width must be over {GRAM} and below {MAX_WINDOWS}")
    texts = keyed(docs)
    copies = whole_copies(texts)
    covered = covered_windows(texts, Method(_contexts(width), _windows(width), _earlier, own=False), copies)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in it:
                ids = batch.column(0).to_pylist()
                data, offsets = string_bytes(batch.column(1))
                for i in range(batch.num_rows):
                    text = data[offsets[i] : offsets[i + 1]]
                    gone = covered_units(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), len(text), width)
                    kept = text[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                    yield {"doc_id": ids[i], "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if with_kept else {})

        yield from batches(rows(), RESULT if with_kept else pa.schema(list(RESULT)[:-1]))

    return with_covered(texts, covered, copies).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
