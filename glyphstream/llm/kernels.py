"""Vectorised helpers over the bytes of many texts at once.

Tasks see Arrow batches.  A batch is cut into chunks of a few megabytes, so a
task's memory is bounded whatever the size of its partition; only a single
document longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODES = _seeded(256, 17)
_BASE = int(_seeded(1, 99)[0]) | 1
_INV = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, made as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _INV))
        return self.up, self.down


POWERS = _Powers()


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`span_hash` over an array of 64-bit codes."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * POWERS.to(len(codes))[0][: len(codes)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the code spans [lo, hi); equal spans hash equally."""
    down = POWERS.to(len(pre) + 1)[1]
    return mix((pre[hi] - pre[lo]) * down[lo] + (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


class Chunk:
    """Some documents' bytes laid end to end.

    data: uint8; start, end: where each document lies; rows: their places in
    the Arrow batch.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> None:
        self.data, self.start, self.end, self.rows = data, start, end, rows


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents."""
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        base = offsets[first]
        yield Chunk(data[base : offsets[last]], offsets[first:last] - base, offsets[first + 1 : last + 1] - base, np.arange(first, last))
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that holds for the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
LETTERS = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII letters of either case, digits and bytes of non-ASCII characters.
ALNUM = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))[LOWER]


def words(chunk: Chunk, member: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes, never across documents.

    Returns their starts, their ends, and where each document's words begin
    and end in these arrays (length: documents + 1).
    """
    inside = np.zeros(len(chunk.data) + 2, np.int8)
    inside[1:-1] = member[chunk.data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A document's end also ends a word that touches the next document.
    full = chunk.end > chunk.start
    cuts = chunk.start[full]
    cuts = cuts[(cuts > 0) & (cuts < len(chunk.data))]
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    bounds = np.searchsorted(starts, np.append(chunk.start, len(chunk.data)))
    return starts, ends, bounds


def word_codes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z."""
    data = LOWER[chunk.data] if lower else chunk.data
    return span_hash(prefix(BYTE_CODES[data]), starts, ends)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)[: len(first)]


def run_mask(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans [lo, hi)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(lo, n), 1)
    np.add.at(edge, np.minimum(hi, n), -1)
    return np.cumsum(edge[:-1]) > 0


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then those of lo[1], and so on."""
    n = np.asarray(n, np.int64)
    total = int(n.sum())
    first = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) - np.repeat(first, n) + np.repeat(np.asarray(lo, np.int64), n)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at a equal those at b, eight at a time."""
    eight = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,)) if len(text) > 7 else np.zeros(0, U64)
    out = np.ones(len(a), bool)
    for some in np.array_split(np.arange(len(a)), max(1, int(size.sum()) // (16 << 20))):
        n = -(-size[some] // 8)
        # The last eight bytes overlap those before them.
        step = np.minimum(8 * ranges(np.zeros(len(n), np.int64), n), np.repeat(size[some] - 8, n))
        equal = eight[np.repeat(a[some], n) + step] == eight[np.repeat(b[some], n) + step]
        if len(equal):
            out[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out
