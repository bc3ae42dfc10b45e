"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark is the stated query set.  It is read in blocks of a bounded size;
tasks build a block's automaton once, as flat arrays, and all documents stream
through them.  Only runs of words whose neighbours stand side by side in some
item can match, so these are walked, all runs of a piece of text at a time; at
each word the automaton knows the longest match that ends there.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, U64, chunks, ranges, run_mask, runs, string_bytes, word_codes, words
from .repeats import batches
from .shared import by_place, materialize, place_of

#: Bytes of benchmark text in one block; a longer single item has one of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of automata that tasks hold at once; with more, documents stream through several times.
HELD_BYTES = 128 << 20
#: Words of a run that are walked at once, besides the overlap with the piece before.
RUN_TOKENS = 256
SPAN = np.dtype([("lo", "<u4"), ("hi", "<u4")])


class Automaton:
    """The suffix automaton of several token sequences, with the items that own its windows.

    A window is ``width`` consecutive tokens of an item; a shorter item is one window.
    """

    def __init__(self, items: list[tuple[int, list[int]]], width: int) -> None:
        self.next, self.link, self.len = [{}], [-1], [0]
        for _, tokens in items:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        #: (state, length of the window, item)
        self.owners: set[tuple[int, int, int]] = set()
        for item, tokens in items:
            state = 0
            for i, t in enumerate(tokens):
                state = self.next[state][t]
                if i + 1 >= width:
                    self.owners.add((self._holding(state, width), width, item))
            if len(tokens) < width:
                self.owners.add((self._holding(state, len(tokens)), len(tokens), item))

    def _add(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, t: int) -> int:
        """The state for p's strings followed by t, alone."""
        q = self.next[p][t]
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            return self._split(last, t)
        new = self._add(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, t)
        return new

    def _holding(self, state: int, length: int) -> int:
        """The state that holds the suffix of so many tokens of a state's string."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state


def build_block(items: list[tuple[str, bytes]], width: int) -> bytes | None:
    """The automaton of some items as flat arrays; null if no item has a word."""
    sequences: list[np.ndarray] = []
    for chunk in chunks(pa.array([t for _, t in items], pa.large_binary()), 1 << 40):
        starts, ends, bounds = words(chunk, ALNUM)
        codes = word_codes(chunk, starts, ends, lower=True)
        sequences += [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, U64)
    if not len(vocabulary):
        return None
    names = sorted({name for name, _ in items})
    tokens = [np.searchsorted(vocabulary, s) for s in sequences]
    number = {name: k for k, name in enumerate(names)}
    a = Automaton([(number[name], t.tolist()) for (name, _), t in zip(items, tokens, strict=True) if len(t)], width)
    edges = np.array(sorted((state << 32 | t, to) for state, own in enumerate(a.next) for t, to in own.items()), np.int64).reshape(-1, 2)
    owners = np.array(sorted(a.owners), np.int64).reshape(-1, 3)
    # Short items end states; whether a state or one of its suffixes is such an end.
    short = np.zeros(len(a.len), bool)
    short[owners[owners[:, 1] < width, 0]] = True
    link = np.array(a.link, np.int32)
    for state in np.argsort(a.len, kind="stable")[1:].tolist():
        short[state] |= short[link[state]]
    pairs = np.unique(np.concatenate([t[:-1] << 32 | t[1:] for t in tokens]))
    least = min([width, *(len(t) for t in tokens if len(t))])
    arrays = {"vocabulary": vocabulary, "pairs": pairs, "keys": edges[:, 0], "to": edges[:, 1].astype(np.int32), "link": link, "len": np.array(a.len, np.int32), "owners": owners, "short": short}
    out = io.BytesIO()
    np.savez(out, **arrays, names=np.frombuffer(json.dumps(names).encode(), np.uint8), least=np.array([least, width]))
    return out.getvalue()


class Block:
    """A block's automaton, read from its flat arrays."""

    def __init__(self, body: bytes) -> None:
        held = np.load(io.BytesIO(body))
        self.vocabulary, self.pairs, self.keys, self.to, self.link, self.len, self.owners, self.short = (held[k] for k in ("vocabulary", "pairs", "keys", "to", "link", "len", "owners", "short"))
        self.names = json.loads(held["names"].tobytes())
        self.least, self.width = held["least"].tolist()
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary & U64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words that may match: tokens laid end to end, where each run begins in them, and in the text."""
        maybe = np.flatnonzero(self.known[(codes & U64((1 << 20) - 1)).astype(np.int64)])
        token = np.searchsorted(self.vocabulary, codes[maybe])
        sure = self.vocabulary[np.minimum(token, len(self.vocabulary) - 1)] == codes[maybe]
        maybe, token = maybe[sure], token[sure]
        if not len(maybe):
            return token, np.zeros(1, np.int64), maybe
        # A run goes on while two words are neighbours in their document and in some item.
        on = (np.diff(maybe) == 1) & ~np.isin(maybe[1:], bounds)
        near = np.flatnonzero(on)
        on[near] = np.isin(token[near] << 32 | token[near + 1], self.pairs)
        first = np.flatnonzero(np.concatenate([[True], ~on]))
        size = np.diff(np.append(first, len(maybe)))
        long = size >= self.least
        first, size = first[long], size[long]
        return token[ranges(first, size)], np.concatenate([[0], np.cumsum(size)]), maybe[first]

    def longest(self, token: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each token of the runs, the state of a match that ends there, and its length.

        It is the longest match, or in long runs at least as much of it as a window may have.
        """
        states, lengths = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
        # Long runs are walked in pieces side by side; each begins early enough for any window that ends in it.
        n_pieces = -(-np.diff(start) // RUN_TOKENS)
        run = np.repeat(np.arange(len(n_pieces)), n_pieces)
        own = start[run] + ranges(np.zeros(len(n_pieces), np.int64), n_pieces) * RUN_TOKENS
        begin = np.maximum(start[run], own - (self.width - 1))
        size = np.minimum(own + RUN_TOKENS, start[run + 1]) - begin
        order = np.argsort(-size, kind="stable")
        begin, size, own = begin[order], size[order], own[order]
        state, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k, side="left"))  # the longest runs come first
            t = token[begin[:n] + k]
            going = np.arange(n)
            while len(going):
                key = state[going] << 32 | t[going]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                found = going[hit]
                state[found], length[found] = self.to[at[hit]], length[found] + 1
                lost = going[~hit]
                length[lost[state[lost] == 0]] = 0
                going = lost[state[lost] > 0]
                state[going] = self.link[state[going]]
                length[going] = self.len[state[going]]
            place = begin[:n] + k
            mine = place >= own[:n]
            states[place[mine]], lengths[place[mine]] = state[:n][mine], length[:n][mine]
        return states, lengths

    def windows(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows: the place of the last token, the window's length, and the rows of owners as (first, end) of (state, length)."""
        at = np.flatnonzero((lengths >= self.width) | self.short[states])
        state = states[at]
        places, sizes, own = [], [], []
        # From a match to its suffixes, as far as one may be a window.
        while len(at):
            first, last = np.searchsorted(self.owners[:, 0], state), np.searchsorted(self.owners[:, 0], state, side="right")
            some = last > first
            which = np.repeat(np.flatnonzero(some), (last - first)[some])
            row = ranges(first[some], (last - first)[some])
            fits = self.owners[row, 1] <= lengths[at[which]]
            places.append(at[which[fits]])
            sizes.append(self.owners[row[fits], 1])
            own.append(self.owners[row[fits], 2])
            state = self.link[state]
            on = (state > 0) & ((self.len[np.maximum(state, 0)] >= self.width) | self.short[np.maximum(state, 0)])
            at, state = at[on], state[on]
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *places]), np.concatenate([empty, *sizes]), np.concatenate([empty, *own])

    def hits(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """Documents with occurrences: index, SPAN records in words of the document, items."""
        token, start, begin = self.candidates(codes, bounds)
        if not len(begin):
            return
        place, size, own = self.windows(*self.longest(token, start))
        run = np.searchsorted(start, place, side="right") - 1
        end = begin[run] + place - start[run] + 1
        doc = np.searchsorted(bounds, end - 1, side="right") - 1
        order = np.argsort(doc, kind="stable")
        for a, b in zip(*runs(doc[order]), strict=True):
            pick, d = order[a:b], int(doc[order[a]])
            spans = np.zeros(b - a, SPAN)
            spans["lo"], spans["hi"] = end[pick] - size[pick] - bounds[d], end[pick] - bounds[d]
            yield d, np.unique(spans), {self.names[k] for k in np.unique(own[pick]).tolist()}


def build_blocks(benchmark: DataFrame, width: int) -> DataFrame:
    """size and body of each block's automaton, of item_id and text, built in tasks and written."""
    n_bytes = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    dealt = benchmark.select(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int").alias("block"), "item_id", "text").repartition(n_blocks, "block").sortWithinPartitions("block", "item_id")

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            held: list[tuple[str, bytes]] = []
            now = None
            for batch in it:
                for block, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != now:
                        yield from done(held)
                        now, held = block, []
                    held.append((item, text.encode("utf-8", "replace")))
            yield from done(held)

        def done(held: list[tuple[str, bytes]]) -> Iterator[dict]:
            body = build_block(held, width)
            if body is not None:
                yield {"size": len(body), "body": body}

        yield from batches(rows(), pa.schema([("size", pa.int64()), ("body", pa.binary())]))

    return materialize(dealt.mapInArrow(task, "size long, body binary"), "automata")


RESULTS = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("cleaned", T.StringType()), ("dropped", T.BooleanType()))


def _broadcast(docs: DataFrame, bodies: list[bytes]):
    """A pass's automata, of HELD_BYTES or one block."""
    return docs.sparkSession.sparkContext.broadcast(bodies)


#: The automata that a worker has read from the last broadcast it used.
_LOADED: dict[str, list] = {}


def _loaded(bodies: list[bytes]) -> list[Block]:
    """The automata of a broadcast, read once by each worker."""
    if _LOADED.get("bodies") is not bodies:
        _LOADED.update(bodies=bodies, blocks=[Block(body) for body in bodies])
    return _LOADED["blocks"]


def _pass(sent, place: int, last: tuple[int, float] | None):
    """Batches through the automata of a pass; the last two columns are the spans and items so far.

    The last pass replaces them by the results; last: min_span and max_coverage.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _loaded(sent.value)
        for batch in it:
            spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            n_words = np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(place)):
                starts, ends, bounds = words(chunk, ALNUM)
                n_words[chunk.rows] = np.diff(bounds)
                codes = word_codes(chunk, starts, ends, lower=True)
                for block in blocks:
                    for d, found, names in block.hits(codes, bounds[:-1]):
                        row = int(chunk.rows[d])
                        spans[row] = (spans[row] or b"") + found.tobytes()
                        items[row] = sorted(names.union(items[row] or ()))
            columns, names = batch.columns[:-2], batch.schema.names[:-2]
            if last is None:
                columns += [pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                continue
            values = _judged(batch.column(place), n_words, spans, [x or [] for x in items], *last)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names + [n for n, _ in RESULTS])

    return task


def _judged(column: pa.Array, n_words: np.ndarray, spans: list, items: list[list[str]], min_span: int, max_coverage: float) -> tuple:
    """The values of RESULTS."""
    data, offsets = string_bytes(column)
    n_hit = np.zeros(len(n_words), np.int64)
    cleaned = column.to_pylist()
    for i, held in enumerate(spans):
        if held:
            s = np.frombuffer(held, SPAN)
            hit = run_mask(s["lo"].astype(np.int64), s["hi"].astype(np.int64), int(n_words[i]))
            n_hit[i] = hit.sum()
            cleaned[i] = _cut(data[offsets[i] : offsets[i + 1]], hit, min_span)
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return n_words, n_hit, [len(x) for x in items], items, digest, n_hit > 0, cleaned, n_hit > max_coverage * n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """Find and cut what documents share with benchmark items.

    Words are runs of ASCII letters and digits and of non-ASCII characters, with
    A-Z lower-cased.  A window is ``width`` consecutive words of an item; an
    item of fewer words, but not none, is one window.  A document's word inside
    an occurrence of a window is hit.

    Returns the columns of docs and n_words, n_hit, n_items, items (ids as
    strings, sorted), items_sha256 (of them, comma-joined), contaminated
    (n_hit > 0), cleaned (the text without the hit runs of at least
    ``min_span`` words) and dropped (over ``max_coverage`` of the words are
    hit).  Columns of docs with these names, in any case, are replaced, and all
    others stay.

    Null or empty texts have no words and are never hit; items without words
    or with a null id never match.  Repeated rows are judged one by one; items
    with one id count as one.  An empty benchmark leaves all documents clean.
    A text, with some 20 bytes for each of its words, is held by one task; runs of
    words that items know are walked in pieces of RUN_TOKENS.
    """
    plain, back = by_place(docs, [n for n, _ in RESULTS])
    place = place_of(docs, "text")
    flow = plain.withColumns({f"_{place}": F.col(f"_{place}").cast("string"), "spans": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    used = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = build_blocks(used, width)
    groups: list[list[bytes]] = [[]]
    for row in blocks.select("body").toLocalIterator():
        if groups[-1] and sum(map(len, groups[-1])) + len(row.body) > HELD_BYTES:
            flow = materialize(flow.mapInArrow(_pass(_broadcast(docs, groups[-1]), place, None), flow.schema), "passed")
            groups[-1] = []
        groups[-1].append(bytes(row.body))
    schema = flow.drop("spans", "items").schema
    for name, kind in RESULTS:
        schema = schema.add(name, kind)
    judged = flow.mapInArrow(_pass(_broadcast(docs, groups[-1]), place, (min_span, max_coverage)), schema)
    return judged.select(*back, *[n for n, _ in RESULTS])


def _cut(text: np.ndarray, hit: np.ndarray, min_span: int) -> str:
    """The text without the runs of at least min_span hit words, from the first word's start to the last one's end."""
    for chunk in chunks(pa.array([text.tobytes()], pa.large_binary()), 1 << 40):
        starts, ends, _ = words(chunk, ALNUM)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    use = hi - lo >= min_span
    keep = ~run_mask(starts[lo[use]], ends[hi[use] - 1], len(text)) if use.any() else np.ones(len(text), bool)
    return text[keep].tobytes().decode("utf-8", "replace")
