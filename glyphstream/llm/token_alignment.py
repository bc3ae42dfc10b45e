"""Alignment of two tokenizers: which tokens of one cover which of the other, and how often over the corpus.

A text is a space and the document's text.  Neither tokenizer joins what lies on
both sides of a single space before a word, so what lies between such spaces, a
chunk, is aligned once and remembered.  In a chunk the character offsets of the
byte-level tokenizer and the byte spans of the piece tokenizer's proto give
coarse cuts, the places where tokens of both end.  Where characters of several
bytes or byte pieces stand between two coarse cuts, the places inside are told
by the decoded bytes of the tokens.

Counts of linked ids are summed over the corpus.  Documents are dealt into parts
of some megabytes; a part asks once for each pair of ids that it has, and the
answers come back to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes of text whose pairs of ids are asked for at once.
PART_BYTES = 8 << 20
#: Chunks remembered before a generation of them ends; longer ones than LONG characters are not remembered.
MAX_CACHE, LONG = 400_000, 64
#: A space that begins a chunk has no space before it and no white space after it.
_CHUNK = re.compile(r"(?<! ) (?=\S)")
_BLANK_AFTER = re.compile(r" \s")
_PAIRS: dict[tuple[str, str], Aligner] = {}


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """The two tokenizers, the bytes of their tokens, and the chunks seen."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = _byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 32:
            raise ValueError("pairs of ids must fit into 32 bits")
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes))):
            raise ValueError("pieces must not go beyond a space")
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a space and text, each without its first space."""
        whole = " " + text
        if whole[-1] != " " and not _BLANK_AFTER.search(whole):
            return whole[1:].split(" ")
        cut = _CHUNK.split(whole)
        return cut[1:] if cut[0] == "" else [cut[0][1:], *cut[1:]]

    def aligned(self, texts: list[str]) -> Iterator[list[tuple] | None]:
        """Each text's aligned chunks, as (links, groups, sizes); None if the tokens do not give its bytes back."""
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.young) > MAX_CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        asked = set().union(*split).difference(young)
        young.update([(c, old[c]) for c in asked if c in old])
        new = [c for c in asked if c not in young]
        once = {}
        plain = []
        for c in new:
            if len(c) > LONG or not c or c[0].isspace() or c[-1].isspace():
                once[c] = self._align([c])[0]
            else:
                plain.append(c)
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            young.update(zip(some, self._align(some), strict=True))
        get = (young | once if once else young).__getitem__
        for chunks in split:
            found = list(map(get, chunks))
            yield found if found and None not in found else None

    def _align(self, chunks: list[str]) -> list[tuple | None]:
        """Chunks that may stand beside each other, aligned as one text."""
        text = "".join([" " + c for c in chunks])
        raw = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        a = np.array(coded.ids, np.int64)
        b, begin, end = np.array([(p.id, p.begin, p.end) for p in self.b.encode_as_proto(text[1:]).pieces], np.int64).reshape(-1, 3).T
        ends = np.cumsum([1 + len(c.encode()) for c in chunks])
        joined = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
        if joined:
            # Characters and bytes, from the start and by place.
            starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            byte_of = np.append(starts, len(raw))
            rough_a = byte_of[np.array([e for _, e in coded.offsets], np.int64)]
            # The first bytes of a character have empty spans; they end with it, as in the other tokenizer.
            rough_b = end[np.minimum.accumulate(np.where(end > begin, np.arange(len(end)), len(end) - 1)[::-1])[::-1]] + 1
            wide = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) >= 0x80))
            a_ends, b_ends = self._refined(rough_a, rough_b, a, b, wide)
            joined = len(_shared(ends, _shared(a_ends, b_ends))) == len(ends)
        if not joined:
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2
            return self._align(chunks[:half]) + self._align(chunks[half:])
        # Between two neighbouring ends of either kind lies one token of each: a link.
        every = _merged(a_ends, b_ends)
        codes = (a[np.searchsorted(a_ends, every)] * len(self.b_bytes) + b[np.searchsorted(b_ends, every)]).astype("<u4").tobytes()
        both = _shared(a_ends, b_ends)
        to_a, to_b = (np.searchsorted(x, both, side="right").tolist() for x in (a_ends, b_ends))
        names_a, names_b = (list(map(self.names.__getitem__, x.tolist())) for x in (a, b))
        groups, i, j = [], 0, 0
        for k, m in zip(to_a, to_b, strict=True):
            groups.append(f"{names_a[i]}|{names_b[j]}" if k == i + 1 and m == j + 1 else f"{','.join(names_a[i:k])}|{','.join(names_b[j:m])}")
            i, j = k, m
        out, before = [], (0, 0, 0, 0)
        for now in zip(*(np.searchsorted(x, ends, side="right").tolist() for x in (every, both, a_ends, b_ends)), strict=True):
            (l0, g0, a0, b0), (l1, g1, a1, b1) = before, now
            out.append((codes[4 * l0 : 4 * l1], ";".join(groups[g0:g1]), (a1 - a0) | (b1 - b0) << 42 | (g1 - g0) << 84))
            before = now
        return out

    def _refined(self, rough_a: np.ndarray, rough_b: np.ndarray, a: np.ndarray, b: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes at which tokens end, from those of their spans: what lies between two coarse cuts is told by decoded bytes where spans cannot tell."""
        cuts = _shared(_distinct(rough_a), _distinct(rough_b))
        out = []
        for rough, ids, table in ((rough_a, a, self.a_sizes), (rough_b, b, self.b_sizes)):
            size = table[ids]
            # A coarse cut belongs to the last token whose span ends there.
            last = np.searchsorted(rough, cuts, side="right")
            first = np.append(0, last[:-1])
            between = np.repeat(np.arange(len(cuts)), last - first)
            low = np.append(0, cuts)[between]
            told = np.cumsum(size)
            inside = told - np.append(0, told)[first][between]
            alike = np.append(0, np.cumsum(rough[1:] == rough[:-1]))
            spread = (wide[cuts] > wide[np.append(0, cuts[:-1])]) | (alike[last - 1] > alike[first])
            out.append(np.where(spread[between], low + inside, rough))
        return out[0], out[1]


def _distinct(x: np.ndarray) -> np.ndarray:
    """A sorted array's distinct values."""
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What two ascending arrays have in common."""
    if not len(y):
        return x[:0]
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x]


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What either of two ascending arrays has."""
    return _distinct(np.sort(np.concatenate([x, y]), kind="stable"))


def _aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _PAIRS:
        _PAIRS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _PAIRS[byte_level, pieces]


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places as steps, and counts, byte by byte of equal weight, compressed."""
    steps = np.diff(places, prepend=0)
    both = np.concatenate([steps, counts]).astype("<u4")
    planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


ALIGNED = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("links", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary()), ("groups", pa.string())])
_ALIGNED_SQL = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, links binary, codes binary, counts binary, groups string"
_LOW = (1 << 42) - 1


def align_documents(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False) -> DataFrame:
    """A row per document: its digests, and its pairs of ids as places in the list of its part; and a row per part: the list (codes) and how often each pair is linked in it.

    A code is the byte-level id times the number of pieces plus the piece's id.
    Written to the shared folder.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(byte_level, pieces)
        part, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part, held, size
            seen = [codes for *_, codes, _ in held if codes is not None]
            listed, counts = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True) if seen else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            total = np.bincount(counts, np.concatenate([n for _, n in seen]) if seen else None, len(listed)).astype("<u8")
            rows, at = [], 0
            for told, codes, groups in held:
                links = None
                if codes is not None:
                    links = _packed(counts[at : at + len(codes[0])], codes[1])
                    at += len(codes[0])
                rows.append((part, *told, len(codes[0]) if codes is not None else 0, links, None, None, groups))
            rows.append((part, *[None] * 6, len(listed), None, listed.astype("<u4").tobytes(), total.tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ALIGNED, strict=True)], schema=ALIGNED)
            part, held, size = part + 1, [], 0

        for batch in it:
            first = 0
            while first < batch.num_rows:
                # As many texts at once as make a megabyte, or one.
                texts, weight = [], 0
                while first + len(texts) < batch.num_rows and (not texts or (weight < 1 << 20 and len(texts) < 500)):
                    texts.append(batch.column(1)[first + len(texts)].as_py() or "")
                    weight += len(texts[-1])
                for k, (text, found) in enumerate(zip(texts, align.aligned(texts), strict=True)):
                    doc_id = batch.column(0)[first + k].as_py()
                    if found is None:
                        held.append(((doc_id, 0, 0, 0, 0, ""), None, "" if with_groups else None))
                    else:
                        codes = np.unique(np.frombuffer(b"".join([x[0] for x in found]), "<u4"), return_counts=True)
                        groups = ";".join([x[1] for x in found])
                        sizes = sum([x[2] for x in found])
                        told = (doc_id, sizes & _LOW, sizes >> 42 & _LOW, sizes >> 84, int(codes[1].sum()), hashlib.sha256(groups.encode()).hexdigest())
                        held.append((told, codes, groups if with_groups else None))
                    size += len(text)
                    if size >= PART_BYTES:
                        yield from flush()
                first += len(texts)
        if held:
            yield from flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(task, _ALIGNED_SQL), "aligned")


_ASK = pa.schema([("part", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])


def _asked(aligned: DataFrame) -> DataFrame:
    """part, code, n: how often a part links each of its pairs of ids."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                code = np.frombuffer(codes, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), part)), pa.array(code), pa.array(np.frombuffer(counts, "<u8").astype(np.int64))], schema=_ASK)

    return aligned.filter("codes is not null").select("part", "codes", "counts").mapInArrow(task, "part long, code long, n long")


def pair_counts(aligned: DataFrame, n_pieces: int) -> DataFrame:
    """code, a_id, b_id, total, best: how many links of the corpus hold a pair of ids, and whether no pair with the same b_id has more."""
    totals = _asked(aligned).groupBy("code").agg(F.sum("n").alias("total"))
    named = totals.select("code", F.expr(f"code div {n_pieces}").alias("a_id"), F.pmod("code", F.lit(n_pieces)).alias("b_id"), "total")
    # As many rows of a b_id as the other vocabulary has ids at most.
    return named.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b_id")))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])
_RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False) -> DataFrame:
    """Align the tokens of two tokenizers over each document and over the corpus.

    byte_level: path of a byte-level tokenizer file; pieces: path of a
    sentencepiece model with byte fallback; both the same on all machines.
    Returns doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of tokens
    that share a byte), n_best (links whose pair of ids no other pair with the
    same piece outnumbers in the corpus), count_sum (over links: how many links
    of the corpus hold the same ids), groups_sha256 and, with with_groups, the
    groups themselves.

    Null or empty text, and text whose tokens do not give its bytes back: no
    tokens, zeros, and an empty string for the digest.  Rows with a null doc_id
    and repeated rows count like any other.  An empty table gives no rows.
    Other columns of docs are left out.  One task holds a text, its chunks and
    its links, some 100 bytes for each of its tokens.
    """
    aligned = align_documents(docs, byte_level, pieces, with_groups)
    n_pieces = len(_aligner(byte_level, pieces).b_bytes)
    answers = _asked(aligned).select("part", "code").join(pair_counts(aligned, n_pieces).select("code", "total", "best"), "code")
    told = aligned.filter("codes is null").drop("codes", "counts")

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        code = answers.column("code").to_numpy()
        order = np.argsort(code)
        total, best = answers.column("total").to_numpy()[order], answers.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for raw, n in zip(docs.column("links").to_pylist(), docs.column("n_pairs").to_pylist(), strict=True):
            places, counts = _unpacked(raw, n) if raw is not None else (np.zeros(0, np.int64),) * 2
            n_best.append(int(counts[best[places]].sum()))
            count_sum.append(int((counts * total[places]).sum()))
        columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([columns[f.name] if f.name in columns else docs.column(f.name) for f in RESULT], schema=RESULT)

    out = told.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, _RESULT_SQL)
    return out if with_groups else out.drop("groups")
