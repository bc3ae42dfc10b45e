"""Best-fit packing of documents into token sequences by minimum bin slack.

Lengths are bounded by the sequence size, so the histogram of lengths is a
table of at most that many rows, whatever the corpus.  On it the plan is made:
a bin starts with the longest length left, and bitset subset-sum dynamic
programming over the lengths still available finds the fullest combination for
the rest; it is removed as often as the counts allow, as equal bins follow each
other.  The plan then reaches all documents by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, n_shuffle

#: Words remembered before a generation of them ends; the one before it is kept for those still in use.
MAX_CACHE = 500_000
#: Texts with these are encoded whole or by white space alone: rarer white space, then special tokens.
_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Beyond Latin letters, or with apostrophes, words are left as they are.
_RICH = re.compile("['\\u0130]|[^\\x00-\\u024f]")
#: Letters, and what else is not white space: the tokenizer never joins the two.
_PARTS = re.compile(r"[^\W\d_]+|(?:[^\s\w]|[\d_])+")
#: Whether a text needs a look at the three above, as one class of characters, which is searched fastest.
_UNUSUAL = re.compile("['<\\x1c-\\x1f\\x85\\xa0\\u0130\\u0250-\\U0010ffff]")
_TOKENIZERS: dict[str, tuple] = {}


class _Memory:
    """Token ids by word, in two generations: what is still in use outlives a full one."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > MAX_CACHE:
            self.young, self.old = {}, self.young

    def unknown(self, words: set[str]) -> set[str]:
        """The words that are not remembered; the others are in the young generation afterwards."""
        young, old = self.young, self.old
        words = words.difference(young)
        if old:
            young.update([(w, old[w]) for w in words if w in old])
            words = words.difference(young)
        return words


#: Texts on which a tokenizer must do as word_tokens assumes.
_PROBES = ("One two,three 4four", "UPPER  lower\tx_y\nsecond-line", "a.b!c (d) #5%", "Straße über Éa")


def _fits(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and encodes letters apart from other characters."""
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    return all(ids(t) == [i for word in t.lower().split() for part in _PARTS.findall(word) for i in ids(part)] for t in _PROBES)


def word_tokens(path: str, texts: list[str]) -> list[bytes]:
    """Token ids, as little-endian 32-bit integers, of each text.

    For tokenizers that lower case, drop white space, end words with </w> and
    split letters from other characters: what lies between white space is
    encoded once, by such parts, and remembered, in generations of MAX_CACHE
    and what one batch adds.  Texts with rarer white space or special tokens are
    encoded whole.  Other tokenizers are refused.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if not _fits(tokenizer):
            raise ValueError(f"{path} is not a tokenizer of lower-cased words")
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _TOKENIZERS[path] = (tokenizer, _Memory(), ends)
    tokenizer, memory, ends = _TOKENIZERS[path]
    encode = lambda xs: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
    unusual = [i for i, t in enumerate(texts) if _UNUSUAL.search(t)]
    rich = {i for i in unusual if _RICH.search(texts[i])}
    whole = {i for i in unusual if _ODD_SPACE.search(texts[i]) or _SPECIAL.search(texts[i])}
    chunks = [[] if i in whole else t.split() if i in rich else t.lower().split() for i, t in enumerate(texts)]
    seen: set[str] = set()
    for c in chunks:
        seen.update(c)
    memory.turn()
    known = memory.young
    new = memory.unknown(seen)
    # Words of letters alone are their own parts.
    split = {c: _PARTS.findall(c) for c in new if not c.isalpha() and not (rich and _RICH.search(c))}
    missing = list(new.difference(split) | memory.unknown({p for parts in split.values() for p in parts}))
    plain = [p for p in missing if p.isalpha()]
    for at in range(0, len(plain), 1000):
        # Words joined by spaces are encoded at once and told apart by their ends.
        some = plain[at : at + 1000]
        ids = encode([" ".join(some)])[0]
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) == len(some):
            raw, first = ids.tobytes(), 0
            for p, last in zip(some, (cut * 4).tolist(), strict=True):
                known[p] = raw[first:last]
                first = last
    missing = [p for p in missing if p not in known]
    for at in range(0, len(missing), 20_000):
        some = missing[at : at + 20_000]
        known.update((p, ids.tobytes()) for p, ids in zip(some, encode(some), strict=True))
    for c, parts in split.items():
        known[c] = b"".join(map(known.__getitem__, parts))
    out = [b"".join(map(known.__getitem__, c)) for c in chunks]
    for i in whole:
        out[i] = encode([texts[i]])[0].tobytes()
    return out


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """The documents as token pieces of at most ``size``; only longer documents are cut."""
    schema = PIECE if with_ids else pa.schema(list(PIECE)[:-1])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: list[list] = [[] for _ in schema]
                for doc_id, ids in zip(part.column(0).to_pylist(), word_tokens(tokenizer, texts), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * size):
                        piece = ids[k : k + 4 * size]
                        for column, v in zip(columns, (doc_id, k // (4 * size), k // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=False):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(task, PIECE_SQL + ", ids binary" * with_ids)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most room.

    counts: how many there are of each length, the longest first.  Bit s of
    the set ``reach`` says that some combination has the sum s.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, n in counts.items():
        if length > room or not n:
            continue
        n, k = min(n, room // length), 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n, k = n - k, 2 * k
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> left & 1:
            left -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies of each length, how many such bins), by minimum bin slack."""
    counts = dict(sorted(((k, v) for k, v in histogram.items() if v > 0), reverse=True))
    out = []
    while counts:
        longest = next(iter(counts))
        counts[longest] -= 1
        bin_ = fullest(size - longest, counts)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[length] // k for length, k in bin_.items())
        for length, k in bin_.items():
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        out.append((bin_, times))
    return out


def _places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """For each length and range of ranks: first rank, copies in a bin, first bin, first offset."""
    rows, rank, first_bin = [], {}, 0
    for bin_, times in bins:
        offset = 0
        for length, k in sorted(bin_.items(), reverse=True):
            rows.append((length, rank.get(length, 0), k, first_bin, offset))
            rank[length] = rank.get(length, 0) + k * times
            offset += length * k
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as minimum bin slack finds.

    tokenizer: path of a word-level tokenizer file, the same on all machines.
    A document is its ids, then ``end_id``.  Returns a row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the
    ids (little-endian 32-bit integers).

    Null text counts as empty: the end id alone.  Null doc_ids and repeated
    rows are packed like any other row.  An empty table gives no rows.  Other
    columns of docs are left out.
    """
    spark = docs.sparkSession
    n_buckets = 4 * n_shuffle(spark)
    # Buckets split the ranking of a very common length over many tasks.
    cut = materialize(pieces(docs, tokenizer, size, end_id, with_ids).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int")), "pieces")
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = spark.sparkContext.broadcast(_places(plan(histogram, size)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skipped = counts.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(local) - 1).join(skipped, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("skipped"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in it:
            length = batch.column(3).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            row = rows[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(rank) else rows[:0]
            within = rank - row[:, 1]
            sequence = row[:, 3] + within // np.maximum(row[:, 2], 1)
            offset = row[:, 4] + within % np.maximum(row[:, 2], 1) * length
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SQL + ", ids binary" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: whole sequences of a packing made with with_ids, of at most its size each."""
    laid = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("laid"))
    return laid.select("sequence_id", F.expr("aggregate(laid, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
