"""MinHash near-dedup by an inverted join over signature coordinates.

Every distinct shingle set is posted under its (coordinate, value) pairs.  Two
signatures that agree in at least t of K coordinates share one of the K - t + 1
rarest pairs of either (prefix filter), so only those are posted, and pairs of
sets with unequal sizes or fewer than t agreements are skipped.  t is so far
below the expected K * threshold that a true link is lost with a probability
of about 1e-5.  What is left is confirmed on the full shingle sets.

Within a posting not all pairs are listed: each member meets the posting's most
central member first, and after that only members of other components, inside
the tasks and in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, _seeded, chunks, mix, prefix, span_hash, word_codes, words
from .repeats import batches
from .shared import materialize, n_shuffle

N_COORDINATES = 48
#: Agreements that a pair must have: five standard deviations below 0.8 * 48.
MIN_AGREEMENTS = 25
_MULTIPLIERS = _seeded(N_COORDINATES, 5) | U64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct 64-bit shingle hashes of each text."""
    for chunk in chunks(column):
        starts, ends, bounds = words(chunk)
        count = np.diff(bounds)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        pre = prefix(word_codes(chunk, starts, ends, lower=True))
        first = np.cumsum(n) - n
        lo = np.arange(int(n.sum())) - np.repeat(first - bounds[:-1], n)
        shingles = span_hash(pre, lo, lo + np.repeat(np.minimum(count, width), n))
        for row, a, k in zip(chunk.rows.tolist(), first.tolist(), n.tolist(), strict=True):
            yield row, np.unique(shingles[a : a + k])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of N_COORDINATES hash functions over a set, in 32 bits."""
    out = np.empty(N_COORDINATES, "<u4")
    step = max(1, 200_000 // N_COORDINATES)
    least = np.full(N_COORDINATES, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(shingles), step):
        block = shingles[at : at + step]
        np.minimum(least, (block[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    out[:] = mix(least) >> U64(32)
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("signature", pa.binary())])


def _sign(width: int):
    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_pylist()
            rows = []
            for row, s in shingle_sets(batch.column(1), width):
                if len(s):
                    hi, lo = int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), int(np.add.reduce(s).view(np.int64))
                    rows.append({"doc_id": ids[row], "n_shingles": len(s), "set_hi": hi, "set_lo": lo, "signature": signature(s).tobytes()})
                else:
                    rows.append({"doc_id": ids[row], "n_shingles": 0, "set_hi": None, "set_lo": None, "signature": None})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SIGNED)

    return task


def _agree(threshold: float):
    """Keep candidate pairs whose sizes and signatures allow a link."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, N_COORDINATES) for k in (4, 5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            agree = (sa == sb).sum(axis=1)
            keep = (agree >= MIN_AGREEMENTS) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            pairs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])
            yield pairs.filter(pa.array(keep))

    return task


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out = [np.zeros(0, U64)] * len(column)
    for row, s in shingle_sets(column, width):
        out[row] = s
    return out


def _attach_sets(column: str, width: int):
    """Replace a text by its sorted shingle hashes."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.schema.get_field_index(column)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = pa.array([s.tobytes() for s in _sets(part.column(at), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([sets if k == at else part.column(k) for k in range(part.num_columns)], names=part.schema.names)

    return task


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int, width: int):
    """Of pairs (a, b, set of b, text of a), those whose full sets are similar enough."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                keep = [_similar(np.frombuffer(b.as_py(), U64), a, percent) for b, a in zip(part.column(2), _sets(part.column(3), width), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return task


def minhash_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose shingle sets are similar, directly or through others.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A set holds the distinct shingles of ``shingle_words`` words; a text with
    fewer words has its whole sequence as its one shingle.  Documents are
    linked if 100 * intersection >= percent * union, confirmed on full sets.
    Returns per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id reachable, itself included) and kept (doc_id = component_id).

    Null or empty texts and texts without words have empty sets and are linked
    with nothing.  A null doc_id links with nothing; its component_id is null
    and it is kept.  Equal rows that repeat a doc_id get equal results; if its
    texts differ, any of them may speak for it.  Other columns of docs are left
    out.  percent must be 80 or more, as the number of
    agreements that is asked for fits that.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = materialize(texts.mapInArrow(_sign(shingle_words), "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary"), "signed")
    filled = signed.filter("doc_id is not null and n_shingles > 0")
    # Equal sets are one class from here on: copies never meet each other.
    same = ["set_hi", "set_lo", "n_shingles"]
    classes = filled.groupBy(*same).agg(F.min("doc_id").alias("node"))
    sets = materialize(filled.join(classes.withColumnRenamed("node", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "signature"), "sets")
    postings = _prefixes(sets)
    # Each member meets the most central member of each of its postings; the partner that agrees most is confirmed.
    central = F.max_by(F.struct("node", "n_shingles"), F.struct("weight", F.negative("node")))
    heads = materialize(postings.groupBy("token").agg(central.alias("head"), F.count("*").alias("size")).filter("size > 1").select("token", F.col("head.node").alias("a"), F.col("head.n_shingles").alias("na")), "heads")
    # Sets whose sizes are too far apart for a link need no signatures.
    alike = F.lit(100) * F.least("na", "n_shingles") >= F.lit(percent) * F.greatest("na", "n_shingles")
    stars = postings.join(heads, "token").filter((F.col("a") != F.col("node")) & alike).select("a", F.col("node").alias("b")).distinct()
    near = _agreeing(stars, sets, percent)
    best = materialize(near.groupBy("b").agg(F.max(F.struct("agree", F.negative("a").alias("a"))).alias("best")).select(F.negative("best.a").alias("a"), "b"), "best")
    links = materialize(_linked(best, texts, shingle_words, percent), "links")
    # Then members of other components than that of their posting's head meet all members of other components.
    label = components(links)
    labelled = materialize(postings.drop("n_shingles").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    main = F.max_by("component", F.struct("weight", F.negative("node")))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), main.alias("main"), F.count("*").alias("size")).filter("lo < hi").select("token", "main", "size")
    more = _met(labelled.join(materialize(mixed, "mixed"), "token"), sets, texts, shingle_words, percent)
    label = components(links.unionByName(more))
    # From classes back to documents; a document with its own set's smallest id is that class.
    known = label.select(F.col("node"), "component")
    by_class = classes.join(known, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    several = materialize(by_class, "classes")
    out = signed.drop("signature").join(several, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _prefixes(sets: DataFrame) -> DataFrame:
    """token, node, weight, n_shingles and rarer: each node's rarest tokens, as far as an agreeing pair must share one of them.

    The weight counts how often the node's tokens are shared; bits of rarer
    tell the coordinates of the node's tokens that come before this one.

    Tokens that one node alone has come first in the order and post nothing.
    """

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(N_COORDINATES, dtype=U64) << U64(32)
        for batch in it:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, N_COORDINATES).astype(U64)
                tokens = (values | coordinate).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(batch.column(0).to_numpy(), N_COORDINATES))], names=["token", "node"])

    posted = sets.select("node", "signature").mapInArrow(explode, "token long, node long")
    counts = materialize(posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    shared = posted.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"), F.sum("n").alias("weight"))
    # The places before the shared tokens are taken by N_COORDINATES - size(tokens) tokens of one node.
    take = F.lit(N_COORDINATES - MIN_AGREEMENTS + 1) - (F.lit(N_COORDINATES) - F.size("tokens"))
    sized = shared.filter(take > 0).join(sets.select("node", "n_shingles"), "node")
    rarest = sized.select("node", "weight", "n_shingles", F.slice("tokens", F.lit(1), take).alias("tokens")).select("node", "weight", "n_shingles", "tokens", F.posexplode("tokens").alias("pos", "t"))
    rarer = F.expr("aggregate(slice(tokens, 1, pos), 0L, (a, x) -> a | shiftleft(1L, cast(shiftright(x.token, 32) as int)))")
    return materialize(rarest.select("t.token", "node", "weight", "n_shingles", rarer.alias("rarer")), "postings")


def _agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    with_a = pairs.join(sets.toDF("a", "na", "sa"), "a")
    both = with_a.join(sets.toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_agree(percent / 100), "a long, b long, agree int")


#: Members of a posting that meet at once, and shingles of them; larger postings meet block by block.
BLOCK = 1000
BLOCK_SHINGLES = 1_000_000


def _met(here: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within postings between members of different components.

    here: token, node, component, main (the component of the posting's head),
    size and rarer.  Members meet inside the tasks, in blocks of bounded size:
    the block's members are posted under their coordinates once more, and an
    odd member's shortest lists are merged into its candidates (prefix), whose
    collisions the longer lists then complete (skip).  No row is made for a
    pair that is not a link.  A pair meets at its rarest common token only;
    what earlier links of the block connect is skipped.
    """
    nodes = here.select("node").distinct()
    full = texts.filter("doc_id is not null").toDF("node", "full").join(nodes, "node").mapInArrow(_attach_sets("full", width), "node long, full binary")
    known = materialize(full.join(sets, "node"), "full")
    # Blocks are bounded by what their members weigh as well.
    weight = here.select("token", "node").join(sets.select("node", "n_shingles"), "node").groupBy("token").agg(F.sum("n_shingles").alias("shingles"))
    here = here.join(weight, "token")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    columns = ("node", "component", "rarer")
    members = here.select("token", F.explode(every).alias("i"), mine.alias("j"), *columns, F.lit(False).alias("odd"))
    odd = here.filter("component <> main").select("token", mine.alias("i"), F.explode(every).alias("j"), *columns, F.lit(True).alias("odd"))
    rows = odd.unionByName(members).join(known, "node").select("token", "i", "j", *columns, "odd", "n_shingles", "signature", "full")
    dealt = rows.repartition(n_shuffle(here.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j", "odd")

    def block(rows: list[dict]) -> Iterator[tuple[int, int]]:
        x, y = [r for r in rows if r["odd"]], [r for r in rows if not r["odd"]]
        if not x or not y:
            return
        sx, sy = (np.frombuffer(b"".join(r["signature"] for r in z), "<u4").reshape(-1, N_COORDINATES) for z in (x, y))
        nx, ny = (np.array([r["n_shingles"] for r in z]) for z in (x, y))
        cx, cy = (np.array([r["component"] for r in z]) for z in (x, y))
        before = (np.array([r["rarer"] for r in x])[:, None] >> np.arange(N_COORDINATES)) & 1 > 0
        # Posting lists of the block: members by coordinate and value.
        lists = np.argsort(sy, axis=0, kind="stable")
        values = np.take_along_axis(sy, lists, axis=0)
        first = np.stack([np.searchsorted(values[:, c], sx[:, c]) for c in range(N_COORDINATES)], axis=1)
        last = np.stack([np.searchsorted(values[:, c], sx[:, c], side="right") for c in range(N_COORDINATES)], axis=1)
        shortest = np.argsort(last - first, axis=1, kind="stable")[:, : N_COORDINATES - MIN_AGREEMENTS + 1]
        found = []
        for k in range(len(x)):
            merged = np.unique(np.concatenate([lists[first[k, c] : last[k, c], c] for c in shortest[k].tolist()]))
            merged = merged[(cy[merged] != cx[k]) & (100 * np.minimum(ny[merged], nx[k]) >= percent * np.maximum(ny[merged], nx[k]))]
            same = sy[merged] == sx[k]
            agree = same.sum(axis=1)
            ok = (agree >= MIN_AGREEMENTS) & ~(same & before[k]).any(axis=1)
            found += [(-a, k, m) for a, m in zip(agree[ok].tolist(), merged[ok].tolist(), strict=True)]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                v = root[v]
            return v

        held: dict[int, np.ndarray] = {}
        of = lambda r: held.setdefault(r["node"], np.frombuffer(r["full"], U64))
        for _, k, m in sorted(found):
            u, v = find(int(cx[k])), find(int(cy[m]))
            if u != v and _similar(of(x[k]), of(y[m]), percent):
                root[max(u, v)] = min(u, v)
                yield x[k]["node"], y[m]["node"]

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[dict]:
            key, held = None, []
            for batch in it:
                for r in (r for at in range(0, batch.num_rows, 500) for r in batch.slice(at, 500).to_pylist()):
                    if (own := (r["token"], r["i"], r["j"])) != key:
                        yield from ({"a": a, "b": b} for a, b in block(held))
                        key, held = own, []
                    held.append(r)
            yield from ({"a": a, "b": b} for a, b in block(held))

        yield from batches(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return materialize(dealt.mapInArrow(task, "a long, b long"), "met")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    usable = texts.filter("doc_id is not null")
    with_b = pairs.join(usable.toDF("b", "tb"), "b").select("a", "b", "tb").mapInArrow(_attach_sets("tb", width), "a long, b long, tb binary")
    both = with_b.join(usable.toDF("a", "ta"), "a").select("a", "b", "tb", "ta")
    return both.mapInArrow(_confirm(percent, width), "a long, b long")
