"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its
documents is expected to have.  Whole copies are certain.  For the rest every
document has a chance, its inclusion probability; documents are ranked by random
odds divided by inclusion odds, and the first ones are taken until the source's
target is reached.

Nothing is sorted as a whole: ranks are counted in buckets, a window adds the
buckets up, and only the bucket in which the target is reached is put into
order.  A source's few largest documents are drawn first, by themselves, so that
what they miss is made up for by the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Sources whose totals fit on the driver; more are refused.
MAX_SOURCES = 100_000
#: A document with more than one in LARGE of its source's words is drawn apart: a source has fewer than LARGE of these.
LARGE = 1000
#: Documents that a bucket of ranks is meant to hold, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 10_000, 256


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above ``most`` times its size; the excess is shared anew by weight until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * whole]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def unit(*columns: Column) -> Column:
    """A number in (0, 1) from columns, the same in every run: 52 bits of an MD5 digest."""
    told = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _cuts(rest: DataFrame) -> DataFrame:
    """source_no, cut and before: the bucket in which the words of a source come up to wanted, and how many lie before it."""
    order = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = rest.groupBy("source_no", "bucket", "wanted").agg(F.sum("size").alias("words"))
    before = counted.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    within = (F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted"))
    return before.filter(within).select("source_no", F.col("bucket").alias("cut"), "before")


def _drawn(ranked: DataFrame) -> DataFrame:
    """ranked with taken (boolean): the first ones by rank whose words, after ``before``, come nearest to wanted."""
    order = Window.partitionBy("source_no", "bucket").orderBy("rank", "doc_id", "size")
    after = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The document in which the target lies is taken if that comes nearer than leaving it.
    return ranked.withColumn("taken", after - F.col("size") / 2.0 <= F.col("wanted"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """How often each document is taken into a mix whose sources have target weights.

    docs has doc_id, text, source.  A document's size is its number of words,
    runs of other than ASCII white space.  Sources in the order of their code
    points, null last, get the weights in turn and share ``share`` times all
    words; targets stop at ``most`` times a source's size, and the excess is
    shared anew.  Returns doc_id, size, source_size, target (the source's),
    taken (words, copies counted) and copies.

    Each document is taken the whole number of times in target / source_size,
    and once more by Pareto order sampling with the fraction as its probability.
    What a source's documents of over a thousandth of its words miss or exceed
    changes the probability of its others, so a source misses its target by less
    than a thousandth of its size, or by half of a large document if it has too
    few others.  No document is taken over ``most`` times.  The same rows give
    the same result in every run: chances come from a digest of doc_id and seed.

    Null text: size 0, nothing taken.  Null source: a source of its own.  Null
    doc_id: as an empty one.  Rows that repeat a doc_id are drawn side by side,
    each with its own result.  A source without words gets the target 0.  An
    empty table gives no rows.  Over MAX_SOURCES sources raise ValueError.
    Other columns of docs are left out.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"), F.col("source").cast("string").alias("source"))
    sized = materialize(sizes.withColumn("u", unit(F.lit(seed), F.col("doc_id"))), "sizes")
    found = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    told = targets([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], share * sum(r.words for r in found), most)
    buckets = max([MIN_BUCKETS, *(r.rows // BUCKET_ROWS for r in found)])
    copies = [min(most, int(t // r.words)) if r.words else 0 for t, r in zip(told, found, strict=True)]
    table = spark.createDataFrame([(i, r.source, r.words, t, c) for i, (r, t, c) in enumerate(zip(found, told, copies, strict=True))], "source_no int, name string, source_size long, target double, certain int")
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    # Odds of chance over odds of inclusion; where a source has no fraction left, nothing is drawn.
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("certain")).otherwise(0.0)
    odds = lambda p: p / (1 - p)
    ranked = known.withColumn("chance", chance).withColumn("rank", F.when(F.col("chance") > 0, odds(F.col("u")) / odds(F.col("chance")))).drop("u")
    large = (F.col("size") * LARGE > F.col("source_size")) & F.col("rank").isNotNull()
    # Few rows: fewer than LARGE of each source.
    first = ranked.filter(large).withColumn("wanted", F.sum("size").over(Window.partitionBy("source_no")) * F.col("chance")).withColumns({"bucket": F.lit(0), "before": F.lit(0)})
    drawn = _drawn(first)
    done = drawn.groupBy("source_no").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("got"))
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int")
    rest = ranked.filter(~large & F.col("rank").isNotNull()).withColumn("bucket", place).join(F.broadcast(done), "source_no", "left")  # one row a source
    rest = rest.withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size") - F.coalesce("got", F.lit(0))).drop("got")
    cut = rest.join(F.broadcast(_cuts(rest)), "source_no", "left")  # one row a source at most
    within = _drawn(cut.filter("bucket = cut"))
    # Before the cut everything is taken, and nothing after it; without a cut all or nothing is wanted.
    around = cut.filter("cut is null or bucket <> cut").withColumn("taken", F.when(F.col("cut").isNull(), F.col("wanted") > 0).otherwise(F.col("bucket") < F.col("cut")))
    certain = ranked.filter("rank is null").withColumn("taken", F.lit(False))
    columns = ("doc_id", "size", "source_size", "target", "certain", "taken")
    every = drawn.select(*columns).unionByName(within.select(*columns)).unionByName(around.select(*columns)).unionByName(certain.select(*columns))
    times = F.col("certain") + F.col("taken").cast("int")
    return every.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * times).alias("taken"), times.alias("copies"))
