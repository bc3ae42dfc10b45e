"""From committed tokens to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases of word signs (fixed values).
PHRASES = {"ILY": "I love you", "IHATEYOU": "I hate you", "HELLO": "Hello"}
#: Domain words of the mode 'academic' (fixed values).
DOMAIN_WORDS = {"academic": ["microcontroller", "mediapipe", "convolutional", "latency", "debounce", "segmentation", "wearable", "inference", "bandwidth", "accelerometer", "gyroscope"]}
#: Deletions of a term's prefix are posted up to this length and distance.
PREFIX, DISTANCE = 7, 2


def token_pieces(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """stream_id, text: runs of letters joined, each word sign a piece of its own, pieces joined by one space."""
    w = Window.partitionBy("stream_id").orderBy("pos")
    word = F.length("label") > 1
    new = word | F.coalesce(F.lag(word).over(w), F.lit(True))
    placed = tokens.filter("label <> ''").withColumn("piece", F.sum(new.cast("int")).over(w))
    named = placed.join(F.broadcast(phrases), "label", "left").withColumn("s", F.coalesce("phrase", "label"))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "")
    pieces = named.groupBy("stream_id", "piece").agg(piece.alias("s"))
    return pieces.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"]), " ").alias("text"))


def vocabulary(docs: DataFrame, boosts: DataFrame, mode: str | None = None) -> DataFrame:
    """term, cnt: terms of texts with their counts, and boosted terms (term, cnt) on top.

    Boosts may have a column mode: those without one always count, the others
    only in theirs.  A vocabulary is built anew for each mode, so nothing of
    another one is left in it.
    """
    if "mode" in boosts.columns:
        boosts = boosts.filter(F.col("mode").isNull() | F.col("mode").eqNullSafe(F.lit(mode))).drop("mode")
    elif mode is not None:
        raise ValueError("these boosts have no modes")
    terms = docs.select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))
    return terms.unionByName(boosts).groupBy("term").agg(F.sum("cnt").alias("cnt"))


def _deletes(terms: DataFrame, name: str) -> DataFrame:
    """Each term with its prefix and what is left of it after up to DISTANCE deletions."""
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    first = F.substring(F.col("term"), 1, PREFIX)
    one = terms.select("term", F.array_distinct(F.concat(F.array(first), cut(first))).alias("d"))
    two = one.select("term", F.array_distinct(F.concat("d", F.flatten(F.transform("d", cut)))).alias("d"))
    # Never empty.  Of a plain explode the optimiser would test that, once for each word of the texts.
    return two.select(F.col("term").alias(name), F.explode_outer("d").alias("d"))


def spell_candidates(misspelt: DataFrame, vocab: DataFrame) -> DataFrame:
    """term, suggestion, distance: the nearest term of the vocabulary, then the most frequent, then the first.

    Terms within two edits share a deletion of their prefixes, so candidates
    come from an equi join on deletions and are verified by their distance.
    """
    pairs = _deletes(misspelt.select("term").distinct(), "term").join(_deletes(vocab.select("term"), "suggestion"), "d").select("term", "suggestion").distinct()
    near = pairs.withColumn("distance", F.levenshtein("term", "suggestion", DISTANCE)).filter("distance >= 0").join(vocab.withColumnRenamed("term", "suggestion"), "suggestion")
    best = near.groupBy("term").agg(F.min(F.struct("distance", F.negative("cnt").alias("c"), "suggestion")).alias("b"))
    return best.select("term", "b.suggestion", "b.distance")


#: Thousandths of a decimal digit that a letter of an unknown word costs.
LETTER = 1000
#: Letters of a run whose parts are cut out at once.
PIECE = 256


def cheapest_split(size: int, known: dict[int, int], unknown: int, longest: int) -> list[int]:
    """Where the words of the cheapest split of a run of size letters end.

    known: the costs of words of the vocabulary by start * (longest + 1) +
    length.  Of equally cheap splits with as many words the one whose words
    end earlier first comes before others.  Each place keeps where its last
    word begins, and a jump some words further back; with these two places with
    as many words find the word in which they differ in few steps.
    """
    cost, words, back, jump = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)

    def before(a: int, b: int) -> bool:
        while back[a] != back[b]:
            a, b = (jump[a], jump[b]) if jump[a] != jump[b] else (back[a], back[b])
        return a < b

    for end in range(1, size + 1):
        least = None
        for n in range(1, min(end, longest) + 1):
            start = end - n
            price = known.get(start * (longest + 1) + n)
            here = (cost[start] + (unknown + LETTER * (n - 1) if price is None else price), words[start] + 1)
            if least is None or here < least or (here == least and before(start, back[end])):
                least, back[end] = here, start
        cost[end], words[end] = least
        up = back[end]
        jump[end] = jump[jump[up]] if words[up] - words[jump[up]] == words[jump[up]] - words[jump[jump[up]]] else up
    ends = []
    while size:
        ends.append(size)
        size = back[size]
    return ends[::-1]


def _split(longest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            texts = []
            for run, places, costs, unknown in zip(batch["run"], batch["places"], batch["costs"], batch["unknown"], strict=True):
                known = dict(zip(places.tolist(), costs.tolist(), strict=True)) if places is not None else {}
                ends = cheapest_split(len(run), known, unknown, longest)
                texts.append(" ".join(run[a:b] for a, b in zip([0, *ends], ends)))
            yield pd.DataFrame({"run": batch["run"], "text": texts})

    return task


def segment_runs(letters: DataFrame, vocab: DataFrame, longest: int = 20) -> DataFrame:
    """run, text: each distinct run of letters as the likeliest words of the vocabulary (term, cnt), joined by spaces.

    A word costs the digits of total / count, an unknown one those of total and
    a digit for each letter after its first; the cheapest split wins, then the one with
    fewer words, then the first in order.  Only the parts of distinct runs, up
    to ``longest`` letters, meet the vocabulary, by an equi join, and travel with a
    digest of their run; the split takes time in proportion to a run's length.
    Null and empty runs give ''.
    """
    cost = lambda digits: F.round(digits * LETTER).cast("long")
    total = vocab.agg(F.coalesce(F.sum("cnt"), F.lit(1)).alias("total"))
    distinct = letters.select(F.coalesce("run", F.lit("")).alias("run")).distinct()
    runs_ = distinct.filter("run <> ''").withColumn("id", F.md5("run"))
    piece = runs_.select("id", F.explode(F.expr(f"transform(sequence(0, length(run) - 1, {PIECE}), o -> struct(o as at, substring(run, o + 1, {PIECE + longest - 1}) as piece))")).alias("p")).select("id", "p.at", "p.piece")
    start = piece.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), F.length("piece")) - 1)).alias("start"))
    size = start.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("piece") - F.col("start")))).alias("size"))
    place = (F.col("at") + F.col("start")).cast("long") * (longest + 1) + F.col("size")
    parts = size.select("id", place.alias("place"), F.substring("piece", F.col("start") + 1, F.col("size")).alias("term"))
    priced = vocab.crossJoin(F.broadcast(total)).select("term", cost(F.log10(F.col("total")) - F.log10("cnt")).alias("cost"))  # total: one row
    known = parts.join(priced, "term").groupBy("id").agg(F.collect_list(F.struct("place", "cost")).alias("known"))
    ready = runs_.join(known, "id", "left").crossJoin(F.broadcast(total)).select("run", F.col("known.place").alias("places"), F.col("known.cost").alias("costs"), cost(F.log10("total")).alias("unknown"))
    split = ready.mapInPandas(_split(longest), "run string, text string")
    return split.unionByName(distinct.filter("run = ''").withColumn("text", F.lit("")))


def correct_sequence(tokens: DataFrame, phrases: DataFrame, vocab: DataFrame, longest: int = 20) -> DataFrame:
    """stream_id, text: runs of letters as words of the vocabulary, word signs by their phrases, joined by spaces.

    tokens has stream_id, pos and label; a label of several characters is a
    word sign and ends a run of letters.  Runs are lower-cased before they are
    split.  Empty and null labels are left out; a phrase that is not known is
    the label itself.  Each distinct run is split once, however often it occurs.
    """
    w = Window.partitionBy("stream_id").orderBy("pos")
    word = F.length("label") > 1
    new = word | F.coalesce(F.lag(word).over(w), F.lit(True))
    placed = tokens.filter("label <> ''").withColumn("word", word).withColumn("piece", F.sum(new.cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "")
    pieces = placed.groupBy("stream_id", "piece", "word").agg(joined.alias("label")).withColumn("run", F.when(~F.col("word"), F.lower("label")))
    split = segment_runs(pieces.filter("run is not null").select("run"), vocab, longest)
    named = pieces.join(split, "run", "left").join(phrases, "label", "left")
    text = F.when(F.col("word"), F.coalesce("phrase", "label")).otherwise(F.col("text"))
    told = named.select("stream_id", "piece", text.alias("s"))
    return told.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"]), " ").alias("text"))
