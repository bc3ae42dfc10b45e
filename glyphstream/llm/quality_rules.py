"""Quality rules: a decision list learnt by sequential covering, applied as a Spark conditional.

Everything on the path of the rows is Spark expressions.  Learning sees only
counts: labelled documents by the bin of each statistic, at most as many rows
as there are labelled documents in the bounded sample, whatever the corpus.
Thresholds are quantiles of the labelled documents' statistics.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_place, materialize, place_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that rules are learnt from, the ones with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Statistics that a rule may test.
STATISTICS = ("symbol_share", "duplicate_share", "repeat_share", "upper_share", "bang_share", "word_length")
#: Quantiles of each label's documents that become thresholds.
QUANTILES = [k / 20 for k in range(1, 20)]
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *STATISTICS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of RESULTS; columns of docs with these names are replaced."""
    step, back = by_place(docs, RESULTS)
    text = F.coalesce(F.col(f"_{place_of(docs, 'text')}").cast("string"), F.lit(""))
    without = lambda c, chars: F.translate(c, chars, "")
    count = lambda chars: F.length(text) - F.length(without(text, chars))
    trimmed = F.btrim(text, F.lit(SPACES))
    step = step.withColumns(
        {
            "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
            "lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "word_chars": F.length(without(text, SPACES)).cast("long"),
            "n_symbols": count(SYMBOLS).cast("long"),
            "uppers": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
            "bangs": count("!"),
        }
    )
    # Hashes of the 3-word windows.  Most texts have none twice; only the others need the places.
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    none = F.array().cast("array<struct<h:long,i:int>>")
    step = step.withColumn("n_words", F.size("words").cast("long"))
    step = step.withColumn("hashes", F.when(F.col("n_words") >= 4, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window)).otherwise(F.array().cast("array<long>")))
    step = step.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    # Sorted, windows found twice are neighbours.
    same = lambda w, j: F.coalesce(w["h"] == F.get("windows", j)["h"], F.lit(False))
    again = F.filter("windows", lambda w, j: same(w, j - 1) | same(w, j + 1))
    step = step.withColumn("again", F.sort_array(F.transform(again, lambda w: w["i"])))
    # A window adds the words that the one before it in the text doesn't cover.
    gaps = F.transform("again", lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("again", j - 1))))
    step = step.withColumns(
        {
            "n_repeat_words": F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    step = step.withColumns(
        {
            # The partition's number makes this column one that filters are not pushed below: they would repeat all of the above.
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) | (F.spark_partition_id() < 0),
            "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
            "duplicate_share": share(F.col("n_dup_lines"), F.size("lines")),
            "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "upper_share": share(F.col("uppers"), F.col("word_chars")),
            "bang_share": share(F.col("bangs"), F.col("n_words")),
            "word_length": share(F.col("word_chars"), F.col("n_words")),
        }
    )
    return step.select(*back, *RESULTS)


#: A condition: statistic, whether it must reach the threshold (else be below it), threshold.
Condition = tuple[str, bool, float]


def _estimate(wanted: float, others: float) -> float:
    """The m-estimate of a rule's precision: few documents do not make a rule look sure."""
    return (wanted + 0.2) / (wanted + others + 2.0)


class Rule(NamedTuple):
    """Documents that reach the rule and hold all its conditions are kept or rejected; without conditions, all that reach it."""

    conditions: list[Condition]
    keeps: bool


def _grown(holds: np.ndarray, live: np.ndarray, fold: np.ndarray, wanted: np.ndarray, others: np.ndarray, max_conditions: int) -> list[int]:
    """Options that together pick wanted documents of the live cells, or none.

    Grown on fold 0 by the condition with the best m-estimate of precision,
    then cut back to the beginning that fold 1 likes best.
    """
    covered, chosen = live & (fold == 0), []
    best = _estimate(wanted[covered].sum(), others[covered].sum())
    while len(chosen) < max_conditions:
        w, o = (holds & covered) @ wanted, (holds & covered) @ others
        score = np.where(w > 0, (w + 0.2) / (w + o + 2.0), 0.0)
        top = int(np.lexsort((-np.arange(len(holds)), w, score))[-1])
        if score[top] <= best:
            break
        best = score[top]
        chosen.append(top)
        covered = covered & holds[top]
    told = []
    for k in range(1, len(chosen) + 1):
        within = live & (fold == 1) & holds[chosen[:k]].all(axis=0)
        told.append((_estimate(wanted[within].sum(), others[within].sum()), -k))
    return chosen[: -max(told)[1]] if told else []


def learn(values: np.ndarray, fold: np.ndarray, bad: np.ndarray, good: np.ndarray, options: list[Condition], min_precision: float, max_rules: int = 8, max_conditions: int = 3) -> list[Rule]:
    """A decision list: what a rule covers is set aside, and the next one is learnt from the rest.

    values: statistics of each cell, in the order of STATISTICS; fold: 0 grows
    and 1 prunes; bad, good: the cell's documents.  A rule that rejects must
    be precise enough on both folds together.  Where none is, a rule that keeps
    may take good documents out of the way of later ones: bad ones must be
    rarer in it than in the rest, by the factor that min_precision leaves.
    What no rule covers is kept, unless the keeping rules leave a rest that is
    bad with the same precision; then a last rule without conditions rejects it.
    """
    if not len(values) or not options:
        return []
    holds = np.stack([(values[:, STATISTICS.index(name)] >= t) == above for name, above, t in options])
    live = np.ones(len(values), bool)
    counts = lambda within: (bad[within].sum(), good[within].sum())
    precise = lambda n_bad, n_good: n_bad >= 5 and n_bad >= min_precision * (n_bad + n_good)
    rules: list[Rule] = []
    while len(rules) < max_rules and live.any():
        all_bad, all_good = counts(live)
        for keeps in (False, True):
            chosen = _grown(holds, live, fold, *((good, bad) if keeps else (bad, good)), max_conditions)
            within = live & holds[chosen].all(axis=0)
            n_bad, n_good = counts(within)
            rarer = n_good >= 5 and n_bad * (all_bad + all_good) <= (1 - min_precision) * all_bad * (n_bad + n_good)
            if chosen and (rarer if keeps else precise(n_bad, n_good)):
                rules.append(Rule([options[k] for k in chosen], keeps))
                live &= ~within
                break
        else:
            break
    if rules and rules[-1].keeps and precise(*counts(live)):
        rules.append(Rule([], False))
    while rules and rules[-1].keeps:  # these say what is so without them
        rules.pop()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """What the first rule says whose conditions hold; true where none does."""
    out = None
    for conditions, keeps in rules:
        condition = reduce(lambda a, b: a & b, [F.col(name) >= t if above else F.col(name) < t for name, above, t in conditions], F.lit(True))
        out = F.when(condition, F.lit(keeps)) if out is None else out.when(condition, F.lit(keeps))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, min_precision: float = 0.95, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the statistics of at most ``max_labelled`` labelled documents that pass the base rules."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toDF("sampled", "marked")
    known = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("sampled"))
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("fold")
    rows = materialize(with_statistics(known).filter(~F.col("base_failed")).select(*[F.round(s, 4).alias(s) for s in STATISTICS], fold, (F.col("marked") == 0).alias("bad")), "labelled")
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(s, QUANTILES).alias(s) for s in STATISTICS]).collect()  # two rows
    options = [(s, above, t) for s in STATISTICS for t in sorted({v for r in quantiles for v in r[s]}) for above in (True, False)]
    # Cells: documents between the same thresholds are alike to every rule.
    bin_of = lambda s: F.array_max(F.filter(F.array(F.lit(-1.0), *[F.lit(t) for n, above, t in options if n == s and above]), lambda t: t <= F.col(s))).alias(s)
    cube = rows.select(*[bin_of(s) for s in STATISTICS], "fold", "bad").groupBy(*STATISTICS, "fold").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).orderBy(*STATISTICS, "fold")
    cells = np.array([tuple(r) for r in cube.collect()], float).reshape(-1, len(STATISTICS) + 3)
    n = len(STATISTICS)
    return learn(cells[:, :n], cells[:, n], cells[:, n + 1], cells[:, n + 2], options, min_precision)


def quality_rules(docs: DataFrame, labels: DataFrame, min_precision: float = 0.95, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with the columns of RESULTS (statistics and base_failed), and kept.

    Words are runs of characters other than ASCII white space.  base_failed:
    under 50 words, or over half of the words in 3-word windows found twice.
    kept: not base_failed, and the first learnt rule that holds keeps it, or none holds.  labels has doc_id
    and quality (0: bad); a repeated doc_id counts once, as bad if any row says
    so.  Without labels, or where no rule is precise enough, the base rules
    decide alone.  Rules are learnt from at most ``max_labelled`` of the
    labelled documents, the ones with the smallest hashes of doc_id.

    Null text counts as empty and fails the base rules.  Null doc_ids and
    repeated rows are judged like others.  Columns of docs with the names of
    results, in any case, are replaced; all others stay, whatever their names.
    A text's words and windows are held by the task at once, some 100 bytes a
    word.
    """
    rules = learn_rules(docs, labels, min_precision, max_labelled)
    judged = with_statistics(docs)
    keep = [F.col(f"`{c}`") for c in judged.columns if c.lower() != "kept"]
    return judged.select(*keep, (~F.col("base_failed") & verdict(rules)).alias("kept"))
