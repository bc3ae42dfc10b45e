"""Grouped evaluation of labelled rows and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import N_POINTS

UNKNOWN = "unknown"


def label_person_pivot(rows: DataFrame, people: list[str]) -> DataFrame:
    """Rows by label (down) and person (across), with zeros."""
    return rows.groupBy("label").pivot("person", people).count().na.fill(0)


def label_index(rows: DataFrame) -> DataFrame:
    """Labels in sorted order, counted from 0; the label vocabulary is small by nature."""
    labels = rows.select("label").distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_idx"))


def undercovered_labels(rows: DataFrame) -> DataFrame:
    """Labels known from fewer than two known people, those from none included."""
    known = F.countDistinct(F.when(F.col("person") != UNKNOWN, F.col("person")))
    return rows.groupBy("label").agg(known.alias("n_people")).filter("n_people < 2")


def unknown_summary(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("person") == UNKNOWN).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.countDistinct("person").alias("n_people"))


def logo_folds(rows: DataFrame) -> DataFrame:
    """fold, n_train, n_test of leave-one-person-out folds: unknown people train in every fold and are never tested."""
    by = rows.groupBy("person").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return by.filter(F.col("person") != UNKNOWN).crossJoin(F.broadcast(total)).select(F.col("person").alias("fold"), (F.col("total") - F.col("n")).alias("n_train"), F.col("n").alias("n_test"))


def fold_accuracy(preds: DataFrame) -> DataFrame:
    return preds.groupBy("fold").agg(F.avg((F.col("true") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def pooled_vs_macro(preds: DataFrame) -> DataFrame:
    """pooled (by rows) and macro (mean of folds) accuracy."""
    by = preds.groupBy("fold").agg(F.sum((F.col("true") == F.col("pred")).cast("long")).alias("ok"), F.count("*").alias("n"))
    return by.agg((F.sum("ok") / F.sum("n")).alias("pooled"), F.avg(F.col("ok") / F.col("n")).alias("macro"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    return preds.groupBy("true", "pred").agg(F.count("*").alias("n"))


def top_confusions(preds: DataFrame, k: int = 10) -> DataFrame:
    return confusion_matrix(preds).filter(F.col("true") != F.col("pred")).orderBy(F.desc("n"), F.desc("true"), F.desc("pred")).limit(k)


def classification_report(preds: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; a ratio over nothing is 0."""
    c = confusion_matrix(preds)
    sides = c.select(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("told"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    told = c.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("told"), F.lit(0).cast("long").alias("tp"))
    by = sides.unionByName(told).groupBy("label").agg(F.sum("support").alias("support"), F.sum("told").alias("told"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return by.select("label", ratio(F.col("tp"), F.col("told")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("told") + F.col("support")).alias("f1"), "support")


def report_averages(preds: DataFrame) -> DataFrame:
    r = classification_report(preds)
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return r.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[w(c) for c in ("precision", "recall", "f1")])


def stratified_split(rows: DataFrame, key: str, percent: int = 15, seed: str = "42") -> DataFrame:
    """rows' key, label and test: an exact share of each label, by the rank of a seeded hash."""
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(seed + "-"), F.col(key).cast("string")).cast("binary")), key)
    return rows.select(key, "label", (F.row_number().over(w) * 100 <= percent * F.count("*").over(Window.partitionBy("label"))).alias("test"))


def eval_score(log: DataFrame) -> DataFrame:
    """log with correct (expected is in committed), exact, and collapsed (committed, runs as one, is expected)."""
    collapsed = F.regexp_replace("committed", r"(.)\1+", "$1")
    return log.withColumns({"correct": F.contains("committed", "expected"), "exact": F.col("committed") == F.col("expected"), "collapsed": collapsed == F.col("expected")})


def eval_by_condition(log: DataFrame) -> DataFrame:
    """person, condition, n, n_ok for each person, each condition, each pair and all (null stands for all)."""
    scored = eval_score(log).withColumn("ok", F.col("correct").cast("long"))
    return scored.cube("person", "condition").agg(F.count("*").alias("n"), F.sum("ok").alias("n_ok"))


def eval_misses(log: DataFrame) -> DataFrame:
    """person, condition, misses: target->committed of the failed rows in order."""
    bad = eval_score(log).filter(~F.col("correct")).groupBy("person", "condition")
    told = F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat("expected", F.lit("->"), "committed").alias("m")))), lambda x: x["m"])
    return bad.agg(F.array_join(told, ",").alias("misses"))


def coverage(rows: DataFrame, vocabulary: DataFrame, enough: int = 100) -> DataFrame:
    """person, label, n, enough, missing for each person and each label of the vocabulary."""
    n = rows.groupBy("person", "label").agg(F.count("*").alias("c"))
    asked = n.select("person").distinct().crossJoin(F.broadcast(vocabulary.select("label").distinct()))  # labels are classes, a stated few
    return asked.join(n, ["person", "label"], "left").select("person", "label", F.coalesce("c", F.lit(0)).alias("n"), F.coalesce(F.col("c") >= enough, F.lit(False)).alias("enough"), F.col("c").isNull().alias("missing"))


def accuracy_by_label_class(preds: DataFrame) -> DataFrame:
    kind = F.when(F.length("true") == 1, "letter").otherwise("word")
    return preds.groupBy(kind.alias("kind")).agg(F.avg((F.col("true") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def quality_violations(rows: DataFrame) -> DataFrame:
    """label, person, reason, n of rows that break the dataset's rules; landmarks are 21 points, none of them null."""
    whole = F.coalesce((F.size("landmarks") == N_POINTS) & ~F.exists("landmarks", lambda p: p["x"].isNull() | p["y"].isNull()), F.lit(False))
    reason = F.when(~whole, "not 21 points").when(F.coalesce(F.col("person"), F.lit("")) == "", "no person").when((F.col("person") == UNKNOWN) & (F.length("label") == 1), "letter of an unknown person")
    return rows.select("label", "person", reason.alias("reason")).filter("reason is not null").groupBy("label", "person", "reason").agg(F.count("*").alias("n"))


def accuracy_by_take(preds: DataFrame) -> DataFrame:
    """take, accuracy, n and share of all rows; the sum of accuracy * share is the accuracy of the mix."""
    takes = preds.groupBy("take").agg(F.avg((F.col("true") == F.col("pred")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    total = takes.agg(F.sum("n").alias("_total"))
    return takes.crossJoin(F.broadcast(total)).select("take", "accuracy", "n", (F.col("n") / F.col("_total")).alias("share"))
