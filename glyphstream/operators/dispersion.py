"""Spread, leakage and invariance of feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import hand_frame


def _sums(column: str, width: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(width)])


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dispersion(rows: DataFrame, width: int) -> DataFrame:
    """label, person, n, centroid_distance and spread of features (arrays of width numbers).

    centroid_distance: from the mean of a person's rows of a label to the mean
    of the other persons' rows (null if there are none); spread: the mean
    distance of the rows to their own mean.
    """
    per = rows.groupBy("label", "person").agg(F.count("*").alias("n"), _sums("features", width).alias("s"))
    total = per.groupBy("label").agg(F.sum("n").alias("n_all"), _sums("s", width).alias("s_all"))
    mean = lambda s, n: F.transform(s, lambda x: x / n)
    other = mean(F.zip_with("s_all", "s", lambda a, b: a - b), F.nullif(F.col("n_all") - F.col("n"), F.lit(0)))
    told = per.join(total, "label").select("label", "person", "n", mean(F.col("s"), F.col("n")).alias("mean"), F.sqrt(_squares(mean(F.col("s"), F.col("n")), other)).alias("centroid_distance"))
    spread = rows.join(told.select("label", "person", "mean"), ["label", "person"]).groupBy("label", "person").agg(F.avg(F.sqrt(_squares(F.col("features"), F.col("mean")))).alias("spread"))
    return told.drop("mean").join(spread, ["label", "person"])


def leakage_ratio(rows: DataFrame, width: int) -> DataFrame:
    """label, n_near, near and far: how much closer consecutive rows of a label are than any two of its rows.

    near is the mean squared distance of a row to the one before it in its
    stream, where both have the label; far that of all pairs of the label's
    rows, which is twice their variance.
    """
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    led = rows.withColumns({"_before": F.lag("label").over(order), "_features": F.lag("features").over(order)})
    near = F.when(F.col("_before") == F.col("label"), _squares(F.col("features"), F.col("_features")))
    variance = sum((F.var_samp(F.col("features")[i]) for i in range(1, width)), F.var_samp(F.col("features")[0]))
    return led.groupBy("label").agg(F.count(near).alias("n_near"), F.avg(near).alias("near"), (2 * variance).alias("far"))


def invariance_audit(frames: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """transform, n, invariant: whether features stay as they are under a shift, a scaling and a turn of the landmarks."""
    moved = {
        "shift": lambda p: ((p["x"] + 0.37), (p["y"] - 0.21)),
        "scale": lambda p: (p["x"] * 1.7, p["y"] * 1.7),
        "rotation": lambda p: (p["x"] * 0.8 - p["y"] * 0.6, p["x"] * 0.6 + p["y"] * 0.8),
    }

    def turned(f) -> Column:
        return F.transform("_landmarks", lambda p: F.struct(f(p)[0].alias("x"), f(p)[1].alias("y")))

    plain = hand_frame(frames, 1.0, 1.0).withColumnsRenamed({"features": "_plain", "landmarks": "_landmarks"})
    options = F.array(*[F.struct(F.lit(name).alias("transform"), turned(f).alias("landmarks")) for name, f in moved.items()])
    varied = plain.withColumn("_v", F.explode(options)).select("_plain", "_v.*")
    change = F.array_max(F.zip_with("features", "_plain", lambda a, b: F.abs(a - b)))
    return hand_frame(varied, 1.0, 1.0).groupBy("transform").agg(F.count("*").alias("n"), (F.max(change) < tolerance).alias("invariant"))
