"""The change log of a stream as versioned tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recognise import CHANGE, CHANGE_SQL
from ..sources.landmarks import migrate

STANDING_SQL = "stream_id string, symbol string, frame_no long, n long"


def _written(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the folder's name=... whose writes were committed, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def read_changes(spark: SparkSession, folder: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """batch_id and the changes of the batches in (after, upto] that were written whole."""
    batches = [b for b in _written(spark, f"{folder}/changes", "batch") if b > after and (upto is None or b <= upto)]
    if not batches:
        return spark.createDataFrame([], f"batch_id long, {CHANGE_SQL}")
    paths = [f"{folder}/changes/batch={b}" for b in batches]
    return spark.read.schema(f"batch_id long, {CHANGE_SQL}").parquet(*paths)


def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
    """stream_id, symbol, frame_no and n of what stands of a table of these and of the changes that came after it.

    A stream's reset takes all that was there before; a retract takes one
    commit of its symbol and frame.
    """
    resets = changes.filter("op = 'reset'").groupBy(F.col("stream_id").alias("of")).agg(F.max(F.struct("batch_id", "frame_no")).alias("last"))
    same = F.col("stream_id") == F.col("of")
    kept = base.join(resets, same, "left_anti")
    place = F.struct("batch_id", "frame_no")
    live = changes.filter("op <> 'reset'").join(resets, same, "left").filter(F.col("last").isNull() | (place > F.col("last")))
    signed = live.select("stream_id", "symbol", F.col("at_frame").alias("frame_no"), F.when(F.col("op") == "commit", 1).otherwise(-1).cast("long").alias("n"))
    return kept.unionByName(signed).groupBy("stream_id", "symbol", "frame_no").agg(F.sum("n").alias("n")).filter("n > 0")


def _merged(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The latest version of at most upto, merged with the batches after it."""
    versions = [v for v in _written(spark, f"{folder}/standing", "upto") if upto is None or v <= upto]
    if not versions:
        return merge(spark.createDataFrame([], STANDING_SQL), read_changes(spark, folder, upto=upto))
    base = spark.read.schema(STANDING_SQL).parquet(f"{folder}/standing/upto={versions[-1]}")
    return merge(base, read_changes(spark, folder, versions[-1], upto))


def standing_commits(spark: SparkSession, folder: str) -> DataFrame:
    """stream_id, symbol, frame_no of the commits that stand after the last batch that was written whole."""
    return _merged(spark, folder).select("stream_id", "symbol", "frame_no")


def change_log_sink(folder: str, merge_every: int = 20) -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes to keep a change log (as of stream_recognise) in a folder.

    changes/batch=N has what batch N brought.  Every merge_every batches
    standing/upto=N has the commits that stand after batch N, from the version
    before it and the batches since, so a batch costs what it brings and a
    merge what stands; earlier versions stay.  Both are there once their writes
    were committed: a batch that is replayed changes nothing, and one whose
    write broke off is written again.  Batches are told apart by their numbers,
    so a folder belongs to one checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = batch.select(F.lit(batch_id).cast("long").alias("batch_id"), *CHANGE)
        migrate(told, f"{folder}/changes", f"batch={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            migrate(_merged(spark, folder, batch_id), f"{folder}/standing", f"upto={batch_id}")

    return write
