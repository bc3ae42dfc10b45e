"""Where intermediate tables go, and other helpers around a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet row groups of intermediate tables: a writer holds one in memory.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a
    session in local mode (tests), whose executors are the driver, gets a
    temporary folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: The paths of the innermost ``scratch``, if there is one.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, also where it ends by an error.

    What is still wanted then must have been written elsewhere: a DataFrame that
    reads one of these tables fails afterwards.
    """
    paths: list[str] = []
    before = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a later loss of an executor costs no more than the
    rows that it was just working on, and several readers share one result.
    The table stays after the query, as results may read it late, unless a
    ``scratch`` is around.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_shuffle(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, a setting that is to be raised with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def place_of(docs: DataFrame, name: str) -> int:
    """Where the column of a name stands; one of the same case comes before others."""
    if name in docs.columns:
        return docs.columns.index(name)
    return [c.lower() for c in docs.columns].index(name)


def by_place(docs: DataFrame, results: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """docs with its columns named _0, _1, ..., and the columns that give back their names.

    Columns with the names of results, in any case, are left out of the second.
    No name of docs can then clash with one that an operator makes.
    """
    replaced = {r.lower() for r in results}
    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    return plain, [F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in replaced]
