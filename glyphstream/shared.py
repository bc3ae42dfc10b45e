"""Cutting the lineage of tables that several steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the folder that the cluster names in spark.checkpoint.dir.

    Only a session in local mode, whose executors are the driver, may leave it
    unset; it then gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()
