"""Connected components by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(links: DataFrame) -> DataFrame:
    """node and its component: the smallest node that links (columns a, b) lead to.

    Alternates large-star and small-star steps: every node is linked to the
    least node it knows, which halves depths, so a few rounds do.  Each round
    is written to the shared folder; links never gather in one place.
    """
    told = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())  # noqa: E731  edges are distinct
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = told(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the least node of the neighbourhood
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = materialize(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state, edges = state, told(small), small
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
