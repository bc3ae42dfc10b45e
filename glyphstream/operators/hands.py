"""Streams with several hands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hand(operator: Callable[..., DataFrame], frames: DataFrame, *args, **options) -> DataFrame:
    """What an operator of this library gives for each hand alone: stream_id, hand_id and its other columns.

    frames has stream_id and hand_id besides what the operator takes, and may
    be a stream.  Both are the operator's key, as one string; each hand has
    motions, holds and state of its own.  Rows without stream_id are left out,
    null hand_id is a hand of its own.
    """
    key = frames.select("stream_id", "hand_id").schema
    one = F.to_json(F.struct("stream_id", "hand_id"), {"ignoreNullFields": "false"})
    told = frames.filter("stream_id is not null").withColumn("stream_id", one).drop("hand_id")
    out = operator(told, *args, **options)
    back = out.withColumn("_key", F.from_json("stream_id", key))
    return back.select("_key.stream_id", "_key.hand_id", *[c for c in out.columns if c != "stream_id"])
