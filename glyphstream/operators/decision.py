"""What each frame feeds to the debouncer: motions first, then gated classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .geometry import MotionConfig, samples
from .motion import MotionBuffer


def confidence_gate(probabilities: Column, labels: Column, threshold: float = 0.85) -> Column:
    """The label of the largest probability (the first one on ties) if it is above the threshold, else ''."""
    best = F.array_max(probabilities)
    return F.when(best > threshold, F.get(labels, (F.array_position(probabilities, best) - 1).cast("int"))).otherwise(F.lit(""))


def frame_decision(frames: DataFrame, tolerance: int = 5) -> DataFrame:
    """frames with ``fed`` (the symbol for the debouncer, null if none) and ``clear`` (the motion buffer is emptied).

    frames has stream_id, frame_no, hand, motion (a letter that fires, or
    null), candidate and gated.  A motion is committed apart and feeds nothing;
    a candidate feeds ''; else the gated class counts.  Without a hand nothing
    is fed until the tolerance-th missed frame in a row, and '' from then on.
    """
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    part = F.sum(F.col("hand").cast("long")).over(order)
    missed = F.count_if(~F.col("hand")).over(Window.partitionBy("stream_id", "_part").orderBy("frame_no"))
    counted = frames.withColumn("_part", part).withColumn("_missed", missed)
    lost = ~F.col("hand") & (F.col("_missed") >= tolerance)
    fed = F.when(lost, F.lit("")).when(~F.col("hand") | F.col("motion").isNotNull(), F.lit(None)).when(F.col("candidate"), F.lit("")).otherwise(F.col("gated"))
    return counted.withColumns({"fed": fed, "clear": lost}).drop("_part", "_missed")


#: Milliseconds of a stream whose windows are worked out at once.
BLOCK_MS = 60_000


def _may(c: MotionConfig, w: WindowSpec) -> Column:
    """Whether some sign's rule may hold over any last part of the window: false where no buffer, however it was emptied, can fire."""
    rules = []
    for r in c.signs:
        tip, centre, stroke = F.col(f"{r.tip}_y"), F.col(f"c{r.travel_axis}"), F.col(f"{r.tip}_{r.stroke_axis}")
        side = F.col(f"{r.tip}_x")
        reach = lambda x: F.max(x).over(w) - F.min(x).over(w)
        tests = [F.count_if(F.col(r.shape)).over(w) >= c.shape_ratio * c.min_samples]
        tests += [tip - F.min(tip).over(w) > r.drop] * (r.drop is not None) + [reach(side) > (r.hook or 0.0)] * (r.hook is not None)
        tests += [reach(centre) >= (r.travel or 0.0)] * (r.travel is not None) + [reach(stroke) >= r.stroke] * (r.strokes > 0)
        rules.append(reduce(and_, tests))
    return (F.count("*").over(w) >= c.min_samples) & reduce(or_, rules, F.lit(False))


def motion_segments(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """The samples that motions can begin or end in, as stream_id, part, chain and c.sample; no motion needs samples of two chains.

    A buffer that starts anew is the plain time window once window_ms have gone
    by, so frames at which no last part of the window can fire tell chains
    apart: those of one chain are at most window_ms from each other, and the
    samples of the window before its first one belong to it.  Rows of frames
    whose ``clear`` is true end a chain.  Windows are worked out by blocks of
    time with what precedes them; only the frames that may fire are put into
    order by stream.
    """
    held = frames.filter("stream_id is not null and t_ms is not null")
    clears = held.filter("clear") if "clear" in frames.columns else held.limit(0)
    seen = held.filter("clear is null or not clear") if "clear" in frames.columns else held
    marks = samples(seen, signs=c.signs).select(F.col("stream_id").cast("string").alias("stream_id"), *c.sample)
    block = lambda t: F.floor(t / BLOCK_MS)
    own = marks.withColumn("block", block(F.col("t_ms")))
    ahead = F.when(block(F.col("t_ms") + c.window_ms) > F.col("block"), F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    copied = own.select("*", F.explode(ahead).alias("of"))
    w = Window.partitionBy("stream_id", "of").orderBy("t_ms").rangeBetween(-c.window_ms, 0)
    hits = copied.withColumn("may", _may(c, w)).filter("may and of = block").select("stream_id", "t_ms", "frame_no", F.lit(False).alias("clear"))
    ends = clears.select(F.col("stream_id").cast("string").alias("stream_id"), "t_ms", "frame_no", F.lit(True).alias("clear"))
    order = Window.partitionBy("stream_id").orderBy("t_ms", "frame_no")
    at = F.struct("t_ms", "frame_no")
    cut = hits.unionByName(ends).withColumn("part", F.count_if("clear").over(order)).withColumn("after", F.last(F.when(F.col("clear"), at), ignorenulls=True).over(order)).filter(~F.col("clear"))
    in_part = Window.partitionBy("stream_id", "part").orderBy("t_ms", "frame_no")
    far = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(in_part) > c.window_ms, F.lit(True))
    chained = cut.withColumn("far", far).withColumn("chain", F.count_if("far").over(in_part))
    chains = chained.groupBy("stream_id", "part", "chain").agg((F.min("t_ms") - c.window_ms).alias("from_t"), F.max(at).alias("to"), F.max("after").alias("after"))
    spans = chains.withColumn("block", F.explode(F.sequence(block(F.col("from_t")), block(F.col("to.t_ms")))))
    inside = (F.col("t_ms") >= F.col("from_t")) & (at <= F.col("to")) & (F.col("after").isNull() | (at > F.col("after")))
    return own.join(spans, ["stream_id", "block"]).filter(inside).select("stream_id", "part", "chain", *c.sample)


def motion_fires(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id, symbol, start_frame, frame_no of the motions of each stream; a motion empties the buffer.

    Only chains of samples that can fire are read one by one (see
    motion_segments), each by itself, in the order of (t_ms, frame_no); a task
    holds one window at a time.  frames may have a boolean ``clear``; such rows
    only empty the buffer.  Rows without stream_id or t_ms are left out.
    """
    key = ("stream_id", "part", "chain")
    dealt = motion_segments(frames, c).repartition(*key).sortWithinPartitions(*key, "t_ms", "frame_no")

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, buffer = None, MotionBuffer(c)
        for batch in it:
            out = []
            for stream, part, chain, *sample in batch[[*key, *c.sample]].itertuples(index=False, name=None):
                if (stream, part, chain) != last:
                    last = (stream, part, chain)
                    buffer.clear()
                if (fire := buffer.add(sample)) is not None:
                    out.append((stream, fire[0], fire[1], sample[1]))
            yield pd.DataFrame(out, columns=["stream_id", "symbol", "start_frame", "frame_no"])

    return dealt.mapInPandas(task, "stream_id string, symbol string, start_frame long, frame_no long")


def motion_candidates(frames: DataFrame, fires: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id (text), frame_no, symbol and start_frame of the motion that fires, if any, and candidate.

    candidate: whether a sign's hand shape is held lately and its tip moves, in
    a buffer that fires and clears empty.  frames has landmarks and ``clear``;
    rows with clear only empty the buffer.  fires: see motion_fires.
    """
    named = F.col("stream_id").cast("string").alias("stream_id")
    marks = samples(frames.filter(~F.col("clear")), signs=c.signs).select(named, *c.sample).withColumn("clear", F.lit(False))
    ends = frames.filter("clear").select(named, "t_ms", "frame_no", "clear")
    order = Window.partitionBy("stream_id").orderBy("t_ms", "frame_no")
    told = marks.unionByName(ends, allowMissingColumns=True).join(fires, ["stream_id", "frame_no"], "left")
    empties = F.col("clear") | F.col("symbol").isNotNull()
    parted = told.withColumn("part", F.count_if(empties).over(order) - empties.cast("int")).filter(~F.col("clear"))
    near = Window.partitionBy("stream_id", "part").orderBy("t_ms").rangeBetween(-c.lookback_ms, 0)
    n = F.count("*").over(near)
    verdict = F.lit(False)
    for r in reversed(c.signs):
        x, y = (F.col(f"{r.tip}_{a}") - F.first(f"{r.tip}_{a}").over(near) for a in ("x", "y"))
        verdict = F.when(F.count_if(F.col(r.shape)).over(near) >= c.shape_ratio * n, F.sqrt(x * x + y * y) > c.deadband).otherwise(verdict)
    return parted.select("stream_id", "frame_no", "symbol", "start_frame", ((n >= 3) & verdict & F.col("symbol").isNull()).alias("candidate"))
