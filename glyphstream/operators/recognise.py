"""From frames to a change log of commits: motions, then the frame's decision, then holds.

``recognise`` chains the operators of batches, each of which cuts streams where
their past no longer matters.  ``Recogniser`` does the same frame by frame, for
running streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut_lineage
from .debounce import debounce_parts, retracted
from .decision import motion_candidates, motion_fires
from .geometry import MotionConfig, samples
from .holds import DebounceConfig, Holds
from .motion import MotionBuffer

CHANGE_SQL = "stream_id string, frame_no long, op string, symbol string, at_frame long"
CHANGE = ["stream_id", "frame_no", "op", "symbol", "at_frame"]


def frame_fields(motion: MotionConfig) -> tuple[str, ...]:
    """What a frame brings: its place, whether it has a hand, its gated class, whether it is a reset, and its sample."""
    return ("t_ms", "frame_no", "hand", "gated", "reset", *motion.sample[2:])


class Recogniser:
    """One stream, frame by frame.

    A motion's commit bears the number of the last frame that was fed to the
    holds, 0 before any.  Its changes are (frame_no, op, symbol, at_frame): a commit; a retract of the
    commit made at at_frame, which a motion turned out to be; or a reset.  A
    retract can only reach as far back as the motion window, so no more commits
    are remembered.
    """

    def __init__(self, holds: DebounceConfig, motion: MotionConfig, tolerance: int = 5, state: dict | None = None) -> None:
        state = state or {}
        self.tolerance, self.missed, self.recent = tolerance, state.get("missed", 0), [tuple(x) for x in state.get("recent", ())]
        self.fed = state.get("fed", 0)
        self.holds, self.buffer = Holds(holds, state.get("holds")), MotionBuffer(motion, state.get("buffer"))

    def state(self) -> dict:
        return {"missed": self.missed, "fed": self.fed, "recent": self.recent, "holds": self.holds.state, "buffer": list(self.buffer.held)}

    def feed(self, t: float, frame_no: int, hand: bool, gated: str, reset: bool, *marks) -> list[tuple[int, str, str | None, int | None]]:
        if reset:
            self.recent, self.missed = [], 0
            self.holds.release()
            self.buffer.clear()
            return [(frame_no, "reset", None, None)]
        if not hand:
            self.missed += 1
            if self.missed < self.tolerance:
                return []
            self.buffer.clear()
            return self._read("", t, frame_no)
        self.missed = 0
        fire = self.buffer.add((t, frame_no, *marks))
        if fire is None:
            return self._read("" if self.buffer.candidate() else gated, t, frame_no)
        letter, first = fire
        back = [(frame_no, "retract", symbol, at) for at, symbol in self.recent if at >= first]
        self.recent = [x for x in self.recent if x[0] < first] + [(self.fed, letter)]
        self.holds.release()
        return [*back, (frame_no, "commit", letter, self.fed)]

    def _read(self, symbol: str, t: float, frame_no: int) -> list[tuple[int, str, str | None, int | None]]:
        oldest = self.buffer.held[0][1] if self.buffer.held else frame_no
        self.recent = [x for x in self.recent if x[0] >= oldest]
        self.fed = frame_no
        committed = self.holds.feed(symbol, t)
        if committed is None:
            return []
        self.recent.append((frame_no, committed))
        return [(frame_no, "commit", committed, frame_no)]


def frame_rows(frames: DataFrame, motion: MotionConfig) -> DataFrame:
    """stream_id and the fields of frames; frames has landmarks, hand and gated, and may have a boolean reset."""
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in frames.columns else F.lit(False)
    told = samples(frames.withColumn("reset", reset), "hand", "gated", "reset", signs=motion.signs)
    return told.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("t_ms").cast("double").alias("t_ms"), *frame_fields(motion)[1:])


def recognise(frames: DataFrame, holds: DebounceConfig = DebounceConfig(), motion: MotionConfig = MotionConfig(), tolerance: int = 5) -> DataFrame:
    """The change log (stream_id, frame_no, op, symbol, at_frame) of each stream of frames.

    frames has stream_id, frame_no, t_ms, landmarks, hand (boolean), gated
    ('' is no reading) and optionally reset, and is read in the order of (t_ms,
    frame_no).  Null gated counts as no reading, null hand as no hand; rows
    without stream_id or t_ms are left out.
    """
    told = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in frames.columns else F.lit(other)
    rows = frames.filter("stream_id is not null and t_ms is not null").select(F.col("stream_id").cast("string").alias("stream_id"), "frame_no", F.col("t_ms").cast("double").alias("t_ms"), "landmarks", told("hand", False).alias("hand"), told("gated", "").alias("gated"), told("reset", False).alias("reset"))
    order = Window.partitionBy("stream_id").orderBy("t_ms", "frame_no")
    stays = F.col("hand") | F.col("reset")
    parted = rows.withColumn("part", F.count_if(stays).over(order))
    missed = F.count_if(~stays).over(Window.partitionBy("stream_id", "part").orderBy("t_ms", "frame_no"))
    marked = parted.withColumn("lost", ~stays & (missed >= tolerance)).drop("part")
    seen = marked.filter("hand or lost or reset").withColumn("clear", F.col("lost") | F.col("reset"))
    judged = motion_candidates(seen, motion_fires(seen, motion), motion).withColumnRenamed("symbol", "motion")
    decided = marked.drop("landmarks").join(judged, ["stream_id", "frame_no"], "left")
    fed = F.when(F.col("lost"), F.lit("")).when(~F.col("hand") | F.col("reset") | F.col("motion").isNotNull(), F.lit(None)).when(F.col("candidate"), F.lit("")).otherwise(F.col("gated"))
    read = decided.withColumn("symbol", fed)
    at = F.coalesce(F.last(F.when(F.col("symbol").isNotNull(), F.col("frame_no")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Commits, motions and resets all come from these.
    placed = cut_lineage(read.select("stream_id", "frame_no", "t_ms", "symbol", "motion", "start_frame", "reset", at.cast("long").alias("at_frame"), (F.col("reset") | F.col("motion").isNotNull()).alias("cut")))
    commits = debounce_parts(placed.select("stream_id", "frame_no", "t_ms", "symbol", "cut"), holds).select("stream_id", "symbol", "frame_no")
    moved = placed.filter("motion is not null").select("stream_id", "start_frame", "frame_no", F.col("motion").alias("symbol"), "at_frame")
    change = lambda df, op, symbol, at: df.select("stream_id", "frame_no", F.lit(op).alias("op"), symbol.cast("string").alias("symbol"), at.cast("long").alias("at_frame"))
    back = retracted(commits, moved).select("stream_id", F.col("end_frame").alias("frame_no"), "symbol", F.col("frame_no").alias("at_frame"))
    symbol, at = F.col("symbol"), F.col("at_frame")
    logs = (change(commits, "commit", symbol, F.col("frame_no")), change(back, "retract", symbol, at), change(moved, "commit", symbol, at), change(placed.filter("reset"), "reset", F.lit(None), F.lit(None)))
    return logs[0].unionByName(logs[1]).unionByName(logs[2]).unionByName(logs[3])


def standing(changes: DataFrame) -> DataFrame:
    """stream_id, symbol, frame_no of the commits that stand: neither taken back nor before the stream's last reset."""
    order = Window.partitionBy("stream_id")
    last = F.max(F.when(F.col("op") == "reset", F.col("frame_no"))).over(order)
    live = changes.withColumn("last", last).filter("op <> 'reset' and (last is null or frame_no > last)")
    left = F.sum(F.when(F.col("op") == "commit", 1).otherwise(-1))
    return live.groupBy("stream_id", F.col("at_frame").alias("frame_no"), "symbol").agg(left.alias("left")).filter("left > 0").select("stream_id", "symbol", "frame_no")
