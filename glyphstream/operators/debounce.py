"""The hold, switch and release machine that turns noisy readings into commits, as windows.

What the machine holds can be told without running it.  A run is a stretch of
equal readings.  A symbol that is read for switch_ms is held from then on,
whatever was held before, so what is held is the last such symbol, or the first
one after a release; how long and how often it was read are sums.

A stream is cut where its past no longer matters: after a release, and where a
run has lasted so long that its symbol is held and committed in any case.
Pieces of some minutes are searched for such places side by side; a table of one
row for each of them tells where the first readings of a piece belong.  Streams
of any length are therefore read by all cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .holds import DebounceConfig

#: Milliseconds of a stream that are searched for cuts at once.
CHUNK_MS = 600_000
#: Frame numbers that commits and motions meet by.
FRAME_BUCKET = 256


def _runs(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """rows with new (a run begins), run_t (when), k (its readings so far) and read_at (the last symbol's time)."""
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(order)
    before = F.lag("symbol").over(order)
    marked = rows.withColumns({"new": before.isNull() | (before != F.col("symbol")), "place": F.row_number().over(order)})
    began = {"run_t": last(F.col("new"), F.col("t_ms")), "k": F.col("place") - last(F.col("new"), F.col("place")) + 1, "read_at": last(F.col("symbol") != "", F.col("t_ms"))}
    return marked.withColumns(began).drop("place")


def _ends_absence(c: DebounceConfig, since: Column) -> Column:
    return (F.col("symbol") == "") & (F.col("t_ms") - since >= c.blank_ms) & (F.col("k") >= c.min_blank_frames)


def _pieces(fed: DataFrame, c: DebounceConfig) -> DataFrame:
    """fed with piece, and entered: the reading only tells that its symbol is held and committed as the piece begins.

    A reading that ends a piece so is in both.  In a chunk that begins within an
    absence the last symbol's time is not known; where even its own blanks are
    enough nothing can be held any more.
    """
    chunk = Window.partitionBy("stream_id", "chunk").orderBy("t_ms", "frame_no")
    rows = _runs(fed.withColumn("chunk", F.floor(F.col("t_ms") / CHUNK_MS)), chunk)
    sure = (F.col("symbol") != "") & (F.col("t_ms") - F.col("run_t") >= max(c.switch_ms, c.min_hold_ms)) & (F.col("k") >= c.min_hold_frames)
    over = _ends_absence(c, F.coalesce("read_at", "run_t"))
    told = rows.withColumn("sure", sure).withColumn("over", over)
    first = lambda name: F.col(name) & ~(F.coalesce(F.lag(name).over(chunk), F.lit(False)) & ~F.col("new"))
    cut = told.withColumns({"sure": first("sure"), "over": first("over")}).withColumn("cuts", F.count_if(F.col("sure") | F.col("over")).over(chunk))
    ends = cut.groupBy("stream_id", "chunk").agg(F.max("cuts").alias("n"))
    earlier = Window.partitionBy("stream_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    owner = ends.select("stream_id", "chunk", F.last(F.when(F.col("n") > 0, F.struct("chunk", F.col("n").alias("cuts"))), ignorenulls=True).over(earlier).alias("owner"))
    here = F.struct("chunk", "cuts")
    both = cut.join(owner, ["stream_id", "chunk"]).withColumn("before", F.col("cuts") - F.col("sure").cast("int"))
    ending = F.when(F.col("before") > 0, F.struct("chunk", F.col("before").alias("cuts"))).otherwise(F.col("owner"))
    piece = lambda of, entered: F.struct(of.alias("piece"), F.lit(entered).alias("entered"))
    as_read = F.array(piece(F.when(F.col("cuts") > 0, here).otherwise(F.col("owner")), False))
    dealt = both.withColumn("p", F.explode(F.when(F.col("sure"), F.array(piece(ending, False), piece(here, True))).otherwise(as_read)))
    return dealt.select("stream_id", "p.piece", "p.entered", "frame_no", "t_ms", "symbol")


def debounce(frames: DataFrame, config: DebounceConfig = DebounceConfig()) -> DataFrame:
    """stream_id, symbol, frame_no, t_ms of the commits of each stream of fed readings.

    frames has stream_id, frame_no, t_ms and symbol ('' is no reading); rows
    with a null symbol, stream_id or t_ms are not fed.  Only a stream without a
    single long run or absence is read as a whole.
    """
    c = config
    fed = frames.filter("symbol is not null and stream_id is not null and t_ms is not null").select("stream_id", "frame_no", F.col("t_ms").cast("double").alias("t_ms"), "symbol")
    in_piece = Window.partitionBy("stream_id", "piece").orderBy("t_ms", "frame_no")
    rows = _runs(_pieces(fed, c), in_piece).withColumn("release", F.coalesce(_ends_absence(c, F.col("read_at")), F.lit(False)))
    parted = rows.withColumn("segment", F.coalesce(F.count_if("release").over(in_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Absences have told what they can; short ones change nothing.
    read = parted.filter("symbol <> ''")
    now = Window.partitionBy("stream_id", "piece", "segment").orderBy("t_ms", "frame_no")
    before = now.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when, value, over: F.last(F.when(when, F.col(value)), ignorenulls=True).over(over)
    takes = F.lag("t_ms").over(now).isNull() | (F.col("t_ms") - F.col("run_t") >= c.switch_ms)
    held = read.withColumn("takes", takes).withColumns({"cur": last(F.col("takes"), "symbol", now), "was": last(F.col("takes"), "symbol", before)})
    begins = F.col("takes") & (F.col("was").isNull() | (F.col("was") != F.col("symbol")))
    holds = held.filter(F.col("symbol") == F.col("cur")).withColumn("begins", begins).withColumns({"hold": F.count_if("begins").over(now), "seen": F.row_number().over(now)})
    since = {"start": last(F.col("begins"), "run_t", now), "n": F.col("seen") + last(F.col("begins"), "k", now) - last(F.col("begins"), "seen", now)}
    enough = F.col("entered") | ((F.col("t_ms") - F.col("start") >= c.min_hold_ms) & (F.col("n") >= c.min_hold_frames))
    ready = holds.withColumns(since).filter(enough)
    first = ready.withColumn("of", F.lag("hold").over(now)).filter("of is null or of <> hold")
    # A symbol commits once until an absence, however often it is taken over in between.
    news = first.withColumn("of", F.lag("symbol").over(now)).filter("not entered and (of is null or of <> symbol)")
    return news.select("stream_id", "symbol", "frame_no", "t_ms")


def debounce_parts(frames: DataFrame, config: DebounceConfig = DebounceConfig()) -> DataFrame:
    """stream_id, part, symbol, frame_no, t_ms: the commits of streams that are cut, with how many cuts came before.

    frames has a boolean ``cut`` besides: such a row is not read, and the
    machine starts anew after it, as it does after a motion and after a reset.
    """
    order = Window.partitionBy("stream_id").orderBy("t_ms", "frame_no")
    parted = frames.withColumn("part", F.count_if("cut").over(order)).filter(~F.col("cut"))
    commits = debounce(parted.withColumn("stream_id", F.struct("stream_id", "part")), config)
    return commits.select("stream_id.stream_id", "stream_id.part", "symbol", "frame_no", "t_ms")


def after_reset(frames: DataFrame, config: DebounceConfig = DebounceConfig()) -> DataFrame:
    """stream_id, symbol, frame_no, t_ms of the commits since each stream's last reset; a reset is a row whose cut is true."""
    last = frames.groupBy("stream_id").agg(F.count_if("cut").alias("part"))
    return debounce_parts(frames, config).join(last, ["stream_id", "part"], "left_semi").drop("part")


def retracted(commits: DataFrame, fires: DataFrame, how: str = "inner") -> DataFrame:
    """The commits (stream_id, symbol, frame_no) that a motion took back, with its end_frame; how: as a join, left_anti for the others.

    fires has stream_id, start_frame and frame_no; it takes back the commits
    from start_frame to frame_no.  Both meet by buckets of frame numbers.
    """
    bucket = lambda c: F.floor(c / FRAME_BUCKET)
    spans = fires.select(F.col("stream_id").alias("of"), "start_frame", F.col("frame_no").alias("end_frame"), F.explode(F.sequence(bucket(F.col("start_frame")), bucket(F.col("frame_no")))).alias("bucket"))
    met = commits.select("stream_id", "symbol", "frame_no").withColumn("place", bucket(F.col("frame_no")))
    back = (F.col("stream_id") == F.col("of")) & (F.col("place") == F.col("bucket")) & F.col("frame_no").between(F.col("start_frame"), F.col("end_frame"))
    return met.join(spans, back, how).drop("place", "bucket", "of", "start_frame")


def retract(commits: DataFrame, fires: DataFrame) -> DataFrame:
    """Commits without those that a motion took back, and the motions' own (stream_id, symbol, start_frame, frame_no).

    A motion's commit bears at_frame, the last frame fed before it, if fires
    has that column, and frame_no otherwise.
    """
    at = "at_frame" if "at_frame" in fires.columns else "frame_no"
    return retracted(commits, fires, "left_anti").unionByName(fires.select("stream_id", "symbol", F.col(at).alias("frame_no")))
