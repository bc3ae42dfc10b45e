"""Operators on ordered streams that window functions express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut_lineage

#: A position behind all others.
NEVER = 1 << 62


def _in_order(*order: str) -> Window:
    return Window.partitionBy("stream_id").orderBy(*order)


def runs(rows: DataFrame, value: str, order: str) -> DataFrame:
    """rows with ``run``: the number of the run of equal consecutive values."""
    w = _in_order(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("run", F.sum(new.cast("int")).over(w))


def bursts(log: DataFrame) -> DataFrame:
    """stream_id, label, start, end (exclusive) of runs of equal consecutive labels, by position from 0."""
    placed = log.withColumn("i", F.row_number().over(_in_order("seq")) - 1)
    grouped = runs(placed, "label", "seq").groupBy("stream_id", "run").agg(F.first("label").alias("label"), F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return grouped.select("stream_id", "label", F.col("start").cast("long"), F.col("end").cast("long"))


#: Bursts of a stream that are read as one piece when sessions are cut.
PIECE = 4096


def _led(log: DataFrame, piece: int) -> DataFrame:
    """Bursts with ``k`` (position from 0), ``piece`` and ``next``: the burst that ends a session that starts there."""
    placed = bursts(log).withColumn("k", (F.row_number().over(_in_order("start")) - 1).cast("long"))
    again = F.when(F.col("label").isNotNull(), F.lead("k").over(Window.partitionBy("stream_id", "label").orderBy("k")))
    # From the last burst on: a frame that ends at the partition's end would be read anew for each row.
    ahead = Window.partitionBy("stream_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    led = placed.withColumn("_again", again).withColumn("next", F.coalesce(F.min("_again").over(ahead), F.lit(NEVER))).drop("_again")
    return led.withColumn("piece", F.floor(F.col("k") / piece))


def _ends(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of bursts in order of stream and piece, a piece's last one first: where a chain of sessions that comes in at one leaves the piece.

    Bursts next to each other with one end are told by the first of them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, last = {}, 0
        for rows in batches:
            at, came, left, lasts = [], [], [], []
            for i, (k, following) in enumerate(zip(rows["k"].to_pylist(), rows["next"].to_pylist())):
                last = last if ends else k
                ends[k] = ends[following] if following <= last else following
                for told in [k + 1] * (k < last and ends[k + 1] != ends[k]) + [k] * (k % size == 0):
                    at.append(i)
                    came.append(told)
                    left.append(ends[told])
                    lasts.append(last)
                if k % size == 0:
                    ends = {}
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([rows["stream_id"].take(kept), rows["piece"].take(kept), *(pa.array(x, pa.int64()) for x in (came, left, lasts))], names=["stream_id", "piece", "came", "left", "last"])

    return task


def _entries(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of ends in order of stream, piece and ``came``: the burst with which the first session that starts in a piece begins, as a row before its bursts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = then = 0
        for rows in batches:
            first, entry = [], []
            for i, (came, left, last) in enumerate(zip(rows["came"].to_pylist(), rows["left"].to_pylist(), rows["last"].to_pylist())):
                if came % size == 0:
                    at = then = then if came else 0
                    first.append(i)
                    # A session may go on through the whole piece.
                    entry.append(at if at <= last else NEVER)
                if came <= at <= last:
                    then = left
            kept = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([rows["stream_id"].take(kept), rows["piece"].take(kept), pa.array([-1] * len(first), pa.int64()), pa.array(entry, pa.int64())], names=["stream_id", "piece", "k", "next"])

    return task


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of bursts in order of stream, piece and k, after their piece's entry: which of them start a session."""
    at = NEVER
    for rows in batches:
        starts = []
        for k, following in zip(rows["k"].to_pylist(), rows["next"].to_pylist()):
            if k <= 0:
                at = following if k < 0 else 0
            starts.append(k == at)
            if k == at:
                at = following
        told = [rows[c] for c in ("stream_id", "k", "start", "end", "label")]
        yield pa.RecordBatch.from_arrays([*told, pa.array(starts, pa.bool_())], names=["stream_id", "k", "start", "end", "label", "starts"]).filter(pc.greater_equal(rows["k"], 0))


def sessions(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """stream_id, start, end, label, session: a burst whose label the session has already seen opens a new one.

    A session that starts at a burst ends before the first burst, from there on,
    that repeats a label.  Streams of more than a piece are read in pieces: each
    one by itself, for any burst at which a session may come in; only what comes
    out of which is put in order by stream, and then each piece is read again
    from its own first session.  Tasks read the pieces that they hold one after
    another, so that many short streams cost no more than a few long ones.  A
    null label is never seen again.
    """
    kind, of = (log.schema[c].dataType.simpleString() for c in ("stream_id", "label"))
    n = F.count("*").over(Window.partitionBy("stream_id"))
    several = _led(log.withColumn("_n", n).filter(F.col("_n") > piece), piece)
    back = several.select("stream_id", "piece", "k", "next").repartition("stream_id", "piece").sortWithinPartitions("stream_id", "piece", F.desc("k"))
    ends = back.mapInArrow(_ends(piece), f"stream_id {kind}, piece long, came long, left long, last long")
    entries = ends.repartition("stream_id").sortWithinPartitions("stream_id", "piece", "came").mapInArrow(_entries(piece), f"stream_id {kind}, piece long, k long, next long")
    both = _led(log, piece).unionByName(entries, allowMissingColumns=True).repartition("stream_id", "piece").sortWithinPartitions("stream_id", "piece", "k")
    told = both.mapInArrow(_starts, f"stream_id {kind}, k long, start long, end long, label {of}, starts boolean")
    return told.select("stream_id", "start", "end", "label", (F.sum(F.col("starts").cast("int")).over(_in_order("k")) - 1).cast("int").alias("session"))


def session_labels(log: DataFrame) -> DataFrame:
    """stream_id, session, label, n: rows by session and label, worked out once and kept (``cut_lineage``)."""
    cut = sessions(log).withColumn("n", F.col("end") - F.col("start"))
    return cut_lineage(cut.groupBy("stream_id", "session", "label").agg(F.sum("n").alias("n")))


def name_sessions(asked: DataFrame, names: DataFrame, n_letters: int) -> DataFrame:
    """stream_id, session, label, person, n: session_labels under the session's person; see attribute_person.

    Names are compared with the numbers of sessions, one row each: a full join
    with the labels themselves would bring a session's rows of all streams to
    one task, where an inner join can be broadcast or split.
    """
    told = names.groupBy("session").agg(F.count("*").alias("_names"), F.first("person").alias("person"))
    both = asked.select("session").distinct().withColumn("_cut", F.lit(True)).join(told, "session", "full")
    right = F.col("_cut").isNotNull() & F.coalesce(F.col("_names") == 1, F.lit(False)) & F.col("person").isNotNull()
    named = asked.join(both.filter(right).select("session", "person"), "session")
    person = F.when(F.length("label") > n_letters, "unknown").otherwise(F.col("person"))
    # A name without a session fails as a session without a name does.
    refused = F.raise_error(F.concat(F.lit("sessions and names do not match at session "), F.coalesce(F.col("session").cast("string"), F.lit("null"))))
    nothing = {c: F.lit(None).cast(asked.schema[c].dataType) for c in ("stream_id", "label", "n")}
    wrong = both.filter(~right).select("session", refused.cast("string").alias("person")).withColumns(nothing)
    columns = ("stream_id", "session", "label", "person", "n")
    return named.withColumn("person", person).select(*columns).unionByName(wrong.select(*columns))


def attribute_person(log: DataFrame, names: DataFrame, n_letters: int) -> DataFrame:
    """stream_id, session, label, person, n: rows by session and label under the session's person.

    names has session and person, one row for each session there is; else the
    query fails.  Labels of more than n_letters characters are of an unknown person.
    """
    return name_sessions(session_labels(log), names, n_letters)


def run_commit(frames: DataFrame, length: int = 3) -> DataFrame:
    """stream_id, symbol, frame_no: the ``length``-th frame of every run of one symbol commits it."""
    w = Window.partitionBy("stream_id", "run").orderBy("frame_no")
    placed = runs(frames, "symbol", "frame_no").withColumn("k", F.row_number().over(w))
    return placed.filter((F.col("k") == length) & (F.col("symbol") != "")).select("stream_id", "symbol", "frame_no")


def decimate(frames: DataFrame, every: int = 2) -> DataFrame:
    """Every ``every``-th frame that has a symbol."""
    kept = frames.filter("symbol <> ''").withColumn("k", F.row_number().over(_in_order("t_ms", "frame_no")))
    return kept.filter(F.col("k") % every == 0).drop("k")


def dropout_policy(frames: DataFrame, tolerance: int = 5) -> DataFrame:
    """frames with ``fed``: null for the first misses of a run, '' from the tolerance-th on; and ``clear`` there."""
    w = Window.partitionBy("stream_id", "run").orderBy("frame_no")
    k = F.row_number().over(w)
    out = runs(frames, "symbol", "frame_no").withColumn("k", k)
    fed = F.when(F.col("symbol") != "", F.col("symbol")).when(F.col("k") >= tolerance, "")
    return out.select("stream_id", "frame_no", "t_ms", fed.alias("fed"), ((F.col("symbol") == "") & (F.col("k") >= tolerance)).alias("clear"))


def distinct_until_changed(tokens: DataFrame) -> DataFrame:
    """Non-empty values that differ from the last one emitted."""
    full = tokens.filter("label <> ''")
    return full.withColumn("p", F.lag("label").over(_in_order("pos"))).filter("p is null or p <> label").drop("p")


def confirmed_string(commits: DataFrame, last: int = 40) -> DataFrame:
    """stream_id, confirmed (commits joined) and raw (joined by spaces, the last characters)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "symbol"))), lambda c: c["symbol"])
    out = commits.groupBy("stream_id").agg(ordered.alias("s"))
    return out.select("stream_id", F.array_join("s", "").alias("confirmed"), F.right(F.array_join("s", " "), F.lit(last)).alias("raw"))


def rate_floor(frames: DataFrame, min_samples: int = 8, window: int = 650) -> DataFrame:
    """stream_id, n, longest_gap and can_fire: whether so many samples fit a window at the mean gap."""
    gap = F.col("t_ms") - F.lag("t_ms").over(_in_order("t_ms", "frame_no"))
    out = frames.withColumn("gap", gap).groupBy("stream_id").agg(F.count("*").alias("n"), F.max("gap").alias("longest_gap"), F.sum("gap").alias("span"))
    return out.select("stream_id", "n", "longest_gap", (F.col("span") * (min_samples - 1) <= window * (F.col("n") - 1)).alias("can_fire"))


def smoothed_symbol(frames: DataFrame, size: int = 6) -> DataFrame:
    """stream_id, frame_no, smoothed, n: the majority of the last readings since a frame without one; ties go to the one seen first."""
    w = Window.partitionBy("stream_id", "part").orderBy("frame_no").rowsBetween(-(size - 1), 0)
    part = F.sum((F.col("symbol") == "").cast("int")).over(_in_order("frame_no"))
    held = frames.withColumn("part", part).filter("symbol <> ''").withColumn("h", F.collect_list("symbol").over(w))
    tally = F.transform(F.array_distinct("h"), lambda s: F.struct(F.size(F.filter("h", lambda x: x == s)).alias("n"), F.negative(F.array_position("h", s)).alias("p"), s.alias("s")))
    best = F.array_max(tally)
    return held.select("stream_id", "frame_no", best["s"].alias("smoothed"), best["n"].cast("long").alias("n"))


def repeat_audit(commits: DataFrame, frames: DataFrame, blank_ms: int) -> DataFrame:
    """stream_id, frame_no, longest_blank of commits that repeat the one before, and whether a blank of blank_ms lies between.

    Commits and runs of blanks are put in one order, in which the number of
    commits so far tells between which two a blank lies.
    """
    blanks = runs(frames, "symbol", "frame_no").groupBy("stream_id", "run").agg(F.first("symbol").alias("s"), F.min("frame_no").alias("frame_no"), (F.max("t_ms") - F.min("t_ms")).alias("span")).filter("s = ''")
    nothing = lambda kind: F.lit(None).cast(kind)
    events = commits.select("stream_id", "frame_no", "symbol", nothing("long").alias("span")).unionByName(blanks.select("stream_id", "frame_no", nothing("string").alias("symbol"), F.col("span").cast("long").alias("span")))
    order = _in_order("frame_no")
    n = events.withColumn("n", F.count("symbol").over(order))
    between = n.filter("symbol is null").groupBy("stream_id", "n").agg(F.max("span").alias("span"))
    again = n.filter("symbol is not null").withColumn("p", F.lag("symbol").over(order)).filter("p = symbol").select("stream_id", "frame_no", (F.col("n") - 1).alias("n"))
    out = again.join(between, ["stream_id", "n"], "left").select("stream_id", "frame_no", F.coalesce("span", F.lit(0)).alias("longest_blank"))
    return out.withColumn("allowed", F.col("longest_blank") >= blank_ms)


def captures(markers: DataFrame, frames: DataFrame, length: int) -> DataFrame:
    """stream_id, marker, n, text: the symbols read within ``length`` from each marker on, '' if there are none.

    markers has stream_id, marker (its name, one row each) and t0; frames has
    stream_id, frame_no, t_ms and symbol, and may as well be commits.  Time is
    cut into pieces of ``length``; a marker meets the frames of its own piece
    and of the next one.  Markers without a name, stream or time are left out.
    """
    piece = lambda t: F.floor(F.col(t) / length)
    asked = markers.filter("stream_id is not null and marker is not null and t0 is not null").select("stream_id", "marker", "t0", F.explode(F.array(piece("t0"), piece("t0") + 1)).alias("piece"))
    read = frames.select("stream_id", piece("t_ms").alias("piece"), "frame_no", "symbol", "t_ms")
    met = asked.join(read, ["stream_id", "piece"], "left")
    inside = (F.col("t_ms") >= F.col("t0")) & (F.col("t_ms") < F.col("t0") + length)
    told = F.collect_list(F.when(inside, F.struct("frame_no", "symbol")))
    return met.groupBy("stream_id", "marker").agg(F.count_if(inside).alias("n"), captured_text(told).alias("text"))


def captured_text(told: Column) -> Column:
    """The symbols of an array of (frame_no, symbol), in the order of frames."""
    return F.array_join(F.transform(F.array_sort(told), lambda x: x["symbol"]), "")


def capture_windows(frames: DataFrame, every: int, length: int) -> DataFrame:
    """stream_id, marker, n, text: what is read within ``length`` after every ``every``-th frame."""
    markers = frames.filter(F.col("frame_no") % every == 0).select("stream_id", F.col("frame_no").alias("marker"), F.col("t_ms").alias("t0"))
    return captures(markers, frames, length)


def clean_key(value: Column) -> Column:
    """A name in lower case without outer spaces; null unless it is of letters, digits, '-' and '_'."""
    out = F.lower(F.trim(value))
    return F.when(out.rlike(r"^[\p{L}\p{N}_-]+$"), out)
