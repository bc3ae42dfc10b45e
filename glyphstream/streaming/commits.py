"""Debouncing and running accuracy over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.geometry import MotionConfig
from ..operators.holds import DebounceConfig, Holds
from ..operators.recognise import CHANGE, CHANGE_SQL, Recogniser, frame_fields, frame_rows
from ..operators.sequence import captured_text


class _DebounceProcessor(StatefulProcessor):
    """Readings wait in a list until their stream's own mark has passed them."""

    def __init__(self, config: DebounceConfig, delay_ms: float, idle_ms: int | None) -> None:
        self.config, self.delay_ms, self.idle_ms = config, delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_ms double, frame_no long, symbol string")
        self.machine = handle.getValueState("machine", "state string, mark double, active long")

    def _fed(self, key: tuple, machine: Holds, readings: list) -> list[tuple]:
        return [(key[0], "commit", symbol, int(n), t) for t, n, x in readings if (symbol := machine.feed(x, t)) is not None]

    def _held(self) -> tuple[Holds, float, int, list]:
        state, mark, active = self.machine.get() if self.machine.exists() else (None, float("-inf"), 0)
        return Holds(self.config, json.loads(state) if state else None), mark, active, list(self.waiting.get()) if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, mark, _, waiting = self._held()
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        out = []
        for batch in rows:
            late = batch["t_ms"] < mark
            out += [(key[0], "late", x, int(n), t) for t, n, x in batch.loc[late, ["t_ms", "frame_no", "symbol"]].itertuples(index=False, name=None)]
            waiting += list(batch.loc[~late, ["t_ms", "frame_no", "symbol"]].itertuples(index=False, name=None))
        waiting.sort(key=lambda r: (r[0], r[1]))
        if waiting:
            mark = max(mark, waiting[-1][0] - self.delay_ms)
        ready = [r for r in waiting if r[0] < mark]
        out += self._fed(key, machine, ready)
        rest = waiting[len(ready) :]
        self.waiting.put([(float(t), int(n), x) for t, n, x in rest]) if rest else self.waiting.clear()
        self.machine.update((json.dumps(machine.state), float(mark), int(now)))
        if self.idle_ms:
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=READ)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, _, active, waiting = self._held()
        silent = self.machine.exists() and timerValues.getCurrentProcessingTimeInMs() - active >= self.idle_ms
        out = self._fed(key, machine, sorted(waiting, key=lambda r: (r[0], r[1]))) if silent else []
        if silent:
            self.waiting.clear()
            self.machine.clear()
        yield pd.DataFrame(out, columns=READ)

    def close(self) -> None:
        pass


READ = ["stream_id", "op", "symbol", "frame_no", "t_ms"]


def stream_debounce(frames: DataFrame, config: DebounceConfig = DebounceConfig(), delay_ms: float = 2000, idle_ms: int | None = 60_000) -> DataFrame:
    """stream_id, op, symbol, frame_no, t_ms: commits, as the batch operator gives them, and late readings.

    frames is a stream of stream_id, frame_no, t_ms and symbol.  Each stream has
    a mark of its own, delay_ms behind its latest reading at the end of a
    micro-batch.  Readings before it are fed in the order of (t_ms, frame_no);
    one that comes when the mark has passed it is not fed but given out with
    op 'late'.  A stream that is silent for idle_ms of processing time feeds
    what waits and gives up its state; the engine then runs a batch at every
    trigger, with data or without, so a query that is to end by itself takes
    None, by which state is kept.  Needs the RocksDB state store.
    """
    told = frames.filter("symbol is not null and t_ms is not null").select(F.col("stream_id").cast("string").alias("stream_id"), "frame_no", F.col("t_ms").cast("double").alias("t_ms"), "symbol")
    return told.groupBy("stream_id").transformWithStateInPandas(_DebounceProcessor(config, delay_ms, idle_ms), "stream_id string, op string, symbol string, frame_no long, t_ms double", "append", "processingTime" if idle_ms else "none")


def settle(changes: list, pending: list, t: float, window_ms: float) -> tuple[list, list]:
    """The changes that are final at time t, and the commits that a motion may still take back, each with its time.

    A motion reaches back over its window at most.  Commits are held until that
    has gone by; a retract or a reset takes those that are held and is not given out
    itself, but for the reset.
    """
    final = [list(c) for at, c in pending if t - at > window_ms]
    held = [[at, list(c)] for at, c in pending if t - at <= window_ms]
    for change in changes:
        frame_no, op, symbol, at_frame = change
        if op == "commit":
            held.append([t, list(change)])
        elif op == "retract":
            gone = next(k for k in range(len(held) - 1, -1, -1) if held[k][1][2:] == [symbol, at_frame])
            del held[gone]
        else:
            held = []
            final.append(list(change))
    return final, held


class _RecogniseProcessor(StatefulProcessor):
    """Frames wait in a list until the watermark has passed them, and are then read in order."""

    def __init__(self, holds: DebounceConfig, motion: MotionConfig, tolerance: int, idle_ms: int, settled: bool) -> None:
        self.options, self.idle_ms, self.settled = (holds, motion, tolerance), idle_ms, settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame string")
        self.machine = handle.getValueState("machine", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        came = [x for batch in rows for x in batch[list(frame_fields(self.options[1]))].values.tolist() if x[0] > mark]
        if came:
            self.waiting.appendList([(json.dumps(x),) for x in came])
            self.handle.registerTimer(max(mark + 1, int(min(x[0] for x in came))))
        yield pd.DataFrame([], columns=CHANGE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        frames = sorted((json.loads(x[0]) for x in self.waiting.get()), key=lambda x: (x[0], x[1])) if self.waiting.exists() else []
        ready = [x for x in frames if x[0] <= mark]
        rest = frames[len(ready) :]
        held, read_at, pending = json.loads(self.machine.get()[0]) if self.machine.exists() else (None, mark, [])
        if ready:
            machine = Recogniser(*self.options, held)
            for x in ready:
                changes = machine.feed(*x)
                if self.settled:
                    changes, pending = settle(changes, pending, x[0], self.options[1].window_ms)
                out += [(key[0], *change) for change in changes]
            read_at = ready[-1][0]
            self.machine.update((json.dumps([machine.state(), read_at, pending]),))
            self.waiting.put([(json.dumps(x),) for x in rest]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(int(rest[0][0]) + 1)
        elif mark < read_at + self.idle_ms:
            self.handle.registerTimer(int(read_at) + self.idle_ms + 1)
        else:
            out += [(key[0], *change) for _, change in pending]
            self.machine.clear()
        yield pd.DataFrame(out, columns=CHANGE).astype({"at_frame": "Int64"})

    def close(self) -> None:
        pass


def stream_recognise(frames: DataFrame, holds: DebounceConfig = DebounceConfig(), motion: MotionConfig = MotionConfig(), tolerance: int = 5, delay: str = "2 seconds", idle_ms: int = 60_000, settled: bool = False) -> DataFrame:
    """The change log of a stream of frames, as the batch operator gives it.

    settled: commits are given out when no motion can take them back any more,
    one window later, and retracts never.  Without resets these are the commits
    that stand.

    t_ms is the event time.  Frames wait for the watermark and are read in the
    order of (t_ms, frame_no); later ones are dropped, and the query's progress
    counts them (numRowsDroppedByWatermark).  State is a list of waiting frames
    and one machine for each stream_id, given up after idle_ms of silence; it
    needs the RocksDB state store.
    """
    rows = frame_rows(frames, motion).fillna({"hand": False, "gated": ""})
    timed = rows.withColumn("at", F.timestamp_millis(F.col("t_ms").cast("long"))).withWatermark("at", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(_RecogniseProcessor(holds, motion, tolerance, idle_ms, settled), CHANGE_SQL, "append", "eventTime")


def stream_captures(markers: DataFrame, frames: DataFrame, length_ms: int, delay: str = "2 seconds") -> DataFrame:
    """stream_id, marker, t0, n, text of two streams, as captures gives them, once a marker's window has passed.

    t_ms and t0 are event times, each under a watermark of ``delay``; later
    rows are dropped.  Both meet by stream and piece of time, so one stream is
    not one task, and the state of a marker or a frame goes when its window is
    over.  A marker without frames is given out as well.
    """
    at = lambda t: F.timestamp_micros((F.col(t) * 1000).cast("long"))
    piece = lambda t: F.floor(F.col(t) / length_ms)
    asked = markers.filter("stream_id is not null and marker is not null and t0 is not null").withColumn("opened", at("t0")).withWatermark("opened", delay)
    asked = asked.select(F.col("stream_id").cast("string").alias("stream_id"), "marker", F.col("t0").cast("double").alias("t0"), "opened", F.explode(F.array(piece("t0"), piece("t0") + 1)).alias("piece"))
    read = frames.filter("stream_id is not null and t_ms is not null").withColumn("read_at", at("t_ms")).withWatermark("read_at", delay)
    read = read.select(F.col("stream_id").cast("string").alias("of"), piece("t_ms").alias("place"), "frame_no", "symbol", "read_at")
    inside = F.expr(f"stream_id = of and piece = place and read_at >= opened and read_at < opened + interval {int(length_ms)} milliseconds")
    met = asked.join(read, inside, "left").select("stream_id", "marker", "t0", "opened", F.when(F.col("of").isNotNull(), F.struct("frame_no", "symbol")).alias("told"))
    out = met.groupBy("stream_id", "marker", "t0", "opened").agg(F.count("told").alias("n"), captured_text(F.collect_list("told")).alias("text"))
    return out.drop("opened")


def running_accuracy(log: DataFrame) -> DataFrame:
    """person, condition, n and n_ok of an evaluation stream, for update mode."""
    ok = F.col("committed").contains(F.col("expected"))
    return log.groupBy("person", "condition").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
