"""Sources, motions, training and streaming."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphstream.operators import debounce as db
from glyphstream.operators import decision, geometry, train
from glyphstream.plans import views
from glyphstream.sources import landmarks
from glyphstream.streaming.commits import running_accuracy, settle, stream_debounce

SF = "/root/testdata/sf0.01"


def test_landmark_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    row = ["A", "p"] + [0.5] * 42
    rows = spark.createDataFrame([row], landmarks.landmark_schema())
    landmarks.append(rows, path)
    landmarks.append(rows, path)
    assert landmarks.read_landmarks(spark, path).count() == 2
    assert len(landmarks.with_landmarks(rows).first().landmarks) == 21
    with pytest.raises(ValueError):
        landmarks.append(rows.drop("person"), path)
    old = str(tmp_path / "old")
    rows.drop("person").write.csv(old, header=True)
    assert landmarks.read_landmarks(spark, old).first().person == "unknown"
    rows.select("label").write.csv(str(tmp_path / "odd"), header=True)
    with pytest.raises(ValueError):
        landmarks.read_landmarks(spark, str(tmp_path / "odd"))


def test_eval_log_migration(spark, tmp_path):
    old = spark.createDataFrame([("dim", "A", "AA", True)], landmarks.eval_schema(False))
    old.write.csv(str(tmp_path / "log"), header=True)
    log = landmarks.read_eval_log(spark, str(tmp_path / "log"))
    assert log.collect() == [("unknown", "dim", "A", "AA", True)]
    folder = str(tmp_path / "versions")
    assert not spark.sparkContext._jvm.java.io.File(landmarks.migrate(log, folder, "v1", dry_run=True)).exists()
    for _ in range(2):
        path = landmarks.migrate(log, folder, "v1")
    assert spark.read.parquet(path).count() == 1


def test_gate_takes_the_first_of_equals_and_is_strict(spark):
    rows = spark.createDataFrame([([0.9, 0.1],), ([0.85, 0.15],), ([0.45, 0.45],)], "p array<double>")
    labels = F.array(F.lit("A"), F.lit("B"))
    got = rows.select(decision.confidence_gate(F.col("p"), labels), decision.confidence_gate(F.col("p"), labels, 0.4)).collect()
    assert [tuple(r) for r in got] == [("A", "A"), ("", "A"), ("", "A")]


def test_motion_feeds_nothing(spark):
    rows = [("s", i, i not in range(3, 9), "J" if i == 1 else None, i in (2, 9), "A") for i in range(11)]
    frames = spark.createDataFrame(rows, "stream_id string, frame_no long, hand boolean, motion string, candidate boolean, gated string")
    got = decision.frame_decision(frames).orderBy("frame_no").collect()
    assert [r.fed for r in got] == ["A", None, "", None, None, None, None, "", "", "", "A"]
    assert [r.frame_no for r in got if r.clear] == [7, 8]


def test_first_fires_are_those_of_the_plain_windows(spark):
    loose = geometry.MotionConfig(shape_ratio=0.1, j_drop=0.0, j_hook=0.0, z_drop=0.0, z_travel=0.05, z_stroke=0.1)
    frames = views.frames_emb(spark, SF)
    first = lambda df: {r.stream_id: r.n for r in df.groupBy("stream_id").agg(F.min("frame_no").alias("n")).collect()}
    plain = first(geometry.motion_rules(frames, loose).filter("is_j or is_z"))
    fires = decision.motion_fires(frames, loose)
    assert plain and first(fires) == plain
    spans = sorted((r.stream_id, r.start_frame, r.frame_no) for r in fires.collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_leave_one_out_learns(spark):
    rng = random.Random(3)
    rows = [(p, label, [x + rng.random() * 0.1, 1 - x]) for p in ("a", "b", "unknown") for label, x in (("A", 0.0), ("B", 1.0)) for _ in range(20)]
    out = train.leave_one_out(spark.createDataFrame(rows, "person string, label string, features array<double>"), 2, hidden=(4,), max_iter=60).collect()
    assert sorted((r.fold, r.n) for r in out) == [("a", 40), ("b", 40)]
    assert min(r.accuracy for r in out) > 0.9


def drain(df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"stream_id": s, "frame_no": i, "t_ms": i * 33.0, "symbol": x} for s in ("a", "b") for i, x in enumerate(x for _ in range(25) for x in [rng.choice(["A", "B", ""])] * rng.randint(1, 12))]
    schema = "stream_id string, frame_no long, t_ms double, symbol string"
    batch = {tuple(r) for r in db.debounce(spark.createDataFrame(rows, schema)).select("stream_id", "symbol", "frame_no").collect()}
    folder = tmp_path / "in"
    folder.mkdir()
    # Neighbours in time change places; far later blanks move the watermark on.
    end = [[{"stream_id": s, "frame_no": 10_000 + k, "t_ms": 1e6 * (k + 1), "symbol": ""} for s in ("a", "b")] for k in range(2)]
    rows.sort(key=lambda r: r["t_ms"] + rng.random() * 500)
    for k, part in enumerate([rows[:200], rows[200:], *end]):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))  # files are read in the order of their times
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    out = drain(stream_debounce(frames, idle_ms=None), "append", "commits")
    got = {(r.stream_id, r.symbol, r.frame_no) for r in out}
    assert batch and got == batch and {r.op for r in out} == {"commit"}


def test_late_readings_are_given_out(spark, tmp_path):
    """A stream's own mark decides, whatever other streams do; what is late is not fed."""
    read = lambda s, first, last, x: [{"stream_id": s, "frame_no": i, "t_ms": i * 100.0, "symbol": x} for i in range(first, last)]
    parts = [read("a", 0, 50, "A") + read("b", 0, 5, "B"), read("a", 20, 25, "Z") + read("a", 50, 60, "A") + read("b", 5, 10, "B"), read("a", 29, 31, "Y") + read("a", 39, 41, "Y") + read("b", 2000, 2001, ""), read("a", 2000, 2001, "")]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    frames = spark.readStream.schema("stream_id string, frame_no long, t_ms double, symbol string").option("maxFilesPerTrigger", 1).json(str(folder))
    out = drain(stream_debounce(frames, idle_ms=None), "append", "late")
    late = sorted((r.stream_id, r.symbol, r.frame_no) for r in out if r.op == "late")
    # After the first file the mark of a is at 2900, after the second at 3900.
    assert late == sorted([("a", "Z", i) for i in range(20, 25)] + [("a", "Y", 29), ("a", "Y", 30)])
    fed = [r for p in parts for r in p if (r["stream_id"], r["symbol"], r["frame_no"]) not in late and r["frame_no"] < 2000]
    want = db.debounce(spark.createDataFrame(fed, "stream_id string, frame_no long, t_ms double, symbol string"))
    assert sorted((r.stream_id, r.symbol, r.frame_no) for r in out if r.op == "commit") == sorted((r.stream_id, r.symbol, r.frame_no) for r in want.collect())


def test_a_silent_stream_feeds_what_waits(spark, tmp_path):
    rows = [{"stream_id": "a", "frame_no": i, "t_ms": i * 33.0, "symbol": "A"} for i in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    frames = spark.readStream.schema("stream_id string, frame_no long, t_ms double, symbol string").json(str(tmp_path / "in"))
    query = stream_debounce(frames, idle_ms=1500).writeStream.format("memory").queryName("silent").outputMode("append").start()
    try:
        end = time.time() + 90
        while time.time() < end and not spark.table("silent").count():
            time.sleep(1)
        assert [(r.op, r.symbol, r.frame_no) for r in spark.table("silent").collect()] == [("commit", "A", 4)]
    finally:
        query.stop()


def test_settled_commits_are_those_that_stand():
    log = [(1, 0.0, [("commit", "A", 1)]), (2, 300.0, [("commit", "I", 2)]), (3, 500.0, [("retract", "I", 2), ("commit", "J", 2)]), (4, 900.0, []), (5, 1000.0, [("commit", "J", 5)]), (6, 1100.0, [("reset", None, None)]), (7, 1800.0, [("commit", "B", 7)])]
    out, held = [], []
    for frame, t, changes in log:
        final, held = settle([(frame, *c) for c in changes], held, t, 650)
        out.append([tuple(f[1:]) for f in final])
    # J of 500 ms is still held at the reset of 1100 ms, and goes with it.
    assert out == [[], [], [], [("commit", "A", 1)], [], [("reset", None, None)], []]
    assert [c[2] for _, c in held] == ["B"]


def test_running_accuracy(spark, tmp_path):
    spark.createDataFrame([("p", "dim", "A", "AB"), ("p", "dim", "C", "AB")], "person string, condition string, expected string, committed string").write.json(str(tmp_path / "log"))
    log = spark.readStream.schema("person string, condition string, expected string, committed string").json(str(tmp_path / "log"))
    assert [tuple(r) for r in drain(running_accuracy(log), "update", "accuracy")] == [("p", "dim", 2, 1)]
