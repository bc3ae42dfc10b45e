"""The processor of frames: against the batch operators, by hand, and as a stream."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.operators import debounce as db
from glyphstream.operators import decision, geometry, recognise, train
from glyphstream.operators.geometry import MotionConfig, MotionRule
from glyphstream.operators.holds import DebounceConfig
from glyphstream.operators.motion import SAMPLE, MotionBuffer, stroke_signs
from glyphstream.operators.text import segment_runs
from glyphstream.plans import queries, views
from glyphstream.streaming.commits import settle, stream_recognise

SF = "/root/testdata/sf0.01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Scripted(MotionBuffer):
    """Fires where it is told to."""

    fires: dict = {}

    def add(self, sample):
        super().add(sample)
        return self.fires.get(sample[1])

    def candidate(self):
        return False


def machine(fires):
    out = recognise.Recogniser(DebounceConfig(), MotionConfig())
    out.buffer = Scripted(MotionConfig())
    out.buffer.fires = fires
    return out


def held(m, letter, count, start=0):
    changes = []
    for i in range(start, start + count):
        changes += m.feed(i * 1000 / 30, i, True, letter, False, *[0.0] * 8)
    return changes


def text(changes):
    out = []
    for frame, op, symbol, at in changes:
        if op == "reset":
            out = []
        elif op == "commit":
            out.append((at, symbol))
        else:
            out.remove((at, symbol))
    return "".join(s for _, s in out)


def test_motion_takes_back_what_it_was_misread_as():
    m = machine({20: ("J", 10)})
    changes = held(m, "A", 10) + held(m, "I", 10, 10)
    assert text(changes) == "AI"
    changes += held(m, "X", 1, 20)
    assert text(changes) == "AJ"
    assert [op for _, op, _, _ in changes] == ["commit", "commit", "retract", "commit"]


def test_motion_releases_the_hold():
    m = machine({10: ("J", 0)})
    changes = held(m, "I", 11)
    assert text(changes) == "J" and m.holds.state["cur"] is None
    assert text(changes + held(m, "I", 10, 11)) == "JI"


def test_reset_and_state():
    m = machine({})
    changes = held(m, "A", 10)
    changes += m.feed(400.0, 10, True, "A", True, *[0.0] * 8)
    assert text(changes) == "" and m.holds.state["cur"] is None and not m.buffer.held
    # A machine goes on from its saved state.
    whole, first = machine({}), machine({})
    want = held(whole, "B", 2) + held(whole, "B", 4, 2)
    got = held(first, "B", 2)
    again = recognise.Recogniser(DebounceConfig(), MotionConfig(), state=json.loads(json.dumps(first.state())))
    again.buffer.__class__ = Scripted
    assert got + held(again, "B", 4, 2) == want and text(want) == "B"


def test_a_motions_commit_bears_the_last_frame_that_was_fed():
    m = machine({0: ("Z", 0), 12: ("J", 11)})
    changes = held(m, "A", 12) + held(m, "A", 1, 12)
    assert [(op, s, at) for _, op, s, at in changes] == [("commit", "Z", 0), ("commit", "A", 4), ("commit", "J", 11)]


def hands(rng, n, fingers):
    """A stream of hands of size 1 whose shape, place and tip wander."""
    frames, x, y, dx, dy, shape, t = [], 0.0, 0.0, 0.0, 0.0, "pinky", 0
    for i in range(n):
        if rng.random() < 0.06:
            shape = rng.choice(fingers)
        if rng.random() < 0.3:
            dx, dy = rng.uniform(-0.4, 0.4), rng.uniform(-0.2, 0.4)
        x, y = (x + dx) * 0.95, (y + dy) * 0.95
        t += rng.choice([33, 33, 33, 40, 900 if rng.random() < 0.1 else 33])
        points = [(x, y)] * 21
        points[9] = (x, y - 1.0)
        for name, (far, near) in geometry.TIPS.items():
            points[near], points[far] = (x, y - 1.0), (x, y - (1.6 if name in shape.split() else 0.7))
        frames.append((i, float(t), [(float(a), float(b)) for a, b in points], rng.random() > 0.03 and i % 97 > 8, rng.choice("AAAB") if i // 9 % 2 else rng.choice(["A", ""]), rng.random() < 0.01))
    return frames


SCHEMA = "stream_id string, frame_no long, t_ms double, landmarks array<struct<x:double,y:double>>, hand boolean, gated string, reset boolean"
LOOSE = MotionConfig(shape_ratio=0.5, j_drop=0.2, j_hook=0.05, z_drop=0.1, z_travel=0.2, z_stroke=0.1)


def one_by_one(spark, frames, config):
    """The changes of the machine, and the fires of its buffer, frame by frame."""
    changes, fires, last, m = [], [], None, None
    fields = recognise.frame_fields(config)
    for r in recognise.frame_rows(frames, config).orderBy("stream_id", "t_ms", "frame_no").collect():
        if r.stream_id != last:
            last, m = r.stream_id, recognise.Recogniser(DebounceConfig(), config)
            add = m.buffer.add
            m.buffer.add = lambda sample, add=add: fires.append((last, *fire, sample[1])) or fire if (fire := add(sample)) else None
        changes += [(last, *c) for c in m.feed(*(r[f] for f in fields))]
    return sorted(map(str, changes)), sorted(fires)


def test_settled_changes_are_the_commits_that_stand(spark):
    rng = random.Random(9)
    frames = spark.createDataFrame([("s", *f[:5], False) for f in hands(rng, 1500, ["pinky", "index"])], SCHEMA)
    m, out, held, log = recognise.Recogniser(DebounceConfig(), LOOSE), [], [], []
    fields = recognise.frame_fields(LOOSE)
    for r in recognise.frame_rows(frames, LOOSE).orderBy("t_ms", "frame_no").collect():
        changes = m.feed(*(r[f] for f in fields))
        log += [("s", *c) for c in changes]
        final, held = settle(changes, held, r.t_ms, LOOSE.window_ms)
        out += final
    out += [c for _, c in held]
    want = recognise.standing(spark.createDataFrame(log, recognise.CHANGE_SQL)).collect()
    assert {c[1] for c in out} == {"commit"} and sum(c[2] == "retract" for c in log) > 3
    assert sorted((c[2], c[3]) for c in out) == sorted((r.symbol, r.frame_no) for r in want)


@pytest.mark.parametrize("block_ms", [700, 60_000])
def test_chained_operators_equal_the_machine(spark, monkeypatch, block_ms):
    monkeypatch.setattr(decision, "BLOCK_MS", block_ms)
    rng = random.Random(block_ms)
    rows = [(f"s{k}", *f) for k in range(12) for f in hands(rng, 500, ["pinky", "index", "index middle"])]
    frames = spark.createDataFrame(rows, SCHEMA)
    want, fired = one_by_one(spark, frames, LOOSE)
    got = recognise.recognise(frames, motion=LOOSE).select("stream_id", "frame_no", "op", "symbol", "at_frame").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {f[1] for f in fired} == {"J", "Z"} and len(fired) > 40 and sum("retract" in x for x in want) > 5
    # Only what can fire is read one by one.
    strict = MotionConfig(j_drop=2.5, z_drop=2.5)
    chains = decision.motion_segments(frames.filter("hand"), strict)
    assert chains.count() < len(rows) / 5
    seen = sorted((r.stream_id, r.symbol, r.start_frame, r.frame_no) for r in decision.motion_fires(frames.filter("hand"), strict).collect())
    buffer, plain, last = None, [], None
    for r in recognise.frame_rows(frames.filter("hand"), strict).orderBy("stream_id", "t_ms", "frame_no").collect():
        if r.stream_id != last:
            last, buffer = r.stream_id, MotionBuffer(strict)
        if fire := buffer.add(tuple(r[c] for c in strict.sample)):
            plain.append((last, *fire, r.frame_no))
    assert seen == sorted(plain)


def test_a_third_sign_is_data(spark):
    """A sign with another hand shape, followed by another finger, in batch and in the buffer."""
    wave = MotionRule("N", ("index", "middle"), "middle", travel=0.3, strokes=2, stroke=0.1)
    config = MotionConfig(shape_ratio=0.5, rules=(*LOOSE.signs, wave))
    rng = random.Random(8)
    frames = spark.createDataFrame([(f"s{k}", *f) for k in range(10) for f in hands(rng, 400, ["index middle", "pinky", "index"])], SCHEMA)
    want, fired = one_by_one(spark, frames, config)
    assert {"N"} < {f[1] for f in fired}
    got = recognise.recognise(frames, motion=config).select("stream_id", "frame_no", "op", "symbol", "at_frame").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    plain = {(r.stream_id, r.frame_no) for r in geometry.plain_signs(frames, config).filter("is_n").collect()}
    first = {}
    for s, n in sorted(plain):
        first.setdefault(s, n)
    rows = decision.motion_fires(frames, MotionConfig(shape_ratio=0.5, rules=(wave,))).groupBy("stream_id").agg(F.min("frame_no").alias("n")).collect()
    assert plain and {r.stream_id: r.n for r in rows} == first


def test_equals_the_batch_operators_without_motions(spark):
    never = MotionConfig(min_samples=10**6, shape_ratio=0.125)
    frames = views.frames_emb(spark, SF).withColumn("hand", F.lit(True)).join(queries._gated(spark, SF), "frame_no")
    marks = geometry.motion_window(frames, never).select("frame_no", "candidate")
    decided = decision.frame_decision(frames.join(marks, "frame_no").withColumn("motion", F.lit(None).cast("string")))
    loose = DebounceConfig(min_hold_ms=30, blank_ms=200, switch_ms=30, min_hold_frames=1, min_blank_frames=1)
    want = db.debounce(decided.select("stream_id", "frame_no", "t_ms", F.col("fed").alias("symbol")), loose).select("stream_id", "frame_no", "symbol").collect()
    got = recognise.recognise(frames, loose, never).select("stream_id", "frame_no", "symbol").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 5


def test_strokes_alike(spark):
    c = MotionConfig()
    paths = [[0.0, 0.3, 0.1, 0.5, 0.45, 0.9, 0.2], [0.0] * 5, [0.0, 0.05, -0.05, 0.3], [1.0, 0.5, 0.9, 0.4, 1.2]]
    rows = spark.createDataFrame([(p,) for p in paths], "p array<double>").select("p", geometry.strokes("p", c).alias("s")).collect()
    for r in rows:
        assert stroke_signs(r.p, c).tolist() == r.s


def test_travel_on_an_axis_and_its_tail():
    b = MotionBuffer(MotionConfig(min_samples=99))
    assert b.travel() == 0.0
    for k in range(18):
        x = 0.03 * min(k, 12)
        b.add((k * 33.0, k, *[0.0] * 6, x, 0.4))
    assert len(SAMPLE) == 10 and b.travel() > 0.3 and b.travel("y") == 0.0 and b.travel(lookback_ms=150) == 0.0


def test_stream_equals_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        frames = queries._handed(spark, SF).select("stream_id", "frame_no", (F.col("t_ms") + 1000).alias("t_ms"), "landmarks", "hand", "gated").withColumn("reset", F.col("frame_no") % 211 == 0)
        want = recognise.recognise(frames, queries.CONFIG, queries.EASY).collect()
        ops = {r.op for r in want}
        assert {"commit", "reset"} <= ops
        rows = [r.asDict(recursive=True) for r in frames.collect()]
        rows.sort(key=lambda r: r["t_ms"])
        third = len(rows) // 3
        folder = tmp_path / "in"
        folder.mkdir()
        # Each file is out of order in itself; a last row far ahead moves the watermark past all others.
        end = rows[-1] | {"stream_id": "end", "t_ms": rows[-1]["t_ms"] + 10**6}
        rows[third - 1], rows[third] = rows[third], rows[third - 1]
        for k, part in enumerate([rows[:third], rows[third : 2 * third], rows[2 * third :], [end], [end | {"t_ms": end["t_ms"] + 1}]]):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in reversed(part)))
            os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
        schema = "stream_id string, frame_no long, t_ms long, landmarks array<struct<x:double,y:double>>, hand boolean, gated string, reset boolean"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        out = stream_recognise(stream, queries.CONFIG, queries.EASY, delay="100 seconds")
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_segmentation(spark):
    vocab = spark.createDataFrame([("hello", 50), ("world", 40), ("he", 60), ("a", 100), ("low", 5)], "term string, cnt long")
    runs = spark.createDataFrame([("helloworld",), ("ahello",), ("xyz",), ("",), (None,), ("helloworld",)], "run string")
    got = {r.run: r.text for r in segment_runs(runs, vocab).collect()}
    assert got == {"helloworld": "hello world", "ahello": "a hello", "xyz": "xyz", "": ""}


def test_a_fit_stops_early(spark):
    """Labels that features cannot tell: the held-out loss soon stops falling.  Labels that they tell are learnt for longer."""
    rng = random.Random(2)
    noise = [(rng.choice("AB"), [rng.random(), rng.random()]) for _ in range(400)]
    told = [(l, [float(l == "A") + rng.random() * 0.2, rng.random()]) for l in "AB" for _ in range(200)]
    frames = [spark.createDataFrame(x, "label string, features array<double>") for x in (noise, told)]
    (_, short), (model, long) = (train.train_history(f, 2, hidden=(8,), max_iter=150, patience=10) for f in frames)
    assert len(short) < len(long) <= 15 and short[-1] >= min(short[:-1])
    assert train.score(model, frames[1]).filter("pred = label").count() == 400
    fewer = train.train_history(frames[1].limit(3), 2, hidden=(2,), max_iter=5, validation=0.0)
    assert fewer[1] == []


def test_network_gradients_and_waiting():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    low, scale, *weights = train.fit_network(x, y, 2, (4,), 500, 7, 0.1, 5)
    assert [w.shape for w in weights] == [(3, 4), (4,), (4, 2), (2,)]
    again = train.fit_network(x, y, 2, (4,), 500, 7, 0.1, 5)
    assert all((a == b).all() for a, b in zip([low, scale, *weights], again))
    clear = train.fit_network(x, (x[:, 0] > 0).astype(int), 2, (4,), 500, 7, 0.1, 15)
    pred = train.forward(clear[2:], (x - clear[0]) / clear[1])[-1].argmax(axis=1)
    assert (pred == (x[:, 0] > 0)).mean() > 0.97


def test_fits_of_many_waves_are_one_grid(spark, monkeypatch):
    rows = [(p, l, [float(l == "A") + 0.01 * i, float(l == "B")]) for p in ("p", "q", "unknown") for l in "AB" for i in range(6)]
    frame = spark.createDataFrame(rows, "person string, label string, features array<double>")
    want = sorted(map(tuple, train.leave_one_out(frame, 2, hidden=(4,)).collect()))
    monkeypatch.setattr(train, "MAX_FITS", 1)
    assert sorted(map(tuple, train.leave_one_out(frame, 2, hidden=(4,)).collect())) == want == [("p", 12, 1.0), ("q", 12, 1.0)]
    plan = [(0, "p", 1, ["nobody"], 1.0, None), (1, "q", 1, None, 1.0, None)]
    assert [r.fit for r in train.grid(frame, 2, plan, hidden=(4,)).collect()] == [1]


def test_sweep_curve_ablation_and_saved_labels(spark, tmp_path):
    rows = [(p, l, [float(l == "A") + 0.01 * i, float(l == "B")]) for p in ("p", "q", "r") for l in "AB" for i in range(6)]
    frame = spark.createDataFrame(rows, "person string, label string, features array<double>")
    options = {"hidden": (4,), "max_iter": 40}
    sweep = train.seed_sweep(frame, 2, (1, 2), **options).collect()
    assert {r.fold for r in sweep} == {"p", "q", "r"} and all(r.n_seeds == 2 and r.least <= r.mean <= r.most and r.spread >= 0 for r in sweep)
    curve = {(r.n_people, r.n_folds) for r in train.learning_curve(frame, 2, **options).collect()}
    assert curve == {(1, 3), (2, 3)}
    drop = train.ablation(frame, 2, **options).collect()
    assert {(r.dropped, r.fold) for r in drop} == {(g, p) for g in "pqr" for p in "pqr" if g != p}
    path = str(tmp_path / "model")
    train.save(train.train(frame, 2, **options), path)
    assert train.load(spark, path).stages[0].labels == ["A", "B"]
    spark.createDataFrame([(0, "B"), (1, "A")], "label_idx int, label string").write.mode("overwrite").parquet(f"{path}/labels")
    with pytest.raises(ValueError):
        train.load(spark, path)
