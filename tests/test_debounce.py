import random

import pytest

from glyphstream.operators import debounce as db
from glyphstream.operators.debounce import DebounceConfig, debounce
from glyphstream.operators.decision import motion_fires
from glyphstream.operators.geometry import MotionConfig, motion_rules
from glyphstream.operators.holds import Holds
from glyphstream.operators.sequence import bursts, run_commit, sessions


def stream(name, parts, fps=30):
    symbols = [s for s, n in parts for _ in range(n)]
    return [(name, i, i * 1000 / fps, "" if s == "_" else s) for i, s in enumerate(symbols)]


def parts(text):
    return [(x[0], int(x[1:])) for x in text.split()]


CASES = [
    ("D5 _1 D5", 30, "D"),
    ("Q12 _2 " * 10, 30, "Q"),
    ("X4 _1 X3 _2 X6 _1 X8", 30, "X"),
    ("D6 R1 D6", 30, "D"),
    ("G10 Q3 G10", 30, "G"),
    ("R10 X2 R10", 30, "R"),
    ("G10 Q10 G10", 30, "GQG"),
    ("C6 B2 C1 A1 C1 _2 C3", 15, "C"),
    ("A30", 30, "A"),
    ("A2", 30, ""),
    ("_10", 30, ""),
    ("L10 _10 L10", 30, "LL"),
    ("L10 _4 L10", 30, "L"),
    ("C8 A8 T8", 30, "CAT"),
    ("H6 I6", 30, "HI"),
    ("A6", 30, "A"),
    ("A1", 5, ""),
    ("A3", 6, "A"),
    ("A3", 5, "A"),
    ("A2", 5, ""),
    ("A3 _1 A3", 3, "A"),
]


def fold(frames, c):
    """The table of holds, one reading after another, without cuts."""
    machine, out = Holds(c), []
    for _, frame_no, t, symbol in frames:
        if (committed := machine.feed(symbol, t)) is not None:
            out.append((committed, frame_no))
    return out


@pytest.mark.parametrize("text,fps,expected", CASES)
def test_goldens_of_the_table(text, fps, expected):
    assert "".join(s for s, _ in fold(stream("s", parts(text), fps), DebounceConfig())) == expected


def commits(spark, rows, config=DebounceConfig()):
    got = {}
    for r in debounce(spark.createDataFrame(rows, "stream_id string, frame_no long, t_ms double, symbol string"), config).collect():
        got.setdefault(r.stream_id, []).append((r.frame_no, r.symbol))
    return {k: [(s, n) for n, s in sorted(v)] for k, v in got.items()}


def test_goldens(spark):
    rows = [r for k, (text, fps, _) in enumerate(CASES) for r in stream(str(k), parts(text), fps)]
    got = commits(spark, rows)
    assert {k: "".join(s for s, _ in got.get(str(k), [])) for k in range(len(CASES))} == {k: c[2] for k, c in enumerate(CASES)}


def test_cut_folds_equal_the_uncut_fold(spark):
    rng = random.Random(7)
    streams = {}
    for k in range(300):
        fps = rng.choice([30, 25, 20, 15, 10, 6, 5])
        streams[str(k)] = stream(str(k), [(rng.choice("AB__C"), rng.choice([1, 1, 2, 3, 5, 9])) for _ in range(rng.randint(1, 40))], fps)
    c = DebounceConfig()
    got = commits(spark, [r for s in streams.values() for r in s])
    assert {k: v for k, s in streams.items() if (v := fold(s, c))} == got


@pytest.mark.parametrize("chunk_ms", [150, 900])
def test_chunks_of_a_stream_equal_the_fold(spark, monkeypatch, chunk_ms):
    monkeypatch.setattr(db, "CHUNK_MS", chunk_ms)
    rng = random.Random(chunk_ms)
    streams = {}
    for k in range(200):
        fps = rng.choice([30, 15, 5])
        long = rng.choice([[1, 1, 2], [1, 2, 5, 9], [3, 20, 60]])
        streams[str(k)] = stream(str(k), [(rng.choice(rng.choice(["AB", "AB_", "ABC__"])), rng.choice(long)) for _ in range(rng.randint(1, 60))], fps)
    rows = [r for s in streams.values() for r in s]
    for c in (DebounceConfig(), DebounceConfig(min_hold_ms=30, switch_ms=200, min_hold_frames=1), DebounceConfig(min_hold_ms=400, blank_ms=90, switch_ms=0, min_blank_frames=1)):
        assert commits(spark, rows, c) == {k: v for k, s in streams.items() if (v := fold(s, c))}


def test_an_unbroken_stream_is_read_by_many_tasks(spark):
    """No release for two days of readings: no task has over a few of its chunks."""
    n = 2 * 86_400 * 30
    frames = spark.range(n).selectExpr("'s' as stream_id", "id as frame_no", "cast(id * 1000 / 30 as double) as t_ms", "case when id % 211 = 7 then '' else char(65 + (id div 40) % 3) end as symbol")
    got = debounce(frames).selectExpr("count(*) as n", "count(distinct symbol) as m", "max(frame_no) as last").first()
    assert (got.n, got.m) == (n // 40, 3) and n - got.last < 40
    sizes = [r["count"] for r in db._pieces(frames, DebounceConfig()).groupBy("piece").count().collect()]
    assert max(sizes) < 200 and sum(sizes) >= n


def test_retractions_meet_by_frames(spark):
    commits_ = spark.createDataFrame([("s", "A", k * 100) for k in range(30)] + [("u", "A", 250)], "stream_id string, symbol string, frame_no long")
    fires = spark.createDataFrame([("s", "J", 250, 900), ("s", "Z", 2000, 2000)], "stream_id string, symbol string, start_frame long, frame_no long")
    got = sorted((r.stream_id, r.frame_no, r.symbol) for r in db.retract(commits_, fires).collect())
    assert got == sorted([("s", k * 100, "A") for k in range(30) if not (250 <= k * 100 <= 900 or k == 20)] + [("u", 250, "A"), ("s", 900, "J"), ("s", 2000, "Z")])


@pytest.mark.parametrize("labels,expected", [("AABBBA", [("A", 0, 2), ("B", 2, 5), ("A", 5, 6)]), ("A", [("A", 0, 1)])])
def test_bursts(spark, labels, expected):
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "stream_id string, seq long, label string")
    assert sorted(((r.label, r.start, r.end) for r in bursts(log).collect()), key=lambda x: x[1]) == expected


def test_sessions_and_runs(spark):
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate("AAABBBBAABBB")], "stream_id string, seq long, label string")
    assert sorted((r.start, r.end, r.session) for r in sessions(log).collect()) == [(0, 3, 0), (3, 7, 0), (7, 9, 1), (9, 12, 1)]
    frames = spark.createDataFrame(stream("s", parts("D5 _1 D5 A2")), "stream_id string, frame_no long, t_ms double, symbol string")
    assert [r.frame_no for r in run_commit(frames).orderBy("frame_no").collect()] == [2, 8]


def hand(x, y, shape, tip=(0.0, 0.0)):
    """21 points of a hand of size 1: the named finger is out, the others are in."""
    x, y = float(x), float(y)
    points = [(x, y)] * 21
    points[9] = (x, y - 1.0)
    for k, (far, near) in {"index": (8, 6), "middle": (12, 10), "ring": (16, 14), "pinky": (20, 18)}.items():
        out = k == shape
        points[near] = (x, y - (1.0 if out else 1.2))
        points[far] = (x + tip[0] * out, y - (1.6 if out else 0.7) + tip[1] * out)
    return points


def test_motion_fixtures(spark):
    rows = []
    for i in range(18):
        rows.append(("still", i, i * 33, hand(0, 0, "index")))
        t = i / 17
        zigzag = 1.1 * (3 * t if t < 1 / 3 else 2 - 3 * t if t < 2 / 3 else 3 * t - 2)
        rows.append(("z", i, i * 33, hand(zigzag, 0.8 * t, "index")))
        rows.append(("j", i, i * 33, hand(0.6 * max(0, t - 0.6) / 0.4, 0.9 * t, "pinky")))
        rows.append(("slow", i, i * 100, hand(zigzag, 0.8 * t, "index")))
    frames = spark.createDataFrame(rows, "stream_id string, frame_no long, t_ms long, landmarks array<struct<x:double,y:double>>").selectExpr("*", "'x' as label")
    got = motion_rules(frames, MotionConfig()).collect()
    assert {r.stream_id for r in got if r.is_z} == {"z"}
    assert {r.stream_id for r in got if r.is_j} == {"j"}
    assert {r.stream_id for r in got if r.candidate} >= {"z", "j"} and "still" not in {r.stream_id for r in got if r.candidate}
    fires = motion_fires(frames, MotionConfig()).collect()
    assert {(r.stream_id, r.symbol) for r in fires} == {("z", "Z"), ("j", "J")} and all(0 <= r.start_frame < r.frame_no for r in fires)
