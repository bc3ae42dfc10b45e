"""Sessions and the names given for them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphstream.operators import sequence as seq
from glyphstream.plans.queries import QUERIES


def test_more_than_a_thousand_sessions_are_named(spark, tmp_path):
    events = spark.range(2400).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.session, r.label, r.person, r.n) for r in QUERIES["attribute_person"](spark, str(tmp_path)).collect()}
    assert got == {(s, label, f"n{s}", 1) for s in range(1200) for label in ("view", "click")}
    report = {r.person for r in QUERIES["attribution_report"](spark, str(tmp_path)).collect()}
    assert report == {f"n{s}" for s in range(1200)}


@pytest.mark.parametrize("names", [[(0, "a")], [(0, "a"), (1, "b"), (2, "c")], [(0, "a"), (1, "b"), (1, "c")]])
def test_sessions_and_names_must_match(spark, names):
    log = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("s", 3, "A")], "stream_id string, seq long, label string")
    with pytest.raises(Exception, match="do not match"):
        seq.attribute_person(log, spark.createDataFrame(names, "session int, person string"), 1).collect()


@pytest.mark.parametrize("rows,names", [([], [(0, "a")]), ([("s", 1, "A")], [(0, "a"), (None, "b")]), ([("s", 1, "A")], [(0, None)])])
def test_odd_names_are_refused(spark, rows, names):
    """Names where there are no sessions, a name of no session, a session whose name is null."""
    log = spark.createDataFrame(rows, "stream_id string, seq long, label string")
    with pytest.raises(Exception, match="do not match"):
        seq.attribute_person(log, spark.createDataFrame(names, "session int, person string"), 1).collect()


def _times_cut(spark, monkeypatch, name):
    cut, calls = seq.sessions, []
    monkeypatch.setattr(seq, "sessions", lambda *args: calls.append(args) or cut(*args))
    return QUERIES[name](spark, "/root/testdata/sf0.001"), calls


def test_report_reads_kept_labels(spark, monkeypatch):
    out, calls = _times_cut(spark, monkeypatch, "attribution_report")
    assert out.count() > 0 and len(calls) == 1
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_sessions_are_cut_once_for_persons(spark, monkeypatch):
    """The names of the query come from the sessions that they are given to; what comes after reads the kept table."""
    out, calls = _times_cut(spark, monkeypatch, "attribute_person")
    assert out.count() > 0 and len(calls) == 1
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_in_a_full_join(spark):
    """A full join on session would bring a session's rows of all streams to one task."""
    log = spark.range(300).selectExpr("id % 100 as stream_id", "id as seq", "char(65 + id div 100 % 2) as label")
    plan = seq.attribute_person(log, spark.createDataFrame([(0, "a"), (1, "b")], "session int, person string"), 1)._jdf.queryExecution().optimizedPlan().toString()
    left = [x.splitlines()[1] for x in plan.split("Join FullOuter")[1:]]
    assert left and all("Aggregate [session#" in x for x in left)


def _greedy(labels):
    """Session of each burst, read one by one."""
    out, seen, n = [], set(), 0
    for x in labels:
        if x is not None and x in seen:
            seen, n = set(), n + 1
        seen.add(x)
        out.append(n)
    return out


@pytest.mark.parametrize("piece", [1, 2, 7, 4096])
def test_sessions_in_pieces(spark, piece):
    """Streams of few and of many labels, one without any repeat, and null labels and streams, cut at every piece length as one by one."""
    rng = random.Random(5)
    streams = {"few": [rng.choice("AB") for _ in range(90)], "many": [rng.choice("ABCDEFGHIJ") for _ in range(300)], "once": [str(k) for k in range(50)], "null": [rng.choice(["A", "B", None]) for _ in range(80)], None: list("ABCABCCAB"), "one": ["A"]}
    rows = [(s, i, x) for s, labels in streams.items() for i, x in enumerate(labels)]
    log = spark.createDataFrame(rows, "stream_id string, seq long, label string")
    got = {}
    for r in seq.sessions(log, piece).collect():
        got.setdefault(r.stream_id, []).append((r.start, r.end, r.label, r.session))
    for s, labels in streams.items():
        edges = [i for i, x in enumerate(labels) if i == 0 or x != labels[i - 1]]
        kept = [labels[i] for i in edges]
        assert sorted(got[s], key=lambda x: x[0]) == list(zip(edges, [*edges[1:], len(labels)], kept, _greedy(kept)))


def test_long_stream_of_sessions(spark):
    """300,000 bursts of one stream: a fold that copies what it has told takes the square of that."""
    log = spark.range(300_000).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") * 7919 % 10007 % 23).cast("string").alias("label"))
    labels = [str(i * 7919 % 10007 % 23) for i in range(300_000)]
    kept = [x for i, x in enumerate(labels) if i == 0 or x != labels[i - 1]]
    got = [r.session for r in seq.sessions(log).orderBy("start").select("session").collect()]
    assert got == _greedy(kept)


def test_many_short_streams_of_sessions(spark):
    """6,000 streams of ten bursts, some of more than a piece of 8: a call of Python for each of them takes over a minute."""
    log = lambda n: spark.range(n * 10).selectExpr("id % 10 as seq", "id div 10 as stream_id", "char(65 + id * 7919 % 10007 % 5) as label")
    assert seq.sessions(log(3), 8).count() > 0  # workers have started
    begin = time.time()
    got = {}
    for r in seq.sessions(log(6_000), 8).select("stream_id", "start", "session").collect():
        got.setdefault(r.stream_id, []).append((r.start, r.session))
    assert time.time() - begin < 40
    assert len(got) == 6_000
    for s, rows in got.items():
        labels = [chr(65 + (s * 10 + i) * 7919 % 10007 % 5) for i in range(10)]
        edges = [i for i, x in enumerate(labels) if i == 0 or x != labels[i - 1]]
        assert sorted(rows) == list(zip(edges, _greedy([labels[i] for i in edges])))


def test_ends_of_a_piece_go_back(spark):
    """A later burst of a piece may lead to an earlier burst of the next one; ids of streams beyond 2^53 beside null ones."""
    labels, streams = list("ABCADEBFGCDHAEBIFJGKCLDHAMENBIFJG" * 9), [None, 2**53 + 1, 2**53 + 2]
    log = spark.createDataFrame([(s, i, x) for s in streams for i, x in enumerate(labels)], "stream_id long, seq long, label string")
    for piece in (3, 8, 50):
        got = {s: [] for s in streams}
        for r in seq.sessions(log, piece).collect():
            got[r.stream_id].append((r.start, r.session))
        assert all(sorted(x) == list(enumerate(_greedy(labels))) for x in got.values())


def test_sessions_of_no_rows(spark):
    assert seq.sessions(spark.createDataFrame([], "stream_id long, seq long, label string")).collect() == []
