"""The sink of the change log, captures as a stream, hands, and the guard of features."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphstream.operators import debounce as db
from glyphstream.operators import hands, sequence, train
from glyphstream.operators import text as tx
from glyphstream.operators.recognise import CHANGE_SQL, standing
from glyphstream.streaming import sink
from glyphstream.streaming.commits import stream_captures, stream_debounce


def change_log(seed, n=400):
    """Changes as the machine gives them, of two streams: commits, retracts of the last ones, resets."""
    rng, recent, out = random.Random(seed), {"a": [], "b": []}, []
    for i in range(n):
        s = rng.choice("ab")
        what = rng.random()
        if what < 0.03:
            recent[s] = []
            out.append((s, i, "reset", None, None))
        elif what < 0.2 and recent[s]:
            for at, symbol in recent[s][-rng.randint(1, 2) :]:
                out.append((s, i, "retract", symbol, at))
                recent[s].remove((at, symbol))
            out.append((s, i, "commit", "J", i - 1))
            recent[s].append((i - 1, "J"))
        else:
            out.append((s, i, "commit", rng.choice("ABC"), i))
            recent[s].append((i, out[-1][3]))
    return out, sorted((s, x, at) for s, own in recent.items() for at, x in own)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_that_are_replayed_change_nothing(spark, tmp_path):
    changes, want = change_log(1)
    parts = [changes[k : k + 45] for k in range(0, len(changes), 45)]
    write = sink.change_log_sink(str(tmp_path), merge_every=3)
    frame = lambda part: spark.createDataFrame(part, CHANGE_SQL)
    assert rows(sink.standing_commits(spark, str(tmp_path))) == []
    for k, part in enumerate(parts):
        write(frame(part), k)
        so_far = rows(standing(frame([c for p in parts[: k + 1] for c in p])))
        assert rows(sink.standing_commits(spark, str(tmp_path))) == so_far
        # Replayed at once, and the one before it after a merge.
        write(frame(part), k)
        write(frame(parts[max(0, k - 1)]), max(0, k - 1))
        assert rows(sink.standing_commits(spark, str(tmp_path))) == so_far
    assert rows(sink.standing_commits(spark, str(tmp_path)).select("stream_id", "symbol", "frame_no")) == want
    assert {p.name for p in (tmp_path / "standing").iterdir()} == {f"upto={k}" for k in range(2, len(parts), 3)}
    assert sink.read_changes(spark, str(tmp_path)).count() == len(changes)


def test_broken_writes_are_written_again(spark, tmp_path):
    changes, want = change_log(2, 120)
    parts = [changes[k : k + 40] for k in range(0, len(changes), 40)]
    write = sink.change_log_sink(str(tmp_path), merge_every=2)
    frame = lambda part: spark.createDataFrame(part, CHANGE_SQL)
    for k, part in enumerate(parts):
        write(frame(part), k)
    for broken in ("changes/batch=1", "standing/upto=1", f"changes/batch={len(parts) - 1}"):
        (tmp_path / broken / "_SUCCESS").unlink()
    assert sink.read_changes(spark, str(tmp_path)).select("batch_id").distinct().count() == len(parts) - 2
    for k in (1, len(parts) - 1):
        write(frame(parts[k]), k)
    assert rows(sink.standing_commits(spark, str(tmp_path))) == want


def test_a_query_that_lost_its_last_commit(spark, tmp_path):
    """The engine replays a batch whose commit its checkpoint does not hold."""
    changes, want = change_log(3, 200)
    (tmp_path / "in").mkdir()
    names = ["stream_id", "frame_no", "op", "symbol", "at_frame"]
    for k in range(4):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("\n".join(json.dumps(dict(zip(names, c))) for c in changes[k * len(changes) // 4 : (k + 1) * len(changes) // 4]))
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    seen = []

    def run():
        write = sink.change_log_sink(str(tmp_path / "out"), merge_every=2)

        def noted(batch, k):
            seen.append(k)
            write(batch, k)

        stream = spark.readStream.schema(CHANGE_SQL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(noted).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None

    run()
    (tmp_path / "check" / "commits" / "3").unlink()
    crc = tmp_path / "check" / "commits" / ".3.crc"
    if crc.exists():
        crc.unlink()
    run()
    assert seen == [0, 1, 2, 3, 3]
    assert rows(sink.standing_commits(spark, str(tmp_path / "out"))) == want


READINGS = "stream_id string, frame_no long, t_ms double, symbol string"


def drain(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    return df.sparkSession.table(name)


def folder(path, parts):
    path.mkdir()
    for k, part in enumerate(parts):
        (path / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(path / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    return str(path)


def test_captures_as_a_stream(spark, tmp_path):
    rng = random.Random(11)
    frames = [{"stream_id": s, "frame_no": i, "t_ms": i * 33.0, "symbol": rng.choice(["A", "B", ""])} for s in "ab" for i in range(200) if not 90 <= i < 130]
    markers = [{"stream_id": s, "marker": k, "t0": float(rng.randint(0, 6500))} for s in "abc" for k in range(25)] + [{"stream_id": "a", "marker": 99, "t0": 3100.0}]
    want = rows(sequence.captures(spark.createDataFrame(markers, "stream_id string, marker long, t0 double"), spark.createDataFrame(frames, READINGS), 400))
    assert {n for _, _, n, _ in want} >= {0, 12, 13} and ("a", 99, 0, "") in want
    # Neighbours in time change places between files; later rows move both watermarks on.
    frames.sort(key=lambda r: r["t_ms"] + rng.random() * 900)
    markers.sort(key=lambda r: r["t0"] + rng.random() * 900)
    end = [[{"stream_id": "z", "frame_no": k, "t_ms": 1e6 * (k + 1), "symbol": "A"}] for k in range(3)]
    stop = [[{"stream_id": "z", "marker": k, "t0": 1e6 * (k + 1)}] for k in range(3)]
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    f = read(folder(tmp_path / "frames", [frames[k : k + 110] for k in range(0, 320, 110)] + end), READINGS)
    m = read(folder(tmp_path / "markers", [markers[k : k + 26] for k in range(0, 76, 26)] + stop), "stream_id string, marker long, t0 double")
    got = rows(drain(stream_captures(m, f, 400, "6 seconds"), "captures").filter("stream_id <> 'z'").select("stream_id", "marker", "n", "text"))
    assert got == want


def test_captures_without_rows(spark):
    none = spark.createDataFrame([], "stream_id string, marker long, t0 double")
    some = spark.createDataFrame([("a", None, 1.0), (None, 1, 1.0), ("a", 1, None), ("a", 2, 5.0)], none.schema)
    frames = spark.createDataFrame([("a", 1, 6.0, "A"), ("a", 2, 5.0, None), ("a", 3, None, "B"), (None, 4, 5.0, "C")], READINGS)
    assert rows(sequence.captures(none, frames, 10)) == []
    assert rows(sequence.captures(some, frames, 10)) == [("a", 2, 2, "A")]
    assert rows(sequence.captures(some, frames.filter("false"), 10)) == [("a", 2, 0, "")]


def test_hands_are_streams_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    data = [{"stream_id": "a", "hand_id": h, "frame_no": i, "t_ms": i * 33.0, "symbol": x} for h in (0, 1, None) for i, x in enumerate(x for _ in range(20) for x in [rng.choice(["A", "B", ""])] * rng.randint(1, 12))]
    schema = "stream_id string, hand_id int, frame_no long, t_ms double, symbol string"
    frames = spark.createDataFrame(data, schema)
    got = hands.by_hand(db.debounce, frames)
    assert got.columns == ["stream_id", "hand_id", "symbol", "frame_no", "t_ms"] and dict(got.dtypes)["hand_id"] == "int"
    told = lambda df: sorted(tuple(r) for r in df.select("symbol", "frame_no").collect())
    for h in (0, 1, None):
        alone = frames.filter(F.col("hand_id").eqNullSafe(F.lit(h)))
        assert told(got.filter(F.col("hand_id").eqNullSafe(F.lit(h)))) == told(db.debounce(alone)) != []
    end = [[{"stream_id": "a", "hand_id": h, "frame_no": 10_000, "t_ms": 1e6, "symbol": ""} for h in (0, 1, None)]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder(tmp_path / "in", [data, *end]))
    out = drain(hands.by_hand(stream_debounce, stream, idle_ms=None), "hands")
    key = lambda df: sorted((tuple(r) for r in df.select("hand_id", "symbol", "frame_no").collect()), key=str)
    assert key(out) == key(got)


def test_metadata_never_becomes_a_feature(spark):
    data = spark.createDataFrame([("A", "p", 7, 0.1, 1.0), ("B", "p", 8, None, 2.0)], "label string, person string, frame_no long, x double, y double")
    made = train.feature_array(data, ["x", "y"]).orderBy("label").collect()
    assert [r.features for r in made] == [[0.10000000149011612, 1.0], [None, 2.0]]
    for wrong in (["x", "person"], ["frame_no", "x"], ["x", "x"]):
        with pytest.raises(ValueError, match="not features"):
            train.feature_array(data, wrong)
    with pytest.raises(Exception, match="does not have 3 features"):
        train.train(train.feature_array(data.filter("x is not null"), ["x", "y"]), 3, hidden=(2,), max_iter=1)


def test_modes_of_a_vocabulary(spark):
    docs = spark.createDataFrame([("a latency a",)], "text string")
    boosts = spark.createDataFrame([("name", 100, None), ("latency", 10, "academic"), ("pun", 5, "jokes")], "term string, cnt long, mode string")
    told = lambda mode: {r.term: r.cnt for r in tx.vocabulary(docs, boosts, mode).collect()}
    assert told("academic") == {"a": 2, "latency": 11, "name": 100}
    assert told(None) == {"a": 2, "latency": 1, "name": 100}
    with pytest.raises(ValueError, match="no modes"):
        tx.vocabulary(docs, boosts.drop("mode"), "academic")
