"""The line field against enumeration, its gradient against differences, and classification at the edges."""

import itertools
import zlib

import numpy as np
from glyphstream.llm.quality_crf import N_FEATURES, Chain, classify_quality


def chain(rng):
    c = Chain()
    c.weights, c.moves = rng.normal(0, 0.5, N_FEATURES), rng.normal(0, 0.7, (2, 2))
    return c


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    c = chain(rng)
    places = np.array([0, 1, 1, 6, 9])
    score, weight = rng.normal(0, 1, 9), rng.random(9)
    good, pairs = c.marginals(score, places, weight)
    want, moved = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(places[:-1], places[1:]):
        total = 0.0
        inside, steps = np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a) if b > a else ():
            p = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(c.moves[u, v] for u, v in zip(y, y[1:])))
            total += p
            inside += p * np.array(y)
            for i, (u, v) in enumerate(zip(y, y[1:])):
                steps[u, v] += p * weight[a + i]
        if b > a:
            want[a:b] = inside / total
            moved += steps / total
    assert np.allclose(good, want) and np.allclose(pairs, moved)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    c = chain(rng)
    places = np.array([0, 3, 3, 4, 9])
    features, label = rng.normal(0, 1, (9, N_FEATURES)), np.array([1, 0, 0, 1])
    size = np.diff(places)
    weight = np.repeat(1 / np.maximum(size, 1), size)
    got = c.gradient(features, places, label, weight)
    flat = np.concatenate([c.weights, c.moves.ravel()])
    for k in [0, 5, N_FEATURES - 1, *range(N_FEATURES, N_FEATURES + 4)]:
        ends = []
        for e in (1e-5, -1e-5):
            moved = flat.copy()
            moved[k] += e
            c.weights, c.moves = moved[:-4], moved[-4:].reshape(2, 2)
            ends.append(c.likelihood(features, places, label, weight))
        assert np.isclose(got[k], (ends[0] - ends[1]) / 2e-5, atol=1e-5)


GOOD, BAD = "A calm line of plain words, with an end.\nAnd then another one follows it.", "BUY!!! $$$ now ### 100%\nBUY!!! $$$ now ### 100%"
DOCS = "doc_id long, text string, label int, features string"


def test_edges(spark):
    rows = [(i, GOOD if i % 2 else BAD, 7, "f") for i in range(60)] + [(100, None, 1, "f"), (101, "", 1, "f"), (None, GOOD, 1, "f"), (3, GOOD, 1, "f"), (102, " \n \n", 1, None), (103, "x" * 2_000_000 + "\n" + GOOD * 2000, 1, "f")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = classify_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[3]) == 1 and by[100] == by[101] == by[102]
    assert min(by[1]) > 0.7 > 0.3 > max(by[2])
    # Without labels nothing tells; an empty table gives no rows; a bound that lets no line through is like no labels.
    assert {r.score for r in classify_quality(docs, labels.filter("false")).collect()} == {0.5}
    assert classify_quality(docs.filter("false"), labels).count() == 0
    assert {r.score for r in classify_quality(docs, labels, max_lines=1).collect()} == {0.5}


def test_repeated_rows_do_not_weigh(spark):
    """A document that a third of all rows repeat is fitted once."""
    rows = [(i, GOOD if i % 2 else BAD, 7, "f") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in classify_quality(spark.createDataFrame(rows, DOCS), labels).collect()}
    many = {r.doc_id: r.score for r in classify_quality(spark.createDataFrame(rows + [rows[1]] * 20, DOCS), labels).collect()}
    assert all(abs(once[k] - many[k]) < 1e-6 for k in once)
