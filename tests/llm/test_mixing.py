"""Mixing: shares by hand, the sample against a plain version, and what each source gets."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from glyphstream.llm import mixing
from glyphstream.llm.mixing import mix_sources, targets

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets_by_hand():
    assert targets([100, 100], [1, 1], 150, 2) == [75, 75]
    # The first stops at 200, the others share what it leaves.
    assert targets([100, 300, 600], [5, 2, 1], 1500, 2) == [200, 600, 700]
    assert targets([0, 10], [5, 2], 15, 2) == [0, 15]
    assert targets([0, 0], [5, 2], 0, 2) == [0, 0]
    assert sum(targets([7, 70, 700, 7000], [1, 9, 3, 2], 10_000, 2)) == pytest.approx(10_000)


def brute(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    words = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    told = targets(words, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(words), 2)
    out = []
    for s, w, t in zip(names, words, told):
        certain = min(2, int(t // w)) if w else 0
        p = t / w - certain if w else 0
        mine = [(n, r) for n, r in zip(size, rows) if r[2] == s]
        odds = lambda x: x / (1 - x)
        rank = lambda r: odds((int(hashlib.md5(f"0:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        mine.sort(key=lambda x: (rank(x[1]), x[1][0] if x[1][0] is not None else -math.inf, x[0]))
        got = 0
        for large in (True, False):
            part = [x for x in mine if (x[0] * 1000 > w) == large]
            wanted = sum(n for n, _ in part) * p if large else t - certain * w - got
            at = 0
            for n, r in part:
                at += n
                taken = p > 0 and at - n / 2 <= wanted
                got += n * taken
                out.append((r[0], n, w, round(t, 6), n * (certain + taken)))
    return out


def rows_of(n, sources, weight):
    return [(i, " ".join(["w"] * (1 + i * 7919 % weight(i))), sources[i % len(sources)]) for i in range(n)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_BUCKETS", 7)
    rows = rows_of(6000, ["b", "a", None, "", "é", "b", "b"], lambda i: 40 if i % 50 else 900)
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, Target string")
    got = [tuple(r) for r in mix_sources(docs).drop("copies").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    by = defaultdict(int)
    for _, n, w, t, taken in got:
        by[w, t] += taken
        assert taken <= 2 * n
    assert all(abs(taken - t) <= 0.01 * t for (_, t), taken in by.items())


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x y", None), (3, " \n", "zero"), (4, "one two three " * 20_000, "b"), (4, "one", "b")]
    schema = "doc_id long, text string, source string"
    got = sorted((tuple(r) for r in mix_sources(spark.createDataFrame(rows, schema)).drop("copies").collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    again = sorted((tuple(r) for r in mix_sources(spark.createDataFrame(rows[::-1], schema).repartition(5)).drop("copies").collect()), key=key)
    assert again == got


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame(rows_of(9, ["a", "b", "c"], lambda i: 5), "doc_id long, text string, source string"))
