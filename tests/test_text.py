"""Spelling candidates against brute force."""

import math
import random
import re
import time
from collections import Counter

from glyphstream.operators import text
from glyphstream.plans.queries import QUERIES

TEXTS = ["The agenda of the meeting, the minutes and a zebra", "Minutes minutes meting meeting agendas reader readers", "extraordinary extraordinarily ordinary a an of"]
ASKED = ["meetng zebras minuts", "THE extraordnary agneda; qqqqqqq zebro", "a reeders", None, "12 34"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_every_word_of_a_text_is_asked_and_every_term_can_be_suggested(spark, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(9, "zebrs", "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    terms = lambda texts: re.findall("[a-z]+", " ".join(t for t in texts if t).lower())
    vocab = Counter(terms(TEXTS)) + Counter({"the": 10**9, "agenda": 10**9})
    want = set()
    for term in set(terms(ASKED)):
        near = [(d, -n, v) for v, n in vocab.items() if (d := distance(term, v)) <= 2]
        if near:
            want.add((term, min(near)[2], min(near)[0]))
    got = QUERIES["spell_candidates"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ("zebras", "zebra", 1) in want and ("minuts", "minutes", 1) in want


def cheapest(run, vocab, longest):
    """All splits of every start of a run, by price, number of words and order."""
    total = sum(vocab.values())
    price = lambda w: round((math.log10(total) - math.log10(vocab[w])) * 1000) if w in vocab else round(math.log10(total) * 1000) + 1000 * (len(w) - 1)
    best = [(0, 0, "")]
    for e in range(1, len(run) + 1):
        best.append(min((best[e - n][0] + price(run[e - n : e]), best[e - n][1] + 1, best[e - n][2] + " " * (e > n) + run[e - n : e]) for n in range(1, min(e, longest) + 1)))
    return best[-1][2]


def test_splits_equal_the_fold_of_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 7)
    rng = random.Random(5)
    vocab = {"a": 10, "aa": 10, "ab": 10, "ba": 10, "aba": 4, "b": 100, "bbb": 1, "abab": 10}
    runs = ["".join(rng.choice("ab" if i % 3 else "a") for _ in range(rng.randint(1, 60))) for i in range(120)] + ["zab", "zzzz"]
    terms = spark.createDataFrame(list(vocab.items()), "term string, cnt long")
    for longest in (3, 20):
        got = {r.run: r.text for r in text.segment_runs(spark.createDataFrame([(r,) for r in runs], "run string"), terms, longest).collect()}
        assert got == {r: cheapest(r, vocab, longest) for r in runs}


def test_a_long_run_takes_little_time(spark):
    """100,000 letters; also with a tie at every second place, between splits that differ at their very beginning."""
    terms = spark.createDataFrame([("a", 10), ("aa", 10), ("hello", 5), ("world", 5)], "term string, cnt long")
    runs = spark.createDataFrame([("helloworld" * 10_000,), ("a" * 100_001,)], "run string")
    text.segment_runs(runs.limit(0), terms).collect()
    began = time.time()
    got = {r.run[0]: r.text for r in text.segment_runs(runs, terms).collect()}
    assert time.time() - began < 20
    assert got["h"] == " ".join(["hello world"] * 10_000) and got["a"] == " ".join(["a", *["aa"] * 50_000])


def test_sequences_keep_word_signs_and_split_letters(spark):
    tokens = [("s", i, x) for i, x in enumerate([*"HELLOWORLD", "ILY", "WAVE", *"he", "", "LLO", None, *"XQ"])] + [("t", 0, "ILY"), ("u", 0, "")]
    terms = spark.createDataFrame([("hello", 5), ("world", 5), ("he", 3)], "term string, cnt long")
    phrases = spark.createDataFrame([("ILY", "I love you")], "label string, phrase string")
    got = {r.stream_id: r.text for r in text.correct_sequence(spark.createDataFrame(tokens, "stream_id string, pos int, label string"), phrases, terms).collect()}
    assert got == {"s": "hello world I love you WAVE he LLO xq", "t": "I love you"}
