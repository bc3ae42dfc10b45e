"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from glyphstream.llm import spelling
from glyphstream.llm.spelling import near_words, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else 0))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus(seed, letters="abcé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(150)]
    for _ in range(250):
        w = list(rng.choice(words))
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice(letters)])
        words.append("".join(w))
    chances = [1 / (1 + i % 40) for i in range(len(words))]
    return [(i, " ".join(x.title() if rng.random() < 0.1 else x for x in rng.choices(words, chances, k=60)) + ", 12") for i in range(120)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Word string, n_near int")
        want = brute(rows)
        assert result(spelling_variants(docs)) == want
        assert sum(r[1] != "" for r in want) > 20 and any(r[2] != r[1] != "" for r in want)


def test_small_lists_and_batches_give_the_same(spark, monkeypatch):
    rows = corpus(3, "ab")
    want = brute(rows)
    monkeypatch.setattr(spelling, "LIST_WORDS", 5)
    monkeypatch.setattr(spelling, "BATCH_ROWS", 7)
    assert result(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_all_edits_of_a_word(spark):
    word = "abéde"
    letters = "abzé"
    edits = {word[:i] + c + word[i:] for i in range(6) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(5) for c in ["", *letters]} - {word}
    words = spark.createDataFrame([(w, k + 1) for k, w in enumerate(sorted(edits | {word, "other", "zzabede"}))], "word string, n long")
    got = [(r.word, r.near) for r in near_words(words).collect()]
    every = [r.word for r in words.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in every for b in every if one_edit(a, b)}
    assert {b for a, b in got if a == word} == edits


def test_edges(spark):
    schema = "doc_id long, text string"
    long_run = "qwertyuiop" * 3000
    rows = [(1, None), (2, ""), (None, "hello hello hello hellos hellos hellos"), (3, "×÷ÿÀê " * 3), (4, f"{long_run} {long_run[:-1]} " * 3), (4, "hello")] + [(5, "hello")] * 3
    got = result(spelling_variants(spark.createDataFrame(rows, schema)))
    assert got == brute(rows) and ("hellos", "hello", "hello", 3, 1, 7) in got and len([r for r in got if len(r[0]) > 1000 and r[4] == 1]) == 2
    assert spelling_variants(spark.createDataFrame([], schema)).count() == 0
