import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from glyphstream.llm import repeats, suffix_dedup
from glyphstream.llm.substring_dedup import substring_dedup
from glyphstream.llm.suffix_dedup import previous_factors, suffix_array_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, width=20):
    first = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode())
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60, vocabulary=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 % n if n % 3 else i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(1000, rows[0][1]), (1001, "aaaa" * 60), (1002, "aa" * 90), (1003, "a b " * 60), (1004, None), (1005, ""), (1006, " \n "), (1007, "b a " * 40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, part int")


def test_bytes_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = suffix_array_dedup(frame(spark, rows).repartition(5)).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute_bytes(rows)


def test_words_against_brute_force(spark):
    for seed, vocabulary in ((3, 40), (4, 2)):
        rows = corpus(seed, vocabulary=vocabulary)
        got = substring_dedup(frame(spark, rows).repartition(5)).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute_words(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_array_dedup(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(text))]
    got = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == [(0, 0, text), (1, 0, text), (1, 0, text), (2, 40, "")]
    assert suffix_array_dedup(frame(spark, [])).count() == 0
    assert substring_dedup(frame(spark, [])).count() == 0


def test_longest_previous_factors():
    """Every suffix of small texts, against all pairs."""
    rng = np.random.default_rng(5)
    for n, letters in ((1, 2), (2, 1), (60, 1), (300, 2), (300, 4)):
        text = rng.integers(0, letters, n).astype(np.uint8)  # zeros as well
        at = np.arange(n)
        size = np.minimum(n - at, rng.integers(1, 40, n))
        rank = rng.integers(0, n // 3 + 1, n)
        raw = text.tobytes()
        strings = [raw[a : a + k] for a, k in zip(at.tolist(), size.tolist())]

        def common(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        want = [max((common(s, t) for t, r in zip(strings, rank) if r < rank[i]), default=0) for i, s in enumerate(strings)]
        assert previous_factors(text, at, size, rank).tolist() == want
        assert previous_factors(text, at, size, rank, 7).tolist() == [x if x >= 7 else 0 for x in want]


def test_wide_windows(spark):
    rows = [(i, t and t * 3) for i, t in corpus(7, n=40)]
    for width in (300, 400):
        got = suffix_array_dedup(frame(spark, rows).repartition(3), width=width).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute_bytes(rows, width)
    got = substring_dedup(frame(spark, rows).repartition(3), width=90).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 90)


def test_one_passage_in_different_surroundings(spark, monkeypatch):
    """A hot anchor's contexts are dealt window by window."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(14))
    longer = " ".join(word() for _ in range(25))
    rows = [(i, " ".join([word(), word(), passage if i % 3 else longer, word(), word(), word(), word(), word(), word(), word()])) for i in range(300)]
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 4)
    assert sorted(map(tuple, suffix_array_dedup(frame(spark, rows).repartition(7)).drop("kept").collect())) == brute_bytes(rows)
    assert sorted(map(tuple, substring_dedup(frame(spark, rows).repartition(7)).drop("kept").collect())) == brute_words(rows)


def test_blocks(spark, monkeypatch):
    from glyphstream.llm import substring_dedup as words_, suffix_dedup as bytes_

    monkeypatch.setattr(repeats, "AT_ONCE", 50)
    monkeypatch.setattr(bytes_, "ORDER_BYTES", 500)
    monkeypatch.setattr(bytes_, "PIECE_BYTES", 300)
    monkeypatch.setattr(words_, "PIECE_BYTES", 300)
    rows = corpus(9)
    assert sorted(map(tuple, suffix_array_dedup(frame(spark, rows).repartition(3)).drop("kept").collect())) == brute_bytes(rows)
    assert sorted(map(tuple, substring_dedup(frame(spark, rows).repartition(3)).drop("kept").collect())) == brute_words(rows)


def test_very_long_text(spark):
    rng = random.Random(13)
    text = " ".join(str(rng.randint(0, 10**6)) for _ in range(400_000))
    rows = [(1, text), (2, text[1_000_000:1_200_000] + " x"), (3, "short")]
    got = {r.doc_id: r for r in suffix_array_dedup(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept) == (0, 200_000, b" x")
    n = len(rows[1][1].split())
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and n - 3 <= got[2].n_removed <= n - 1


def test_runs_of_one_byte_and_short_periods_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        text = "".join(rng.choice(["a", "ab", "xyz", "0123456789", " ", "\x00"]) * rng.choice([1, 30, 130, 400]) + rng.choice(["", "q", f"end {rng.random()} of it"]) for _ in range(3))
        rows.append((i * 7 % 40, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted(tuple(r) for r in suffix_array_dedup(docs, with_kept=False).collect())
    want = brute_bytes(rows)
    assert got() == want
    # The same in pieces of a text, in small contexts and orders, and dealt window by window.
    for name, value in {"PIECE_BYTES": 70, "CONTEXT_WINDOWS": 9, "ORDER_BYTES": 300}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 2)
    monkeypatch.setattr(repeats, "AT_ONCE", 100)
    assert got() == want


def test_memory_of_runs_of_one_byte():
    """Two texts of 3 MB of one letter: what a task holds for them, beside them, and how long it takes."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "key": [1, 2], "text": ["a" * 3_000_000, "a" * 2_900_000]})
    tracemalloc.start()
    began = time.time()
    method = repeats.Method(suffix_dedup._contexts(50), suffix_dedup._windows(50), suffix_dedup._earlier, own=False)
    found = [c for c in repeats.gathered(c for c, _ in method.contexts(batch))]
    rows = [row for c in found for row in repeats._sent(c, method, 4)]
    hot = np.unique(np.concatenate([c.anchor for c in found]))
    dealt = [row for c in found for row in repeats._fetched(c, method, hot, 4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and dealt and peak < 500e6 and time.time() - began < 10 and sum(len(c.lo) for c in found) < 5000
