import hashlib
import random
import re
import time

import numpy as np

import glyphstream.llm.decontamination as m

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = tokens(t)
        if i is not None and w:
            for s in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = tokens(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocab = [rng.choice(["A", "b", "Zé", "9"]) * rng.randint(1, 2) for _ in range(9)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 8, 12, 25]))) for i in range(12)] + [(50, None), (None, text(12)), (3, text(15))]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(5)) for i in range(80)]
    return docs + [(90, None), (91, ""), (92, "...")], items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items):
    d, b = frames(spark, docs, items)
    got = m.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, *case(seed))
    check(spark, case(3)[0], [])


def test_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 150)
    check(spark, *case(4))
    # And in several passes.
    monkeypatch.setattr(m, "HELD_BYTES", 5000)
    check(spark, *case(5))


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d, b = frames(spark, [(1, f"Before it: {item}! After it" + " more" * 30), (2, item), (3, "one two three")], [(7, item)])
    got = {r.doc_id: r for r in m.decontaminate(d, b).collect()}
    assert got[1].cleaned == "Before it: ! After it" + " more" * 30 and not got[1].dropped
    assert got[2].cleaned == "" and got[2].dropped
    assert got[3].cleaned == "one two three" and not got[3].contaminated
    assert m.decontaminate(*frames(spark, [], [(7, item)])).count() == 0


def test_clashing_columns_and_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    long = "w1 w2 w3 w4 " * 300_000 + item
    docs = spark.createDataFrame([(1, long, [1], "s", 3, 4), (2, None, [2], "t", 5, 6)], "doc_id long, text string, items_ array<int>, spans string, N_WORDS int, _1 int")
    out = m.decontaminate(docs, spark.createDataFrame([("a", item), ("b", "w9 w10"), ("c", item)], "item_id string, text string"))
    assert out.columns[:5] == ["doc_id", "text", "items_", "spans", "_1"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], got[1].spans, got[1]["_1"]) == (1_200_012, 12, ["a", "b", "c"], "s", 4)
    assert (got[2].n_words, got[2].cleaned, got[2].contaminated) == (0, None, False)


def test_long_runs_are_cut(spark, monkeypatch):
    """Pieces overlap by a window, so the results do not depend on where runs are cut."""
    monkeypatch.setattr(m, "RUN_TOKENS", 4)
    for seed in (7, 8):
        check(spark, *case(seed))
    rng = random.Random(9)
    item = [rng.choice("abc") for _ in range(300)]
    docs = [(1, " ".join(item)), (2, "a " * 500), (3, " ".join(item[40:90] + item[120:129] + item[200:260]))]
    check(spark, docs, [(1, " ".join(item)), (2, "a " * 12), (3, "b c a"), (4, "a a")])


def test_a_million_equal_words():
    items = [(str(k), ("a " * (20 + k)).encode()) for k in range(3)]
    block = m.Block(m.build_block(items, 10))
    codes = m.word_codes(*next((c, *m.words(c, m.ALNUM)[:2]) for c in m.chunks(m.pa.array([b"a"], m.pa.large_binary()), 1 << 40)), lower=True)
    started = time.perf_counter()
    [(doc, spans, names)] = block.hits(np.repeat(codes, 1_000_000), np.array([0]))
    assert time.perf_counter() - started < 10
    assert (doc, names, spans["lo"].min(), spans["hi"].max(), len(spans)) == (0, {"0", "1", "2"}, 0, 1_000_000, 999_991)
