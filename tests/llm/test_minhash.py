import random
import re

from glyphstream.llm.components import components
from glyphstream.llm.minhash import minhash_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    rows, base = [], []
    for g in range(12):
        base.append([rng.choice(vocab) for _ in range(rng.randint(3, 150))])
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 7 % 260, " ".join(w).replace("w1", "W1") if i % 3 else "  ".join(w)))
    return rows + [(300, None), (301, ""), (302, "one"), (303, "One"), (304, "one two"), (305, " \n")]


def test_against_brute_force(spark):
    for seed, n in ((1, 4), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, component_id int")
        got = sorted(map(tuple, minhash_dedup(docs, n).collect()))
        assert got == brute(rows, n)


def test_edges(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(docs).collect() if r.doc_id)
    assert got == [(3, 46, 3, True), (5, 46, 3, False), (5, 46, 3, False)]
    assert minhash_dedup(docs).filter("doc_id is null and component_id is null and kept").count() == 2
    assert minhash_dedup(docs.filter("false")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {95: 90, 100: 90}


def test_recall_of_links(spark):
    """Every exact link of the documents whose id is divisible by 20 joins two documents of one component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = set()
    for i in (i for i in sets if i % 20 == 0):
        common = {}
        for x in sets[i]:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        links |= {(i, j) for j, n in common.items() if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    got = {r.doc_id: r.component_id for r in minhash_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4).collect()}
    assert links and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)


def test_very_long_text(spark):
    words = [f"w{k * 7919 % 100003}" for k in range(300_000)]
    rows = [(3, " ".join(words)), (2, " ".join(words[:290_000])), (1, "w1 w2 w3 w4 w5")]
    got = sorted((r.doc_id, r.component_id) for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == [(1, 1), (2, 2), (3, 2)]
