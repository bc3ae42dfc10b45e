import glyphstream.llm.line_dedup as m

ROWS = [
    (5, "A common line here\nown text of five\n a COMMON line here \t"),
    (2, "a common line here\r\nshort\n\nshort"),
    (9, "short\nnothing else is in here\n\nown text of five"),
    (9, "short\nnothing else is in here\n\nown text of five"),
    (None, "a common line here"),
    (3, None),
    (4, ""),
    (7, "ÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄ"),
    (8, "ÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄ\nx"),
]
EXPECTED = [
    (-1, "a common line here", 1, 0),
    (2, "a common line here\r\nshort\n\nshort", 4, 0),
    (3, "", 1, 0),
    (4, "", 1, 0),
    (5, "own text of five", 3, 2),
    (7, "ÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄ", 2, 0),
    (8, "ÄÄÄÄÄÄÄÄÄ\nx", 3, 1),
    (9, "short\nnothing else is in here\n", 4, 1),
    (9, "short\nnothing else is in here\n", 4, 1),
]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "k", 1) for i, t in rows], "doc_id long, text string, n_lines int, key string, line int")
    out = m.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "key", "line", "n_lines", "n_dropped", "kept_sha256"]
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())


def test_lines(spark):
    assert run(spark, ROWS) == EXPECTED
    assert run(spark, []) == []


def test_combined_often(spark, monkeypatch):
    """Hashes sent many times over, with a memory of few of those already sent."""
    monkeypatch.setattr(m, "COMBINED", 3)
    monkeypatch.setattr(m, "TOLD", 2)
    assert run(spark, ROWS) == EXPECTED


def brute(rows):
    first, count = {}, {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in set(map(key, t.split("\n"))):
            first[x] = min(first.get(x, i), i)
            count.setdefault(x, set()).add(i)
    gone = lambda i, x: len(key(x)) >= 10 and len(count[key(x)]) > 1 and first[key(x)] != i
    return sorted((i, "\n".join(x for x in t.split("\n") if not gone(i, x)), t.count("\n") + 1, sum(gone(i, x) for x in t.split("\n"))) for i, t in rows)


def test_many_suspects(spark):
    """Nearly all lines are in several documents."""
    rows = [(i, "\n".join(f"shared line number {(i * 37 + k * k) % 997}" for k in range(40)) + f"\nown line of {i} alone") for i in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_very_long_text(spark):
    text = "\n".join(f"a line of the long text, number {k}" for k in range(60_000))
    rows = [(2, text), (1, "a line of the long text, number 59999"), (3, "x" * 3_000_000)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one line of text", 1, [1], 2, 3), (2, "one line of text", 2, [2], 3, 4)], "doc_id long, text string, N_LINES int, nos array<int>, bodies int, _0 int")
    out = m.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "nos", "bodies", "_0", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((r.doc_id, r.text, r.nos, r.bodies, r["_0"], r.n_dropped) for r in out.collect()) == [(1, "one line of text", [1], 2, 3, 0), (2, "", [2], 3, 4, 1)]


def test_very_common_line(spark):
    rows = [(i, f"the very common line\nline number {i} of its own") for i in range(2000)]
    got = run(spark, rows)
    assert got[0][3] == 0 and all(r[3] == 1 and r[1] == f"line number {r[0]} of its own" for r in got[1:])
