import hashlib
import re

from pyspark.sql import functions as F

from glyphstream.llm import quality_rules as rules
from glyphstream.llm.chat_format import CONTROL, format_chats, read_back

TURNS = [
    (1, 2, "assistant", "b<|end|>\\<\\|x <s>|></s>[INST]\\"),
    (1, 0, "user", "é中😀"),
    (1, 1, "assistant", "<"),
    (1, 3, "user", "|>"),
    (2, 0, "end|>", None),
    (3, None, None, ""),
    (3, 1, "assistant", "\\\\[/INST]<<SYS>> <</SYS>>\n\n"),
    (3, 1, "assistant", "a"),
    (None, 1, "assistant", "lost"),
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: r for r in read_back(format_chats(rows)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in own]
        assert r.loss_text == "".join(t[2] for t in own if t[1] == "assistant")
    assert got[1].formatted.count("<|start|>") == 3
    inner = re.sub(r"<\|(start|text|turn|end)\|>", "\0", got[1].formatted)
    assert not any(c in inner for c in CONTROL)
    assert format_chats(rows.filter("false")).count() == 0


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    texts = [None, "", "a b", "a b c", "a a a a", "a b c a b c x y", "é\n\né\n \né #|<", "x y z\nx y z\r\nq x y z q x y", "w " * 200, "1 2 3 4 5 6 1 2 3 9 4 5 6", "😀 😀\x0b😀 & "]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = rules.with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(tuple(r) for r in got) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_learning(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, bad if i % 4 == 0 else good) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(150)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = rules.quality_rules(docs, labels)
    assert {(r.doc_id % 4 == 0, r.kept) for r in out.collect()} == {(True, False), (False, True)}
    assert rules.quality_rules(docs, labels.filter("false")).filter("kept").count() == 200
    assert rules.quality_rules(docs.filter("false"), labels).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_learnt_rules_hold_out(spark):
    """Rules learnt without a fifth of the labelled documents reject bad ones of it, and few good ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = rules.quality_rules(docs, labels.filter(~held)).filter(held & ~F.col("base_failed")).join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r for r in out if r.quality != 0], [r for r in out if r.quality == 0]
    assert len(good) > 50 and sum(r.kept for r in good) >= 0.97 * len(good)
    assert len(bad) > 3 and sum(r.kept for r in bad) <= 0.25 * len(bad)


def test_learner_by_hand():
    import numpy as np

    # One statistic separates: 30 bad cells reach 0.5, 70 good ones do not; a second is noise.
    rng = np.random.default_rng(3)
    values = np.zeros((100, len(rules.STATISTICS)))
    values[:30, 0] = 0.5
    values[:, 1] = rng.integers(0, 2, 100)
    fold, bad = np.arange(100) % 3 == 0, (np.arange(100) < 30).astype(float)
    options = [("symbol_share", True, 0.5), ("symbol_share", False, 0.5), ("duplicate_share", True, 1.0), ("duplicate_share", False, 1.0)]
    assert rules.learn(values, fold.astype(float), bad, 1 - bad, options, 0.95) == [([("symbol_share", True, 0.5)], False)]
    # Every single condition, by enumeration, is at most as precise as the first one grown.
    mixed = np.where(np.arange(100) == 29, 0.0, bad)
    grown = rules.learn(values, fold.astype(float), mixed, 1 - mixed, options, 0.9)
    grow = ~fold
    best = max(options, key=lambda o: rules._estimate(*[(x * grow * ((values[:, rules.STATISTICS.index(o[0])] >= o[2]) == o[1])).sum() for x in (mixed, 1 - mixed)]))
    assert grown[0].conditions[0] == best
    assert rules.learn(values, fold.astype(float), 0 * bad, bad, options, 0.95) == []


def test_order_of_a_learnt_list():
    """Rules of one condition can reject these bad documents only after another one has kept good ones."""
    import numpy as np

    cells = [(0.5, 0.5, 0, 20), (0.5, 0.0, 30, 0), (0.0, 0.0, 0, 50), (0.0, 0.5, 0, 20)]
    rows = [(s, d, float(k < b), float(k >= b)) for s, d, b, g in cells for k in range(b + g)]
    values = np.zeros((len(rows), len(rules.STATISTICS)))
    values[:, 0], values[:, 1] = [r[0] for r in rows], [r[1] for r in rows]
    fold, bad, good = np.arange(len(rows)) % 3 == 0, np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    options = [(s, above, 0.5) for s in ("symbol_share", "duplicate_share") for above in (True, False)]
    got = rules.learn(values, fold.astype(float), bad, good, options, 0.95, max_conditions=1)
    assert got == [([("symbol_share", False, 0.5)], True), ([("duplicate_share", False, 0.5)], False)]
    # Only bad ones are left behind the keeping rule: all that reach the end are rejected.
    got = rules.learn(values, fold.astype(float), bad, np.where(values[:, 0] == 0.5, 0.0, good), options[:2], 0.95, max_conditions=1)
    assert got[-1].keeps is False


def test_learnt_lists_by_walking_them(spark):
    """On random cells each rule is as precise on what reaches it as it must be, and Spark's conditional says what a walk does."""
    import numpy as np

    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = 400
        values = np.round(rng.random((n, len(rules.STATISTICS))), 1)
        truth = np.where(values[:, 1] >= 0.6, False, (values[:, 0] >= 0.5) | (values[:, 2] < 0.2))
        bad = (truth ^ (rng.random(n) < 0.02)).astype(float)
        options = [(s, above, t) for s in rules.STATISTICS for t in (0.2, 0.5, 0.6, 0.8) for above in (True, False)]
        got = rules.learn(values, (np.arange(n) % 3 == 0).astype(float), bad, 1 - bad, options, 0.9, max_conditions=1 + seed % 3)
        assert got and not got[-1].keeps
        live, kept = np.ones(n, bool), np.ones(n, bool)
        for conditions, keeps in got:
            within = live.copy()
            for name, above, t in conditions:
                within &= (values[:, rules.STATISTICS.index(name)] >= t) == above
            share, rest = bad[within].mean(), bad[live].mean()
            assert share <= 0.1 * rest + 1e-9 if keeps else share >= 0.9
            kept[within], live = keeps, live & ~within
        table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ["i", *rules.STATISTICS])
        said = {r.i: r.kept for r in table.select("i", rules.verdict(got).alias("kept")).collect()}
        assert [said[i] for i in range(n)] == kept.tolist()


def test_rules_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 60, 5, "a", 2), (None, None, 6, "b", 3)], "doc_id long, text string, N_WORDS int, words string, Kept int")
    out = rules.quality_rules(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert out.columns[:3] == ["doc_id", "text", "words"] and out.columns[-1] == "kept"
    assert sorted((r.words, r.n_words, r.kept) for r in out.collect()) == [("a", 60, False), ("b", 0, False)]


def test_long_conversation(spark):
    """A conversation of 100,000 turns, and one of 20,000 turns of one role, take linear time."""
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|x"), F.col("id")).alias("text"))
    same = spark.range(20_000).select(F.lit(2).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ok").alias("text"))
    got = {r.conv_id: r for r in read_back(format_chats(turns.unionByName(same))).collect()}
    assert len(got[1].turns) == 100_000 and got[1].turns[99_999] == ("assistant", "é<|x99999")
    assert got[1].loss_text == "".join(f"é<|x{i}" for i in range(1, 100_000, 2))
    assert got[2].formatted.count("<|start|>") == 1 and len(got[2].turns) == 20_000 and got[2].loss_text == "ok" * 20_000
