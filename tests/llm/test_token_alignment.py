"""Aligned tokenizers against whole texts, encoded and compared byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glyphstream.llm import token_alignment
from glyphstream.llm.token_alignment import Aligner, align_tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "one two  three\n\nfour\t five ", "  leading", "trailing   ", " ", "\n", "\n x", "x\n y", "a  b", "日本語 の text", "naïve café \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> <s> </s> <0x41> <unk>",
    "▁low ▁", "① ﬁ Å é", "it's we'll  I'd", "x" * 300, "\u0000 \u0007", "a b   c", "\r\n\r\n end", "def f(x):\n    return  x ** 2\n", "é" * 50, "a\x1cb \x1cc \x85d",
]


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), Aligner(A, B)


def tokens(pair, text):
    """ids and bytes of both tokenizers over a whole text."""
    a, b, tables = pair
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    return x, y, [tables.a_bytes[i] for i in x], [tables.b_bytes[i] for i in y]


def plain(pair, rows):
    linked, docs = Counter(), []
    for doc_id, text in rows:
        groups, links = [], []
        x, y, xs, ys = tokens(pair, text) if text else ([], [], [], [])
        if text and b"".join(xs) == b"".join(ys) == (" " + text).encode():
            i = j = at_a = at_b = 0
            now_a, now_b = [], []
            while i < len(x) or j < len(y):
                # The token that begins first is the next one.
                if j >= len(y) or (i < len(x) and at_a <= at_b):
                    now_a.append((x[i], at_a, at_a := at_a + len(xs[i])))
                    i += 1
                else:
                    now_b.append((y[j], at_b, at_b := at_b + len(ys[j])))
                    j += 1
                if at_a == at_b:
                    groups.append(f"{','.join(str(t[0]) for t in now_a)}|{','.join(str(t[0]) for t in now_b)}")
                    links += [(p, q) for p, s, e in now_a for q, u, v in now_b if s < v and u < e]
                    now_a, now_b = [], []
        else:
            x, y = [], []
        linked.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, q), n in linked.items():
        best[q] = max(best[q], n)
    return sorted(
        (d or 0, na, nb, len(g), len(k), sum(linked[z] == best[z[1]] for z in k), sum(linked[z] for z in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for d, na, nb, g, k in docs
    )


def result(df):
    return sorted((r.doc_id or 0, *r[1:]) for r in df.select(*COLUMNS).collect())


def test_against_whole_texts(spark, pair, monkeypatch):
    rng = random.Random(4)
    alphabet = ["the", "words", " ", "  ", "\n", ".", "été", "日本", "\U0001f600", "①", "x1", "'s", "\t", ",", "<|endoftext|>", "‍", " "]
    rows = list(enumerate([None, "", *ODD, *ODD[:5]])) + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(None, "no id"), (7, "again"), (7, "again")]
    monkeypatch.setattr(token_alignment, "PART_BYTES", 500)
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, N_A int").repartition(3)
    want = plain(pair, rows)
    assert result(align_tokenizers(docs, A, B)) == want
    assert any(r[1] for r in want) and sum(r[1] == 0 for r in want) >= 3


def test_given_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(align_tokenizers(docs, A, B)) == plain(pair, rows)


def test_groups_very_long_texts_and_empty_tables(spark, pair):
    rows = [(1, "naïve"), (2, "wörd " * 100_000), (3, "日" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in align_tokenizers(docs, A, B, with_groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256
    for i, text in rows:
        x, y, *_ = tokens(pair, text)
        assert (got[i].n_a, got[i].n_b) == (len(x), len(y))
    assert align_tokenizers(docs.filter("false"), A, B).count() == 0
