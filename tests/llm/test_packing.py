import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from glyphstream.llm import packing
from glyphstream.llm.packing import best_fit_pack, fullest, plan, sequences, word_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world's  end!\n ", "", None, "naïve café x y \x1d z é '́ ", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ΑΣ. 123 4,5 　", "it's we'll I'D", "한국어 中文 😀😀 a​b", "Ünïcode WORDS, (and)--more_ 12ab3² ½x __a#_b ÀÉ.ß ªº", "<|EndOfText|> <|x|> !!! a1b2", "e\u0301 \u0301 O'Neil's 'S"]


def test_word_cache_equals_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    for t in TEXTS:
        assert np.frombuffer(word_tokens(PATH, [t or ""])[0], "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_word_cache_on_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    tokenizer = Tokenizer.from_file(PATH)
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert word_tokens(PATH, [t or "" for t in texts]) == expected


def test_plan():
    assert fullest(10, {7: 1, 6: 1, 4: 2, 3: 1}) in ({7: 1, 3: 1}, {6: 1, 4: 1})
    assert fullest(5, {4: 1, 2: 3}) == {4: 1} or fullest(5, {4: 1, 2: 3}) == {2: 2}
    bins = plan({6: 5, 4: 5, 10: 2, 1: 3}, 10)
    assert sum(n for _, n in bins) == 8
    used = {}
    for b, n in bins:
        assert sum(k * v for k, v in b.items()) <= 10
        for k, v in b.items():
            used[k] = used.get(k, 0) + n * v
    assert used == {6: 5, 4: 5, 10: 2, 1: 3}
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4096, 5000)
    bins = plan({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}, 4096)
    assert sum(n for _, n in bins) <= 1.005 * int(lengths.sum()) / 4096


def test_pack(spark):
    rows = [(i, (TEXTS[i % 8] or "") * (i % 5) + " a b" * (i * 37 % 90), 1) for i in range(120)] + [(500, "x y z " * 300, 1), (501, None, 1), (None, "a", 1), (1, "dup", 1), (1, "dup", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    packed = best_fit_pack(docs, PATH, size=128, with_ids=True)
    got = [r.asDict() for r in packed.collect()]
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    by = {}
    for r in got:
        whole = ids[r["doc_id"]]
        part = whole[r["start"] : r["start"] + r["length"]]
        if r["doc_id"] != 1:
            assert np.frombuffer(r["ids"], "<u4").tolist() == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == min(128, len(whole) - 128 * r["piece"])
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert total == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert len(by) <= -(-total // 128) + 1
    assert sequences(packed).count() == len(by)


def test_empty(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_one_common_length(spark, n):
    packed = best_fit_pack(spark.range(n).selectExpr("id as doc_id", "'a' as text"), PATH, size=10).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == n and len({r.sequence_id for r in packed}) == n / 5


def test_forgotten_words_are_encoded_again(monkeypatch):
    """Generations of a few words turn over at each batch; ids stay those of the tokenizer."""
    monkeypatch.setattr(packing, "MAX_CACHE", 3)
    monkeypatch.setattr(packing, "_TOKENIZERS", {})
    whole = Tokenizer.from_file(PATH)
    batches = [["The cat, the CAT. 12-3"], ["other words here now", "cat!"], ["don't <b> the cat"], ["The cat, été 12-3 words"], ["", "the <|endoftext|> other"]]
    for texts in batches * 2:
        expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert packing.word_tokens(PATH, texts) == expected


def test_fullest_by_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        room = int(rng.integers(1, 25))
        counts = {int(k): int(rng.integers(1, 4)) for k in sorted(rng.choice(np.arange(1, 20), 5, replace=False), reverse=True)}
        best = max(s for n in itertools.product(*[range(v + 1) for v in counts.values()]) if (s := sum(k * m for k, m in zip(counts, n))) <= room)
        used = fullest(room, counts)
        assert sum(k * m for k, m in used.items()) == best and all(m <= counts[k] for k, m in used.items())


def test_plan_keeps_every_piece_and_slack_low():
    rng = np.random.default_rng(6)
    for _ in range(20):
        size = int(rng.integers(10, 200))
        histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, size + 1, 300), return_counts=True))}
        bins, used = plan(histogram, size), {}
        for b, n in bins:
            assert sum(k * m for k, m in b.items()) <= size and n > 0
            for k, m in b.items():
                used[k] = used.get(k, 0) + n * m
        assert used == histogram
        # No more bins than first fit decreasing takes, but for one.
        room = []
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                room.append(size - length)
            else:
                room[at] -= length
        assert sum(n for _, n in bins) <= len(room) + 1


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_tokens(public_tokenizers.path("byte_bpe_50k.json"), ["some text"])
