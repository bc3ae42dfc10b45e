"""Each stage of the corpus pipeline against a brute-force version on its own input."""

import re

import corpus_pipeline as pipeline
import public_tokenizers
from glyphstream.llm.queries import op6_quality_classifier
from glyphstream.llm.shared import materialize
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_minhash import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def passes_base(text):
    w = WORD.findall(text or "")
    seen, repeated = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(p + k for p in places for k in range(3))
    return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)


def without_repeats(rows):
    first, out = {}, {}
    key = lambda x: lower(x.strip(BLANK)).decode()
    for i, t in sorted(rows.items()):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    for i, t in rows.items():
        out[i] = "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == i)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        steps.append(materialize(stage(spark, steps[-1], SF), f"stage-{k}"))
        if k < len(pipeline.STAGES) - 1:
            assert steps[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]

    # Rules keep nothing that fails the base rules, change no text, and keep documents that are labelled good.
    assert all(passes_base(t) and t == texts[0][i] for i, t in texts[1].items())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    clean = {i for i in good & set(texts[0]) if passes_base(texts[0][i])}
    assert len(clean & set(texts[1])) >= 0.95 * len(clean)

    assert texts[2] == without_repeats(texts[1])

    kept = {i for i, _, _, keep in brute(sorted(texts[2].items()), 5) if keep}
    assert texts[3] == {i: texts[2][i] for i in kept}

    # No item's window is left in what decontamination keeps, and documents without one stay as they are.
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r.text or ""))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    hits = {}
    for i, t in texts[3].items():
        w = ALNUM.findall(lower(t))
        hits[i] = {p + k for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for k in range(n)}
        if not hits[i]:
            assert texts[4][i] == t
        elif len(hits[i]) > 0.5 * len(w):
            assert i not in texts[4]
        else:
            assert ALNUM.findall(lower(texts[4][i])) == [x for k, x in enumerate(w) if k not in hits[i]]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = steps[-1].collect()
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[4].items()}
    held, bins = {}, {}
    for p in pieces:
        held[p.doc_id] = held.get(p.doc_id, 0) + p.length
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert held == length
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096


def test_pipeline_of_no_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        none = stage(spark, none, SF)
        assert none.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert none.count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = op6_quality_classifier(spark, sf).filter("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_held_out_is_by_checksum(spark):
    out = op6_quality_classifier(spark, SF).select("held_out", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("want"))
    assert out.filter("held_out <> want").isEmpty()


def test_stages_at_the_edges(spark):
    """Nulls in any column, repeated rows, empty tables and further columns."""
    long = " ".join(f"word{k} of" for k in range(80))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long.replace("word7 ", "other7 "), None, None, None), (None, "null id " + long, "en", None, 7), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, n_words int, kept boolean")
    for table in (docs, docs.filter("false")):
        now, seen = table, []
        for _, stage in pipeline.STAGES:
            now = materialize(stage(spark, now, SF), "edge")
            seen.append(now.count())
        assert seen[0] == (4 if table is docs else 0) and seen[-1] == seen[-2]
    kept = pipeline.keep_good(spark, docs, SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    one = {r.doc_id for r in pipeline.keep_one_of_each(spark, kept, SF).collect()}
    assert one == {1, None}


def test_stages_leave_only_their_results(spark):
    import os

    from glyphstream.llm.shared import scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    n = pipeline.run(spark, SF).count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert n > 0 and left == {name.replace(" ", "-") for name, _ in pipeline.STAGES}
    before = set(os.listdir(folder))
    try:
        with scratch(spark):
            materialize(spark.range(3), "lost")
            raise KeyError
    except KeyError:
        assert set(os.listdir(folder)) == before
    assert materialize(spark.range(3), "kept").count() == 3
