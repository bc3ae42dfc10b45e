"""Grouping of spelling variants: words one edit apart, and the form that each leads to.

Two words one edit apart share their first or their last half, so words meet by
half words: forwards by a prefix, and spelt backwards by a suffix.  A group's
words are a sorted list.  A word is compared with the list in one scan: a row of
the edit matrix, a band of three cells, belongs to a prefix that neighbours in
the list share and is worked out once for all of them; a range whose shared prefix is
already more than one edit away is skipped.  All words of a task are scanned
side by side, letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ranges
from .shared import materialize, n_shuffle

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a list; those of a larger group are dealt to several lists, and each of its words is compared with all of them.
LIST_WORDS = 4000
#: Rows that a task compares at once, but for a list and its words.
BATCH_ROWS = 20_000
#: More than one edit.
FAR = 2


def corpus_words(docs: DataFrame, every: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, and how often they occur; of each every-th run of a document, by a checksum, a letter is left out.

    Words of fewer code points or occurrences are left out.  ``every`` 0 leaves all runs as they are.
    """
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"))
    found = named.select("name", F.explode("runs").alias("run")).filter(F.length("run") >= least_chars)
    if every:
        h = F.crc32(F.concat_ws(":", "name", "run").cast("binary"))
        at = F.pmod(h, F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        found = found.select(F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("run")).filter(F.length("run") >= least_chars)
    return found.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _postings(words: DataFrame) -> DataFrame:
    """Each word under its half words: spelt (forwards or backwards), n, back, half (length) and key (the half word).

    Of two words one edit apart the shorter one's half counts, so a word stands
    for itself and as the longer one.
    """
    half = F.array_distinct(F.array((F.length("word") / 2).cast("int"), ((F.length("word") - 1) / 2).cast("int")))
    posted = words.select("word", "n", F.explode(half).alias("half")).filter("half > 0")
    ways = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("spelt")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("spelt")))
    both = posted.select("n", "half", F.explode(ways).alias("w")).select("n", "half", "w.back", "w.spelt")
    return both.withColumn("key", F.substring(F.col("spelt"), F.lit(1), F.col("half")))


class _List:
    """Words' code points end to end, in sorted order within groups, and what neighbours share."""

    def __init__(self, spelt: list[str], group: np.ndarray) -> None:
        self.code = np.frombuffer("".join(spelt).encode("utf-32-le"), "<u4").astype(np.int64)
        self.size = np.array(list(map(len, spelt)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.group = group

    def at(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The code points of words at places; -1 beyond their ends."""
        inside = (place >= 0) & (place < self.size[which])
        return np.where(inside, self.code[np.where(inside, self.start[which] + place, 0)] if len(self.code) else -1, -1)

    def shared(self) -> np.ndarray:
        """The common prefix of each word with the one before it; -1 at a group's first."""
        out = np.full(len(self.size), -1, np.int64)
        going = np.flatnonzero(self.group[1:] == self.group[:-1]) + 1
        out[going] = 0
        while len(going):
            a, b = self.at(going - 1, out[going]), self.at(going, out[going])
            going = going[(a == b) & (a >= 0)]
            out[going] += 1
        return out


def near_pairs(listed: _List, asked: _List, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asked, listed) of words of one group that are exactly one edit apart behind the group's shared prefix.

    Groups of asked are groups of listed; half: by asked word, how many letters
    its group shares.
    """
    shared = listed.shared()
    n = len(shared)
    edges = np.searchsorted(listed.group, asked.group), np.searchsorted(listed.group, asked.group, side="right")
    # A row of alive pairs: an asked word, the range of listed words with one prefix, and the cells of that prefix for one letter less, as many, one more.
    q, (lo, hi) = np.arange(len(asked.size)), edges
    places_of: dict[int, np.ndarray] = {}
    cells = np.tile(np.array([1, 0, 1]), (len(q), 1))
    some = lo < hi
    q, lo, hi, cells = q[some], lo[some], hi[some], cells[some]
    depth = half[q]
    # Groups of different depths move on together; places where the prefix of each length ends are looked up by length.
    by_length = np.argsort(shared, kind="stable")
    lengths = shared[by_length]
    out = []
    while len(q):
        # A word that ends here stands first in its range.
        ends = listed.size[lo] == depth
        short = asked.size[q] - depth
        told = ends & (np.abs(short) <= 1)
        if told.any():
            final = cells[told, short[told] + 1]
            hit = final == 1
            out.append((q[told][hit], lo[told][hit]))
        lo = lo + ends
        keep = lo < hi
        q, lo, hi, cells, depth = q[keep], lo[keep], hi[keep], cells[keep], depth[keep]
        if not len(q):
            break
        # Ranges of one more letter begin where neighbours share no more than the prefix.
        cuts = np.zeros(n + 1, np.int64)
        begin, finish = [], []
        for d in np.unique(depth).tolist():
            mine = np.flatnonzero(depth == d)
            if d not in places_of:
                places_of[d] = np.sort(by_length[: np.searchsorted(lengths, d, side="right")])
            places = places_of[d]
            first, last = np.searchsorted(places, lo[mine], side="right"), np.searchsorted(places, hi[mine])
            count = last - first + 1
            inner = places[ranges(first, last - first)] if len(places) else cuts[:0]
            heads = np.cumsum(count) - count
            starts = np.empty(int(count.sum()), np.int64)
            head = np.zeros(len(starts), bool)
            head[heads] = True
            starts[head], starts[~head] = lo[mine], inner
            stops = np.append(starts[1:], 0)
            stops[heads + count - 1] = hi[mine]
            begin.append((np.repeat(mine, count), starts))
            finish.append(stops)
        which = np.concatenate([w for w, _ in begin])
        lo, hi = np.concatenate([s for _, s in begin]), np.concatenate(finish)
        q, depth, old = q[which], depth[which], cells[which]
        letter = listed.at(lo, depth)
        new = np.full_like(old, FAR)
        size = asked.size[q]
        for k in (0, 1, 2):
            j = depth + k  # letters of the asked word in this cell
            best = old[:, k] + (asked.at(q, j - 1) != letter)
            if k < 2:
                best = np.minimum(best, old[:, k + 1] + 1)
            if k:
                best = np.minimum(best, new[:, k - 1] + 1)
            new[:, k] = np.where((j > size) | (j < 0), FAR, np.minimum(best, FAR))
        alive = new.min(axis=1) < FAR
        q, lo, hi, depth, cells = q[alive], lo[alive], hi[alive], depth[alive] + 1, new[alive]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


_PAIR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


#: What a row brings; member: it is of the list, asked: it is still to be compared.
_ROW = ("group", "member", "asked", "half", "back", "spelt", "n")


def _compare(rows: dict[str, list]) -> pa.RecordBatch:
    """The pairs of some whole lists (or of one list and some of its words), each once over all lists."""
    spelt, back = np.array(rows["spelt"], object), np.array(rows["back"], bool)
    half, count = np.array(rows["half"], np.int64), np.array(rows["n"], np.int64)
    group, member, ask = np.array(rows["group"], np.int64), np.array(rows["member"], bool), np.array(rows["asked"], bool)
    every = _List(spelt.tolist(), group)
    a, b = near_pairs(_List(spelt[member].tolist(), group[member]), _List(spelt[ask].tolist(), group[ask]), half[ask])
    a, b = np.flatnonzero(ask)[a], np.flatnonzero(member)[b]
    # The half of the shorter one counts, and words spelt backwards only if they do not meet forwards as well.
    right = np.minimum(every.size[a], every.size[b]) // 2 == half[a]
    a, b = a[right], b[right]
    twice = back[a].copy()
    for k in range(int(half[a][twice].max()) if twice.any() else 0):
        look = np.flatnonzero(twice & (half[a] > k))
        x, y = a[look], b[look]
        twice[look] = every.at(x, every.size[x] - 1 - k) == every.at(y, every.size[y] - 1 - k)
    a, b = a[~twice], b[~twice]
    turned = lambda i: [s[::-1] if r else s for s, r in zip(spelt[i].tolist(), back[i].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(turned(a), pa.string()), pa.array(turned(b), pa.string()), pa.array(count[b])], schema=_PAIR)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: the words (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, both ways round.

    Words of one code point meet no others.
    """
    posted = materialize(_postings(words), "half-words")
    lists = F.ceil(F.col("rows") / LIST_WORDS).cast("int")
    group = ("half", "back", "key")
    groups = posted.groupBy(*group).agg(F.count("*").alias("rows")).filter("rows > 1").select(*group, lists.alias("lists"))
    own = F.pmod(F.xxhash64("spelt"), F.col("lists")).cast("int")
    met = posted.join(groups, list(group)).select(*group, F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("part"), "spelt", "n", own.alias("own"))
    dealt = met.select(*group, "part", (F.col("own") == F.col("part")).alias("member"), "spelt", "n")
    ordered = dealt.repartition(n_shuffle(words.sparkSession), *group, "part").sortWithinPartitions(*group, "part", F.desc("member"), "spelt")

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in _ROW}
        last, number, more = None, 0, 0
        for batch in it:
            for half, back, key, part, member, spelt, n in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (half, back, key, part) != last:
                    if len(rows["n"]) >= BATCH_ROWS:
                        yield _compare(rows)
                        rows = {c: [] for c in _ROW}
                    last, number, more = (half, back, key, part), number + 1, 0
                elif more >= BATCH_ROWS:
                    # The list stays for its other words; what is before it is done.
                    yield _compare(rows)
                    kept = [i for i in range(len(rows["n"])) if rows["group"][i] == number and rows["member"][i]]
                    rows, more = {c: [v[i] for i in kept] for c, v in rows.items()} | {"asked": [False] * len(kept)}, 0
                more += not member
                for c, v in zip(_ROW, (number, member, True, half, back, spelt, n), strict=True):
                    rows[c].append(v)
        if rows["n"]:
            yield _compare(rows)

    return ordered.mapInArrow(task, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word (word, form) the last of its forms.  Every round doubles how far all words have come."""
    here = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = here.join(here.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        here = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return here


def spelling_variants(docs: DataFrame, every: int = 97, least_chars: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """Group the words of a corpus with their spelling variants.

    Words are runs of Latin letters, A-Z lower-cased, of at least least_chars
    code points and least_count occurrences; of every ``every``-th run of a
    document, by a checksum of doc_id and run, one letter is left out (0: of
    none).  Two words are near if exactly one inserted, deleted or replaced code
    point makes one of the other.  A word's form is its near word with the
    largest n, the first in code-point order on ties, if that n is ``times`` times
    the word's at least.  Returns word, form, root (the last form from word on,
    word itself if it has none), n, n_near and form_n.

    Null, empty and other texts without letters bring no words; a null doc_id
    counts as an empty one; repeated rows count again.  An empty table gives no
    rows.  Other columns of docs are left out.  A task holds a text's runs, and
    for the comparison some lists of LIST_WORDS words.
    """
    words = materialize(corpus_words(docs, every, least_chars, least_count), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(F.negative("near_n").alias("less"), "near")).alias("best"))
    likely = F.negative("best.less") >= times * F.col("n")
    told = words.join(best, "word", "left").select("word", F.when(likely, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.negative("best.less")).alias("form_n"))
    told = materialize(told, "forms")
    last = roots(told.filter("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
