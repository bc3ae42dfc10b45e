"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  Its features are its own and its neighbours'; the
chain's transitions let lines vouch for each other.  Forward-backward marginals,
weighted by the lines' lengths, make the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_CODES, SPACE, Chunk, byte_set, chunks, prefix, span_hash, word_codes, words
from .line_dedup import lines_of
from .shared import materialize

#: Labelled documents that the field is fitted on, the ones with the smallest hashes of doc_id, and lines of them.
MAX_LABELLED = 3000
MAX_LINES = 150_000
#: Byte classes whose share of a line is a feature.
CLASSES = [byte_set((65, 90)), byte_set((97, 122)), byte_set((48, 57)), byte_set((33, 33), (63, 63)), byte_set((35, 38), (42, 42)), byte_set((124, 124), (60, 60), (62, 62), (123, 126)), byte_set((44, 44), (46, 46)), byte_set((128, 255))]
N_OWN = len(CLASSES) * 2 + 8
N_FEATURES = 3 * N_OWN + 1


def line_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and lengths of all lines with a word, and where each document's begin."""
    starts, ends, bounds = lines_of(chunk)
    ws, we, _ = words(chunk)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    # A document's last line and the next one's first can share no word, as words end with their document.
    use = last > first
    doc = np.repeat(np.arange(len(chunk.rows)), np.diff(bounds))[use]
    starts, ends, first, last = starts[use], ends[use], first[use], last[use]
    n_docs = len(chunk.rows)
    places = np.searchsorted(doc, np.arange(n_docs + 1))
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), places
    solid = np.concatenate([[0], np.cumsum(~SPACE[chunk.data])])
    length = (solid[ends] - solid[starts]).astype(float)
    n = (last - first).astype(float)
    own = np.zeros((len(starts), N_OWN), np.float32)
    for k, table in enumerate(CLASSES):
        share = np.concatenate([[0], np.cumsum(table[chunk.data])])
        share = (share[ends] - share[starts]) / length
        own[:, 2 * k], own[:, 2 * k + 1] = share, share > 0.02
    codes = word_codes(chunk, ws, we, lower=True)
    line = np.repeat(np.arange(len(starts)), last - first)
    of_line = np.concatenate([np.arange(0)] + [codes]) if len(line) == len(codes) else codes[: len(line)]
    order = np.lexsort((of_line, line))
    new = np.concatenate([[True], (line[order][1:] != line[order][:-1]) | (of_line[order][1:] != of_line[order][:-1])])
    distinct = np.bincount(line[order][new], minlength=len(starts))
    whole = span_hash(prefix(BYTE_CODES[chunk.data]), starts, ends)
    order = np.lexsort((whole, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    repeated = np.zeros(len(starts), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    # Three words that the document has again.
    triple = span_hash(prefix(codes), np.arange(max(0, len(codes) - 2)), np.arange(2, len(codes)) + 1) if len(codes) > 2 else np.zeros(0, np.uint64)
    of_doc = np.searchsorted(bounds, np.searchsorted(lines_of(chunk)[0], ws, side="right") - 1, side="right") - 1
    inside = of_doc[: len(triple)] == of_doc[2:] if len(triple) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order = np.lexsort((triple[at], of_doc[at]))
    same = (triple[at][order][1:] == triple[at][order][:-1]) & (of_doc[at][order][1:] == of_doc[at][order][:-1])
    again = np.zeros(len(codes) + 1)
    hit = np.zeros(len(at), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    again[at[hit]] = 1
    again = np.concatenate([[0], np.cumsum(again[:-1])])
    k = 2 * len(CLASSES)
    own[:, k] = np.log1p(n) / 5
    own[:, k + 1] = np.log1p(length) / 8
    own[:, k + 2] = np.minimum(length / n, 30) / 10
    own[:, k + 3] = distinct / n
    own[:, k + 4] = repeated
    own[:, k + 5] = (again[last] - again[first]) / n
    own[:, k + 6] = np.isin(chunk.data[we[last - 1] - 1], [46, 33, 63])
    own[:, k + 7] = n < 3
    before, after = np.zeros_like(own), np.zeros_like(own)
    linked = doc[1:] == doc[:-1]
    before[1:][linked], after[:-1][linked] = own[:-1][linked], own[1:][linked]
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1), length, places


class Chain:
    """A two-label chain: weights of the features for a good line, and transitions."""

    def __init__(self) -> None:
        self.weights, self.moves, self.base_rate = np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5

    def marginals(self, score: np.ndarray, places: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per line the probability of being good, and the expected transitions, those into the next line weighted by each line's weight.

        All documents advance together, the longest first, so that those still
        running are always a prefix.
        """
        size = np.diff(places)
        order = np.argsort(-size, kind="stable")
        start, size = places[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]
        forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        both = np.stack([np.zeros(len(score)), score], axis=1)
        for t in range(steps):
            n = alive[t]
            at = start[:n] + t
            came = both[at] if t == 0 else both[at] + np.logaddexp(forward[at - 1][:, :1] + self.moves[0], forward[at - 1][:, 1:] + self.moves[1])
            # Only differences matter, so each place is kept near zero.
            forward[at] = came - came.max(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            n = alive[t + 1]
            at = start[:n] + t
            later = both[at + 1] + backward[at + 1]
            back = np.logaddexp(later[:, :1] + self.moves[:, 0], later[:, 1:] + self.moves[:, 1])
            backward[at] = back - back.max(axis=1, keepdims=True)
        log = forward + backward
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        ends = np.zeros(len(score), bool)
        ends[(places[1:] - 1)[np.diff(places) > 0]] = True
        at = np.flatnonzero(~ends)
        pair = forward[at][:, :, None] + self.moves + (both[at + 1] + backward[at + 1])[:, None, :] if len(at) else np.zeros((0, 2, 2))
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)) if len(at) else pair
        pair /= pair.sum(axis=(1, 2), keepdims=True) if len(at) else 1
        return good, (pair if weight is None else pair * weight[at, None, None]).sum(axis=0)

    def likelihood(self, features: np.ndarray, places: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
        """The weighted log-likelihood of lines that all bear their document's label."""
        score, total = features @ self.weights, 0.0
        for a, b, v in zip(places[:-1].tolist(), places[1:].tolist(), label.tolist(), strict=True):
            if b > a:
                ahead = np.array([0.0, score[a]])
                for x in score[a + 1 : b]:
                    ahead = np.logaddexp(ahead[0] + self.moves[0], ahead[1] + self.moves[1]) + np.array([0.0, x])
                own = v * score[a:b].sum() + (b - a - 1) * self.moves[v, v]
                total += weight[a] * (own - np.logaddexp(*ahead))
        return total

    def gradient(self, features: np.ndarray, places: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the likelihood, by weights and then moves; weight is the same for all lines of a document."""
        size = np.diff(places)
        good, pairs = self.marginals(features @ self.weights, places, weight)
        lines = np.repeat(label, size).astype(float)
        within = np.ones(len(lines), bool)
        within[(places[1:] - 1)[size > 0]] = False  # from a document's last line nothing moves on
        seen = np.diag([(weight * within * (lines == v)).sum() for v in (0, 1)])
        return np.concatenate([features.T @ (weight * (lines - good)), (seen - pairs).ravel()])

    def fit(self, features: np.ndarray, places: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.15, shrink: float = 1e-3) -> None:
        """Maximise the weighted likelihood of lines that all bear their document's label, less a penalty, by Adam."""
        self.base_rate = float(label.mean()) if len(label) else 0.5
        size = np.diff(places)
        line_label = np.repeat(label, size).astype(float)
        if not len(line_label):
            return
        # A document counts as one, whatever its length: its likelihood is weighted by 1 / lines.
        weight = np.repeat(1 / np.maximum(size, 1), size)
        n_docs = max(1.0, weight.sum())
        mean, spread = features[:, :-1].mean(axis=0), features[:, :-1].std(axis=0) + 1e-3
        scaled = np.concatenate([(features[:, :-1] - mean) / spread, features[:, -1:]], axis=1)
        w, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
        m1 = m2 = np.zeros(N_FEATURES + 4)
        for t in range(1, steps + 1):
            self.weights, self.moves = w, moves
            grad = self.gradient(scaled, places, label, weight) / n_docs - shrink * np.concatenate([w, moves.ravel()])
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            w, moves = w + step[:-4], np.clip(moves + step[-4:].reshape(2, 2), -2, 2)
        unscaled = w.copy()
        unscaled[:-1] /= spread
        unscaled[-1] -= (mean * unscaled[:-1]).sum()
        self.weights, self.moves = unscaled, moves

    def document_scores(self, features: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
        good, _ = self.marginals(features @ self.weights, places)
        total = np.concatenate([[0], np.cumsum(length)])
        held = np.concatenate([[0], np.cumsum(length * good)])
        n = total[places[1:]] - total[places[:-1]]
        return np.where(n > 0, np.clip((held[places[1:]] - held[places[:-1]]) / np.maximum(n, 1e-9), 0, 1), self.base_rate)


def is_held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit_chain(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> Chain:
    """Fit on at most ``max_labelled`` labelled documents that are not held out, and ``max_lines`` lines.

    Documents are taken in the order of their hashes; one whose lines do not
    fit any more is left out.  Of rows that repeat a doc_id one is taken.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~is_held_out("doc_id"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toDF("sampled", "label")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(sample), F.col("id") == F.col("sampled")).groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label")).select("id", "text", "label")

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for chunk in chunks(batch.column(1)):
                features, _, places = line_features(chunk)
                body = [features[a:b].astype(np.float16).tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
                columns = [batch.column(0).take(pa.array(chunk.rows)), batch.column(2).take(pa.array(chunk.rows)).cast(pa.int32()), pa.array(np.diff(places), pa.int64()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "n_lines", "features"])

    id_type = known.schema["id"].dataType.simpleString()
    lines = materialize(known.mapInArrow(task, f"id {id_type}, label int, n_lines long, features binary"), "lines")
    taken, left = [], max_lines
    for r in lines.select("id", "n_lines").orderBy(F.xxhash64("id"), "id").collect():  # at most max_labelled rows
        if r.n_lines <= left:
            taken.append(r.id)
            left -= r.n_lines
    rows = lines.filter(F.col("id").isin(taken)).select("features", "label").orderBy("id").collect() if taken else []
    chain = Chain()
    parts = [np.frombuffer(r.features, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    if parts:
        chain.fit(np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), np.array([r.label for r in rows]))
    return chain


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> DataFrame:
    """doc_id, held_out, score (of the whole text, 0 to 1) and predicted (1 if score >= threshold).

    labels has doc_id and quality.  Rows whose crc32(doc_id as text) mod 5 is 0
    are held out of the fit.  Texts without words score the base rate of the
    fitted labels; without any labels every text scores from a flat chain, 0.5.
    A null doc_id is scored and not held out.  Repeated rows are scored alike.
    Other columns of docs are left out.  The field is fitted on the driver, on
    at most ``max_labelled`` documents and ``max_lines`` lines of them; scoring
    holds a text, with its lines' features, in one task.
    """
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, max_labelled, max_lines))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column(2)):
                # Rounded, so that a text scores the same wherever it stands in a batch.
                scores[chunk.rows] = chain.value.document_scores(*line_features(chunk)).round(9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
