"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are those of the line and of both neighbours. The
field is trained on a bounded sample of labelled documents whose lines all take the
document's label; forward-backward marginals, weighted by line length, give the document's
share of good text, and a logistic curve fitted on the same sample turns it into a score.

Defined results: a null or blank text scores 0; rows with a null doc_id or null label are not
learned from; of several labels of one document the largest counts, of several texts the least is
learned from; repeated rows score alike; without any labelled document of both kinds every text scores by its own
symbols alone (see ``untrained``). Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.text import WHITE, mixed, pieces, prefix_hashes, span_hashes

#: At most so many labelled documents are learned from, each of at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 15
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS = 8
EPOCHS, STEP, RIDGE = 60, 0.05, 1e-4
#: Text scored at once, in bytes: some twenty arrays of eight bytes a byte stand beside it.
SCORED_BYTES = 1 << 18

_KINDS = np.zeros((256, 6), dtype=bool)  # upper, lower, digit, sentence mark, other symbol, beyond ASCII
_KINDS[0x41:0x5B, 0] = _KINDS[0x61:0x7B, 1] = _KINDS[0x30:0x3A, 2] = _KINDS[0x80:, 5] = True
_KINDS[[0x21, 0x22, 0x27, 0x28, 0x29, 0x2C, 0x2D, 0x2E, 0x3A, 0x3B, 0x3F], 3] = True
_KINDS[0x21:0x7F, 4] = ~_KINDS[0x21:0x7F, :4].any(axis=1)
N_FEATURES = 14


@dataclass
class Lines:
    values: np.ndarray  # lines x features
    size: np.ndarray  # bytes without white space
    first: np.ndarray  # where each document's lines begin, one more at the end


def line_features(texts: list[bytes]) -> Lines:
    """Features of every line that is not blank."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    end = np.flatnonzero(data == 0x0A)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    white = WHITE[data]
    ink = np.r_[0, np.cumsum(~white)]
    size = ink[end] - ink[start]
    start, end, size = start[size > 0], end[size > 0], size[size > 0]
    doc = np.searchsorted(at, start, side="right") - 1
    first = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))]
    n = len(start)
    if not n:
        return Lines(np.zeros((0, N_FEATURES)), size, first)
    share = []
    for k in range(6):
        total = np.r_[0, np.cumsum(_KINDS[data, k])]
        share.append((total[end] - total[start]) / size)
    prefix = prefix_hashes(data)
    edge = np.diff(np.r_[True, white, True].astype(np.int8))
    w0, w1 = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = span_hashes(prefix, w0, w1)
    line = np.searchsorted(start, w0, side="right") - 1
    words = np.bincount(line, minlength=n)
    pair = mixed(word + np.r_[word[1:], word[:1]] * np.uint64(3) + doc[line].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    again = np.bincount(line, weights=times[back] > 1, minlength=n) / words
    own = mixed(word + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(own, return_index=True)
    distinct = np.bincount(line[kept], minlength=n) / words
    marked = np.bincount(line, weights=_KINDS[data[w1 - 1], 4] | (data[w1 - 1] == 0x21), minlength=n) / words
    _, same, copies = np.unique(mixed(span_hashes(prefix, start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    shortest = np.bincount(line, weights=w1 - w0 == 1, minlength=n) / words
    ends = np.isin(data[end - 1], [0x21, 0x2E, 0x3F])
    values = np.stack([*share, np.log1p(size), size / words, again, distinct, marked, shortest, copies[same] > 1, ends.astype(float)], axis=1)
    return Lines(values, size, first)


@dataclass
class Field:
    """Weights of the field: per feature bin for the line itself and both neighbours, and per pair of labels."""

    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # of label 1 against label 0
    pairs: np.ndarray  # 2 x 2
    slope: float
    shift: float

    def _bins(self, lines: Lines) -> np.ndarray:
        """For each line the positions of its active weights; the last is the bias."""
        n, doc = len(lines.values), np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        own = np.stack([np.searchsorted(self.edges[f], lines.values[:, f], side="right") + f * (BINS + 1) for f in range(N_FEATURES)], axis=1) if n else np.zeros((0, N_FEATURES), dtype=np.int64)
        width = N_FEATURES * (BINS + 1)
        out = [own]
        for side, shift in ((1, 1), (2, -1)):
            near = np.roll(own, shift, axis=0)
            missing = np.roll(doc, shift) != doc
            if n:
                missing[0 if shift == 1 else -1] = True
            near[missing] = np.arange(N_FEATURES) * (BINS + 1) + BINS  # no such neighbour
            out.append(near + side * width)
        return np.concatenate([*out, np.full((n, 1), 3 * width, dtype=np.int64)], axis=1)

    def marginals(self, bins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(line is good), its log likelihood if all are good or all bad is not needed; and expected label pairs."""
        emit = self.weights[bins].sum(axis=1)
        emit = np.stack([np.zeros(len(emit)), np.clip(emit, -60, 60)], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(self.pairs - self.pairs.max())
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        length, begin = n[order], first[:-1][order]
        longest = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(longest), side="left")  # documents of more than t lines
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        for t in range(longest):
            at = begin[: live[t]] + t
            a = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ move)
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(longest - 1, -1, -1):
            at = begin[: live[t]] + t
            b = np.ones((len(at), 2))
            more = length[: live[t]] > t + 1
            b[more] = (emit[at[more] + 1] * back[at[more] + 1]) @ move.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        both = ahead * back
        both /= both.sum(axis=1, keepdims=True)
        inner = np.ones(len(emit), dtype=bool)
        inner[first[:-1][n > 0]] = False
        at = np.flatnonzero(inner)
        joint = ahead[at - 1][:, :, None] * move[None] * (emit[at] * back[at])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return both[:, 1], joint, at

    def shares(self, lines: Lines) -> np.ndarray:
        """The length-weighted mean marginal of each document; NaN for one without lines."""
        good, _, _ = self.marginals(self._bins(lines), lines.first)
        doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        n = len(lines.first) - 1
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, weights=good * lines.size, minlength=n) / np.bincount(doc, weights=lines.size, minlength=n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        share = self.shares(line_features(texts))
        p = np.clip(share, 1e-6, 1 - 1e-6)
        score = 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))
        return np.where(np.isnan(share), 0.0, score)


def untrained() -> Field:
    """A field that only counts symbols; used where no labels of both kinds exist."""
    edges = np.tile(np.linspace(0.05, 0.5, BINS - 1), (N_FEATURES, 1))
    field = Field(edges, np.zeros(3 * N_FEATURES * (BINS + 1) + 1), np.zeros((2, 2)), 1.0, 0.0)
    field.weights[4 * (BINS + 1) : 4 * (BINS + 1) + BINS] = np.linspace(2, -4, BINS)
    return field


def train(texts: list[bytes], labels: np.ndarray) -> Field:
    """Maximum likelihood by gradient steps (Adam) with a small ridge; same result for the same rows in the same order."""
    if len(set(labels.tolist())) < 2:
        return untrained()
    lines = line_features(texts)
    field = untrained()
    field.edges = np.quantile(lines.values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    field.weights[:] = 0
    bins, doc = field._bins(lines), np.repeat(np.arange(len(texts)), np.diff(lines.first))
    truth = labels[doc].astype(float)
    rate = 1 / np.maximum(np.diff(lines.first), 1)[doc]  # a document counts once, however many lines it has
    theta = np.zeros(len(field.weights) + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        good, joint, at = field.marginals(bins, lines.first)
        error = (truth - good) * rate
        grad = np.bincount(bins.reshape(-1), weights=np.repeat(error, bins.shape[1]), minlength=len(field.weights))
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[at - 1].astype(int), truth[at].astype(int)), rate[at])
        grad = np.r_[grad, (seen - (joint * rate[at][:, None, None]).sum(axis=0)).reshape(-1)] / len(texts) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field.weights, field.pairs = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    share = np.nan_to_num(field.shares(lines), nan=0.5)
    p = np.clip(share, 1e-6, 1 - 1e-6)
    x, y = np.log(p / (1 - p)), labels.astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([((y - q) * x).sum() - 0.01 * a, (y - q).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a + float(d[0]), b + float(d[1])
        if abs(d).max() < 1e-8:
            break
    field.slope, field.shift = max(a, 1e-3), b
    return field


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """The field, from the ``sample_docs`` labelled documents outside the held-out fold that a hash puts first."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one text per document, however often its id stands

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, quality = [], []
        for b in batches:
            texts += [t.encode() for t in b.column("text").to_pylist()]
            quality += b.column("quality").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(quality, dtype=np.int64)))], pa.binary())], names=["field"])

    # The sample is bounded, so one task holds it; only the weights come to the driver.
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(learn, "field binary").collect()
    return pickle.loads(one[0].field) if one else untrained()


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, most=SCORED_BYTES):
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"))
    schema = rows.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the field does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, most=SCORED_BYTES):
            yield part.filter(pa.array(shared.value.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
