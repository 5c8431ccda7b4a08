"""Quality: a linear-chain conditional random field labels the lines of a text good or bad.

A line's evidence is its own shape (kinds of characters, repeated words, repeated
lines, ending) and that of the lines before and after it; transitions tie the labels of
neighbours. Training gives each line its document's label. The score of a document is
the mean of the lines' forward-backward marginals of "good", weighted by their bytes and
calibrated on the sample, so that it is the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm import labelled
from tracelore.llm.labelled import logistic
from tracelore.llm.textkit import chunks, fold, ids_of, lean, prefix_hash, span_hash, word_bounds

#: Bounds of the labelled sample: documents of a class, bytes of a text.
PER_CLASS, MAX_BYTES = 1500, 24_576
THRESHOLD = 0.3
#: Training: steps of gradient descent, ridge.
STEPS, RIDGE = 300, 1e-3
#: Kinds of bytes; all others are of the last kind.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r\n", b"#*$%&|<>", b"!?", b".,;:", bytes(range(128, 256)))
_KIND = np.full(256, len(KINDS), np.int64)
for _k, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _k
OWN = len(KINDS) + 1 + 9


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray  # [from, to]
    #: Calibration of the document's mean marginal, as a log-odds: slope and shift.
    slope: float = 1.0
    shift: float = 0.0


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and lines per document: one more than its line feeds."""
    feeds = np.flatnonzero(data == 10)
    per_doc = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    total = int(per_doc.sum())
    last = np.cumsum(per_doc) - 1
    ends = np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    ends[last], ends[inner] = offsets[1:], feeds
    starts = np.empty(total, np.int64)
    head = np.zeros(total, bool)
    head[last - per_doc + 1] = True
    starts[head], starts[~head] = offsets[:-1], feeds + 1
    return starts, ends, per_doc


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence of every line, bytes of every line, lines per document) of a chunk."""
    starts, ends, per_doc = lines_of(data, offsets)
    n, size = len(starts), ends - starts
    line = np.repeat(np.arange(n), size)
    inside = np.ones(len(data), bool)
    feed = ends[:-1][starts[1:] > ends[:-1]]
    inside[feed] = False
    kinds = np.bincount(line * (len(KINDS) + 1) + _KIND[data[inside]], minlength=n * (len(KINDS) + 1)).reshape(n, -1).astype(np.float64)
    length = np.maximum(size, 1)[:, None]
    prefix = prefix_hash(data)
    ws, we, _ = word_bounds(data, offsets)
    hashes = span_hash(prefix, ws, we)
    word_line = np.searchsorted(starts, ws, side="right") - 1
    n_words = np.bincount(word_line, minlength=n)
    again = np.zeros(len(ws), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    repeats = np.bincount(word_line, again, minlength=n) / np.maximum(n_words, 1)
    # distinct words of a line
    order = np.lexsort((hashes, word_line))
    new = np.ones(len(ws), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])
    distinct = np.bincount(word_line[order], new[: len(ws)], minlength=n) / np.maximum(n_words, 1)
    # a line that stands earlier in its document
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    line_hash = span_hash(prefix, starts, ends)
    order = np.lexsort((np.arange(n), line_hash, doc))
    twin = np.zeros(n, bool)
    twin[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (size[order][1:] > 0)
    # fenced words: a word that ends in a symbol, '!' or '?'
    fenced = np.isin(_KIND[data[we - 1]], (4, 5)) if len(we) else np.zeros(0, bool)
    fenced = np.bincount(word_line, fenced, minlength=n) / np.maximum(n_words, 1)
    stop = np.zeros(n)
    some = size > 0
    stop[some] = _KIND[data[ends[some] - 1]] == 6
    own = np.column_stack([kinds / length, repeats, distinct, twin, fenced, stop, size == 0, np.log1p(n_words) / 5, (kinds[:, :3].sum(1) + kinds[:, 7]) / np.maximum(n_words, 1) / 10, np.ones(n)])
    first = np.zeros(n, bool)
    first[np.cumsum(per_doc) - per_doc] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[np.append(first[1:], True)] = 0
    return np.hstack([own, before, after]), size, per_doc


def _grid(per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines, their first lines, and how many have more than t lines."""
    order = np.argsort(-per_doc, kind="stable")
    first = (np.cumsum(per_doc) - per_doc)[order]
    alive = len(per_doc) - np.searchsorted(np.sort(per_doc), np.arange(per_doc.max(initial=0)), side="right")
    return order, first, alive


def marginals(emit: np.ndarray, transitions: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line's label, expected transitions, and the log of the normaliser, over all documents.

    ``emit`` is the score of "good"; "bad" has 0. All documents advance together by one
    line at a time, scaled at each step, so any number of lines is safe.
    """
    n = len(emit)
    shift = np.maximum(emit, 0)
    local = np.exp(np.column_stack([-shift, emit - shift]))
    move = np.exp(transitions)
    order, first, alive = _grid(per_doc)
    forward, scale, backward = np.empty((n, 2)), np.ones(n), np.ones((n, 2))
    for t, k in enumerate(alive):
        at = first[:k] + t
        a = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
        scale[at] = total = a.sum(1)
        forward[at] = a / total[:, None]
    expected = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = local[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        backward[at] = ahead @ move.T
        expected += (forward[at].T @ ahead) * move
    p = forward * backward
    return p / p.sum(1, keepdims=True), expected, float((np.log(scale) + shift).sum())


def train(rows: list[tuple[int, str]], sizes: dict[int, int] | None = None) -> Model:
    """A model from (label, text); without examples of both classes, one that gives every line 0.5 or the only class."""
    y = np.array([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        w = np.zeros(3 * OWN)
        w[OWN - 1] = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        return Model(w, np.zeros((2, 2)))
    raw = [t.encode("utf-8", "replace") for _, t in rows] + [b""]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    x, size, per_doc = features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    x, per_doc = x[:-1], per_doc[:-1]
    label = np.repeat(y, per_doc)
    sizes = sizes or {k: int((y == k).sum()) for k in (0, 1)}
    weight_of = np.array([sizes[k] / (y == k).sum() for k in (0, 1)])
    weight_of = weight_of / (weight_of[y].mean())
    # documents of a class share a weight, so each class is one run of forward-backward
    parts = []
    for k in (0, 1):
        rows_k = label == k
        parts.append((x[rows_k], per_doc[y == k], k, weight_of[k]))
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    n = sum(wt * len(xs) for xs, _, _, wt in parts)
    for step in range(1, STEPS + 1):
        grad_w, grad_t = RIDGE * w, RIDGE * move
        for xs, per, k, wt in parts:
            p, expected, _ = marginals(xs @ w, move, per)
            grad_w = grad_w + wt * (xs.T @ (p[:, 1] - k)) / n
            seen = np.zeros((2, 2))
            seen[k, k] = (per - 1).sum()
            grad_t = grad_t + wt * (expected - seen) / n
        g = np.concatenate([grad_w, grad_t.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move_by = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, move = w - move_by[: len(w)], move - move_by[len(w) :].reshape(2, 2)
    mean = document_means(x, size[:-1], per_doc, w, move)
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    slope, shift = logistic(log_odds(mean), target, weight_of[y])
    # a field that could not tell the classes apart must not turn the order round
    return Model(w, move, max(slope, 0.01), shift)


def document_means(x: np.ndarray, size: np.ndarray, per_doc: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Mean marginal of "good" of each document, by bytes of its lines."""
    p, _, _ = marginals(x @ weights, transitions, per_doc)
    weight = np.maximum(size, 1e-3)
    first = np.cumsum(per_doc) - per_doc
    return np.add.reduceat(p[:, 1] * weight, first) / np.add.reduceat(weight, first)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Document scores of an Arrow array of texts."""
    out = []
    for _, _, data, offsets in chunks(texts):
        x, size, per_doc = features(data, offsets)
        z = model.slope * log_odds(document_means(x, size, per_doc, model.weights, model.transitions)) + model.shift
        out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    return labelled.fit(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, train, per_class, max_bytes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted): one row per row of ``docs`` (doc_id, text); no shuffle.

    A null or empty text is one empty line. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest that query op1 returns."""
    return score(docs, fit(docs, labels)).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
