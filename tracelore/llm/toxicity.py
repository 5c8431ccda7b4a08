"""Toxicity: a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

A text is cut into sentences and these into units: words, lower-cased and freed of
ASCII punctuation, with runs of single letters joined ("i d i o t"). The kernel of two
units is the gap-weighted count of their common subsequences of ORDER bytes,
normalised, to the power SHARPEN; a letter that is inserted or left out only lengthens
a gap. Sentences have the sum over pairs of their distinct units. Nystroem landmarks map a sentence
to a vector; a squared-hinge machine separates sentences, with the worst sentence of
each toxic document as its example. As that machine is linear, a sentence's score is a
sum of one number per unit, which a task computes once per distinct unit.
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
from tracelore.llm.textkit import LOWER, chunks, fold, ids_of, lean, prefix_hash, span_hash, word_bounds

#: Kernel: subsequence length, weight of a letter's place, power of the normalised kernel.
ORDER, DECAY, SHARPEN = 4, np.float32(0.8), 2
#: Most landmarks, and toxic documents of the sample that must hold a landmark.
LANDMARKS, SUPPORT = 56, 4
#: Standard errors by which a landmark must tell the classes apart; thousands of units are tried.
LEAST_Z = 6
#: A unit over WINDOW bytes is taken as windows that overlap by half.
WINDOW = 32
#: Bounds of the labelled sample: documents of a class, bytes of a text.
PER_CLASS, MAX_BYTES = 1500, 16_384
#: Bytes of text, and scores of units, that a worker holds at once.
HELD_BYTES, HELD_UNITS = 1 << 20, 300_000
THRESHOLD = 0.7

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass
class Model:
    landmarks: list[bytes]
    alpha: np.ndarray
    bias: float
    slope: float
    shift: float


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, ends, units per sentence, sentences per document) of a chunk of lower-cased bytes.

    A document without a word has no sentence.
    """
    starts, ends, per_doc = word_bounds(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none, np.zeros(len(per_doc), np.int64)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    single = (ends - starts == 1) & _KEEP[data[starts]]
    joined = np.zeros(n, bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1) & (doc[1:] == doc[:-1])
    stop = np.zeros(n, bool)
    stop[1:] = (doc[1:] != doc[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] != lines[ends[:-1]])
    joined &= ~stop
    sentence = np.cumsum(stop)
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], n) - 1
    keep = _KEEP[data]
    letters, where = data[keep], np.concatenate([[0], np.cumsum(keep)])
    s, e = where[starts[head]], where[ends[tail]]
    n_sentences = int(sentence[-1]) + 1
    first_of = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    per_sentence = np.bincount(sentence[head], minlength=n_sentences)
    sentences = np.bincount(doc[first_of], minlength=len(per_doc))
    return letters, s, e, per_sentence, sentences


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of at most WINDOW that cover the given spans, and the number for each."""
    size = ends - starts
    times = np.where(size > WINDOW, -(-(size - WINDOW) // (WINDOW // 2)) + 1, 1)
    if times.max(initial=1) == 1:
        return starts, ends, times
    first = np.repeat(starts, times)
    step = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
    first = first + step * (WINDOW // 2)
    return first, np.minimum(first + WINDOW, np.repeat(ends, times)), times


def matrix(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """One column per span, padded with 0 below."""
    at = starts[None, :] + np.arange(width)[:, None]
    out = letters[np.minimum(at, max(len(letters) - 1, 0))] if len(letters) else np.zeros(at.shape, np.uint8)
    out[at >= ends[None, :]] = 0
    return out


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gap-weighted count of common subsequences of ORDER bytes, column by column.

    ``right`` may have one column for all. The inner recursion over ``right`` is a product
    with a triangle of powers of DECAY.
    """
    n, height = left.shape[1], right.shape[0]
    power = np.arange(height)[:, None] - np.arange(height)[None, :]
    decay = np.where(power >= 0, DECAY ** np.maximum(power, 0), 0).astype(np.float32)
    level = [np.zeros((height + 1, n), np.float32) for _ in range(ORDER)]
    level[0][:] = 1
    total = np.zeros(n, np.float32)
    for x in left:
        match = ((right == x[None, :]) & (x != 0)[None, :]).astype(np.float32) * (DECAY * DECAY)
        total += np.einsum("ij,ij->j", match, level[-1][:-1])
        for i in range(ORDER - 1, 0, -1):
            level[i][1:] *= DECAY
            level[i][1:] += decay @ (match * level[i - 1][:-1])
    return total


def common_at_least(left: np.ndarray, landmark: bytes, least: int) -> np.ndarray:
    """Whether each column shares a subsequence of ``least`` bytes with the landmark (bit-parallel)."""
    masks = np.zeros(256, np.uint32)
    for k, c in enumerate(landmark):
        masks[c] |= np.uint32(1 << k)
    v = np.full(left.shape[1], 0xFFFFFFFF, np.uint32)
    for x in left:
        u = v & masks[x]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint32((1 << len(landmark)) - 1)) >= least


def similarities(columns: np.ndarray, landmarks: list[bytes]) -> np.ndarray:
    """The sharpened, normalised kernel of every column (a unit of at most WINDOW bytes) with every landmark."""
    n = columns.shape[1]
    out = np.zeros((n, len(landmarks)), np.float32)
    if not n:
        return out
    shared = [np.flatnonzero(common_at_least(columns, z, ORDER)) for z in landmarks]
    used = np.unique(np.concatenate(shared)) if shared else np.zeros(0, np.int64)
    own = np.zeros(n, np.float32)
    for a in range(0, len(used), 2048):
        part = columns[:, used[a : a + 2048]]
        own[used[a : a + 2048]] = kernel(part, part)
    for j, (z, rows) in enumerate(zip(landmarks, shared, strict=True)):
        column = np.frombuffer(z, np.uint8)[:, None]
        z_own = kernel(column, column)[0]
        for a in range(0, len(rows), 4096):
            r = rows[a : a + 4096]
            out[r, j] = (kernel(columns[:, r], column) / np.sqrt(np.maximum(own[r] * z_own, 1e-30))) ** SHARPEN
    return out


def unit_values(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, landmarks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """What ``alpha`` makes of each span's similarities; shape (spans, columns of alpha)."""
    out = np.zeros((len(starts), alpha.shape[1]), np.float32)
    size = ends - starts
    low = ORDER
    for width in (8, 12, 16, 24, WINDOW):
        rows = np.flatnonzero((size >= low) & (size <= width))
        low = width + 1
        for a in range(0, len(rows), 100_000):
            r = rows[a : a + 100_000]
            out[r] = similarities(matrix(letters, starts[r], ends[r], width), landmarks) @ alpha
    return out


def sentence_sums(value: np.ndarray, key: np.ndarray, times: np.ndarray, per_sentence: np.ndarray) -> np.ndarray:
    """Sum of value[key] over the distinct keys of each sentence; times is the number of keys of each unit."""
    some = value != 0 if value.ndim == 1 else value.any(1)
    key_some = some[key] if len(key) else np.zeros(0, bool)
    sentence = np.repeat(np.repeat(np.arange(len(per_sentence)), per_sentence), times)[key_some]
    n = max(len(value), 1)
    pairs = np.unique(sentence * n + key[key_some])
    out = np.zeros((len(per_sentence), *value.shape[1:]))
    if len(pairs):
        first = np.flatnonzero(np.append(True, pairs[1:] // n != pairs[:-1] // n))
        out[pairs[first] // n] = np.add.reduceat(value[pairs % n].astype(np.float64), first, axis=0)
    return out


class Scorer:
    """Scores chunks of documents; remembers the values of units between chunks, up to HELD_UNITS."""

    def __init__(self, model: Model) -> None:
        self.model, self.alpha = model, model.alpha.reshape(-1, 1).astype(np.float32)
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The worst sentence of each document; the bias alone where there is none."""
        letters, starts, ends, per_sentence, sentences = units(LOWER[data], offsets)
        first, last, times = windows(starts, ends)
        hashes, at, back = np.unique(span_hash(prefix_hash(letters), first, last), return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[where] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        value = np.zeros(len(hashes), np.float32)
        if len(self.hashes):
            value[known] = self.values[where[known]]
        new = at[~known]
        value[~known] = unit_values(letters, first[new], last[new], self.model.landmarks, self.alpha)[:, 0]
        if len(self.hashes) + len(new) > HELD_UNITS:
            self.hashes, self.values = hashes, value
        elif len(new):
            merged = np.concatenate([self.hashes, hashes[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.values = merged[order], np.concatenate([self.values, value[~known]])[order]
        per_sent = sentence_sums(value, back.ravel(), times, per_sentence) + self.model.bias
        out = np.full(len(sentences), self.model.bias)
        some = sentences > 0
        if some.any():
            out[some] = np.maximum.reduceat(per_sent, (np.cumsum(sentences) - sentences)[some])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.margins(data, offsets) for _, _, data, offsets in chunks(texts, HELD_BYTES)]
        margin = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.model.slope * margin + self.model.shift, -50, 50)))


def choose_landmarks(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, y: np.ndarray) -> list[bytes]:
    """Units that tell the classes apart best and are unlike each other."""
    ok = np.flatnonzero(ends - starts >= ORDER)
    _, at, back = np.unique(span_hash(prefix_hash(letters), starts[ok], ends[ok]), return_index=True, return_inverse=True)
    at = ok[at]
    pairs = np.unique(back.ravel() * (len(y) + 1) + doc[ok])
    unit, of = pairs // (len(y) + 1), pairs % (len(y) + 1)
    n_pos, n_neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    # by how many standard errors the share of toxic documents that hold a unit exceeds that of the others
    pos, neg = (np.bincount(unit, side[of].astype(float), len(at)) for side in (y, 1 - y))
    both = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-9)
    telling = np.flatnonzero((z > LEAST_Z) & (pos >= SUPPORT) & (pos / n_pos >= 10 * neg / n_neg))
    text = {k: bytes(letters[starts[at[k]] : min(ends[at[k]], starts[at[k]] + WINDOW)]) for k in telling.tolist()}
    order = sorted(text, key=lambda k: (-z[k], text[k]))[:2000]
    # first units that share no run of ORDER bytes, so that each stem has its landmark; then more units that are unlike those
    chosen: list[bytes] = []
    covered: set[bytes] = set()
    for fresh in (True, False):
        for k in order:
            if len(chosen) >= LANDMARKS:
                break
            runs = {text[k][i : i + ORDER] for i in range(len(text[k]) - ORDER + 1)}
            if text[k] in chosen or (fresh and runs & covered):
                continue
            column = matrix(np.frombuffer(text[k], np.uint8), np.array([0]), np.array([len(text[k])]), WINDOW)
            if not chosen or similarities(column, chosen).max() < 0.5:
                chosen.append(text[k])
                covered |= runs
    return chosen


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias (last) of the squared-hinge machine, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        grad = reg * w - x[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(reg) + (x[on] * weight[on, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def worst(doc: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Marks the sentence with the highest score of each document, the first among equals."""
    order = np.lexsort((np.arange(len(doc)), -score, doc))
    out = np.zeros(len(doc), bool)
    out[order[np.append(True, doc[order][1:] != doc[order][:-1])] if len(doc) else order] = True
    return out


def train(rows: list[tuple[int, str]], sizes: dict[int, int] | None = None) -> Model:
    """A model from (label, text); without examples of both classes, one that gives the share of 1 for any text."""
    y = np.array([r[0] for r in rows], np.int64)
    n = {k: int((y == k).sum()) for k in (0, 1)}
    sizes = sizes or n
    if not n[0] or not n[1]:
        share = 0.5 if not rows else float(np.clip(y.mean(), 0.01, 0.99))
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    raw = [t.encode("utf-8", "replace") for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    letters, starts, ends, per_sentence, sentences = units(LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets)
    first, last, times = windows(starts, ends)
    sentence_doc = np.repeat(np.arange(len(y)), sentences)
    unit_doc = np.repeat(np.repeat(sentence_doc, per_sentence), times)
    marks = choose_landmarks(letters, first, last, unit_doc, y) if len(first) else []
    if not marks:
        share = sizes[1] / (sizes[0] + sizes[1])
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    column = np.concatenate([matrix(np.frombuffer(z, np.uint8), np.array([0]), np.array([len(z)]), WINDOW) for z in marks], 1)
    grid = similarities(column, marks).astype(np.float64)
    value, vector = np.linalg.eigh((grid + grid.T) / 2)
    good = value > 1e-4 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    hashes, at, back = np.unique(span_hash(prefix_hash(letters), first, last), return_index=True, return_inverse=True)
    mapped = unit_values(letters, first[at], last[at], marks, whiten.astype(np.float32))
    x = sentence_sums(mapped, back.ravel(), times, per_sentence)
    # a landmark with one letter more inside is as toxic as the landmark itself
    spread = [z[:k] + b"x" + z[k:] for z in marks for k in range(1, len(z)) if len(z) < WINDOW]
    joint = np.frombuffer(b"".join(spread), np.uint8)
    ends_at = np.cumsum([len(v) for v in spread])
    made = unit_values(joint, ends_at - [len(v) for v in spread], ends_at, marks, whiten.astype(np.float32)).astype(np.float64)
    label = y[sentence_doc]
    # to begin with, a sentence is as bad as its likeness to the contrasted landmarks
    plain = unit_values(letters, first[at], last[at], marks, np.ones((len(marks), 1), np.float32))[:, 0].astype(np.float64)
    pick = worst(sentence_doc, sentence_sums(plain, back.ravel(), times, per_sentence)) | (label == 0)
    for k in range(6):
        weight = np.where(label[pick] == 1, 1 / max(1, (label[pick] == 1).sum()), 1 / max(1, (label[pick] == 0).sum())) * 1000
        w = hinge(np.vstack([x[pick], made]), np.concatenate([2.0 * label[pick] - 1, np.ones(len(made))]), np.concatenate([weight, np.full(len(made), 100 / max(1, len(made)))]))
        score = x @ w[:-1]
        # the worst sentence of a toxic document; all sentences of the others
        pick = worst(sentence_doc, score) | (label == 0)
    margin = np.full(len(y), w[-1])
    np.maximum.at(margin, sentence_doc, score + w[-1]) if len(x) else None
    # Platt's smoothed targets, each class at its share among all labelled ids
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    slope, shift = logistic(margin, target, weight / weight.mean())
    return Model(marks, whiten @ w[:-1], float(w[-1]), slope, shift)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    return labelled.fit(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, train, per_class, max_bytes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted): one row per row of ``docs``; no shuffle.

    Null and empty texts get the score of a text without sentences. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest that query op3 returns."""
    return score(docs, fit(docs, labels)).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns; row by row, so nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = scorer.scores(batch.column(batch.schema.get_field_index("text"))) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
