"""Fitting classifiers on a bounded sample of labelled texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.llm.textkit import lean, stored


def _below(share: float) -> int:
    """The greatest 64-bit hash in the lowest ``share`` of all."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, train: Callable, per_class: int, max_bytes: int):
    """What ``train`` makes of at most ``per_class`` (label, text) of each class, and of how many labelled ids each class has.

    ``learn`` is the condition on doc_id for rows to learn from. Rows without an id or a
    label are left out; an id with several labels takes their rounded mean, one with several
    texts the least of those that may be sampled. Texts over ``max_bytes`` are not sampled; of
    the ids that have another, the first in the order of a hash are, so the sample repeats.
    One task trains, on 2 * per_class * max_bytes of text at most. Scoring has no bound.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")).where(learn)
    sizes = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    short = F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes
    able = stored(docs.where(short).select("doc_id").join(ids, "doc_id").distinct(), "labelled")
    n = {r["y"]: r["n"] for r in able.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # a share of the hash's range that holds about twice as many as are wanted: no task sorts more
    taken = [able.where((F.col("y") == y) & (F.xxhash64("doc_id") <= _below(2 * per_class / n[y]))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in n]
    if not taken:
        return train([], None)
    # bounded by 2 * per_class rows of 12 bytes
    chosen = F.broadcast(reduce(DataFrame.union, taken))
    rows = docs.where(short).select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((d, y, t) for batch in batches for d, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(y, t) for _, y, t in got], {k: sizes.get(k, 0) for k in (0, 1)}))])], ["model"])

    made = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else train([], None)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt scaling."""
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - target)) + 1e-3 * w * [1, 0]
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9]), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
