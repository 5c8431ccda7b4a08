"""Discriminative subsequences of behavior strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelore.operators.sequences import BEHAVIORS, ngrams

#: Lengths of candidates, and most candidates of a length.
LENGTHS, POOL = range(3, 9), 2000
#: Traces that a task measures at once.
TRACES = 64
#: Distances that a task makes at once, and those that a task makes in all, in ``aligned``.
CELLS, TASK_CELLS = 1 << 18, 1 << 25
#: Windows of a trace that meet the candidates at once.
WINDOWS = 1024


def candidates(sequences: DataFrame, lengths: range = LENGTHS, pool: int = POOL, by: tuple[str, ...] = ()) -> DataFrame:
    """(k, gram, freq, rank): the most frequent grams of each length, within each value of ``by``; ties by gram."""
    tagged = lambda k: F.transform(ngrams(F.col("seq"), k), lambda g: F.struct(F.lit(k).alias("k"), g.alias("gram")))
    grams = F.explode(F.flatten(F.array(*[tagged(k) for k in lengths])))
    counts = sequences.select(*by, grams.alias("g")).groupBy(*by, "g.k", "g.gram").agg(F.count("*").alias("freq"))
    # |alphabet| ** k grams of a length at most, ranked by a top-k that is taken per task first
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "k").orderBy(F.desc("freq"), "gram")).cast("long")).where(F.col("rank") <= pool)


def encode(seq: str) -> np.ndarray:
    """Codes of the behaviors; other characters count as the first."""
    return np.array([max(BEHAVIORS.index(c), 0) if c in BEHAVIORS else 0 for c in seq], np.int64)


def _tables(pool: dict[int, list[str]]) -> dict[int, np.ndarray]:
    """The candidates of each length as rows of ones and zeros."""
    return {k: np.eye(len(BEHAVIORS), dtype=np.float32)[np.array([encode(g) for g in gs])].reshape(len(gs), -1) for k, gs in pool.items()}


def _misses(seq: str, tables: dict[int, np.ndarray]) -> np.ndarray:
    """Least mismatches of each candidate over all windows; its length where the trace is shorter."""
    codes, out = np.eye(len(BEHAVIORS), dtype=np.float32)[encode(seq)], [np.zeros(0, np.int64)]
    for k, table in tables.items():
        if len(seq) >= k:
            windows = np.lib.stride_tricks.sliding_window_view(codes, k, axis=0).transpose(0, 2, 1).reshape(len(seq) - k + 1, -1)
            # traces repeat themselves: equal windows are measured once
            windows = windows if len(windows) < WINDOWS else np.unique(windows, axis=0)
            best = np.zeros(len(table), np.float32)
            for a in range(0, len(windows), WINDOWS):
                np.maximum(best, (windows[a : a + WINDOWS] @ table.T).max(0), out=best)
            out.append(k - best.round().astype(np.int64))
        else:
            out.append(np.full(len(table), k))
    return np.concatenate(out)


def _measured(sequences: DataFrame, pool: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` makes of batches of traces: a table, the mismatches (trace, candidate), the candidates' lengths and the candidates.

    The pool is bounded by POOL grams of each length and is broadcast; a trace's windows
    meet all candidates of a length in one matrix product.
    """
    grams = [(r["k"], r["gram"]) for r in pool.select("k", "gram").orderBy("k", "gram").collect()]
    shared = sequences.sparkSession.sparkContext.broadcast({k: [g for n, g in grams if n == k] for k in sorted({n for n, _ in grams})})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables(shared.value)
        grams = np.concatenate([np.array(gs, object) for gs in shared.value.values()]) if shared.value else np.zeros(0, object)
        lengths = np.concatenate([np.full(len(gs), k) for k, gs in shared.value.items()]) if shared.value else np.zeros(0, int)
        for whole in parts:
            for a in range(0, len(whole), TRACES):
                part = whole.iloc[a : a + TRACES]
                missed = np.empty((len(part), len(grams)), np.int64)
                for row, seq in zip(missed, part["seq"], strict=True):
                    row[:] = _misses(seq, tables)
                yield make(part, missed, lengths, grams)

    return sequences.select("item_id", "y", "seq").mapInPandas(run, schema)


def distances(sequences: DataFrame, pool: DataFrame) -> DataFrame:
    """(item_id, y, k, gram, dist): least share of mismatches over all windows; 1 for shorter traces."""

    def make(part: pd.DataFrame, missed: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> pd.DataFrame:
        n, m = missed.shape
        return pd.DataFrame({"item_id": np.repeat(part["item_id"].to_numpy(), m), "y": np.repeat(part["y"].to_numpy(), m), "k": np.tile(lengths, n), "gram": np.tile(grams, n), "dist": (missed / lengths).ravel()})

    return _measured(sequences, pool, make, "item_id long, y long, k int, gram string, dist double")


def distance_counts(sequences: DataFrame, pool: DataFrame) -> DataFrame:
    """(k, gram, dist, c, s): how many traces are at each distance of a candidate, and how many of these are of class 1; counted in tasks first."""

    def make(part: pd.DataFrame, missed: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> pd.DataFrame:
        wide = int(lengths.max(initial=0)) + 1
        cell = (missed + np.arange(len(grams)) * wide).ravel()
        c = np.bincount(cell, minlength=wide * len(grams))
        s = np.bincount(cell, np.repeat(part["y"].to_numpy(), len(grams)), minlength=wide * len(grams)).astype(np.int64)
        some = np.flatnonzero(c)
        gram = some // wide
        return pd.DataFrame({"k": lengths[gram], "gram": grams[gram], "dist": (some % wide) / lengths[gram], "c": c[some], "s": s[some]})

    return _measured(sequences, pool, make, "k int, gram string, dist double, c long, s long").groupBy("k", "gram", "dist").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def binary_entropy(p):
    """Entropy in bits of a coin; 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def information_gain(at: DataFrame) -> DataFrame:
    """(k, gram, gain): best gain of a split between distinct distances of a candidate, not below 0; from ``distance_counts``."""
    w = Window.partitionBy("k", "gram")
    run = w.orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"n": F.sum("c").over(w), "m": F.sum("s").over(w), "nl": F.sum("c").over(run), "ml": F.sum("s").over(run)})
    nr = F.col("n") - F.col("nl")
    after = F.col("nl") / F.col("n") * binary_entropy(F.col("ml") / F.col("nl")) + nr / F.col("n") * binary_entropy((F.col("m") - F.col("ml")) / F.greatest(nr, F.lit(1)))
    gain = F.when(nr > 0, binary_entropy(F.col("m") / F.col("n")) - after)
    return at.withColumn("g", gain).groupBy("k", "gram").agg(F.greatest(F.coalesce(F.max("g"), F.lit(0.0)), F.lit(0.0)).alias("gain"))


def ranked(gains: DataFrame, top: int = 40) -> DataFrame:
    """The candidates of highest gain; ties by length and gram."""
    # the pool bounds what stands in this window
    return gains.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("gain", 9)), "k", "gram")).cast("long")).where(F.col("rank") <= top)


def aligned(sequences: DataFrame, pool: DataFrame) -> DataFrame:
    """(item_id, y, k, gram, dist): each trace's distances on the union of all classes' candidates (y, k, gram).

    A trace is measured against its own class's candidates; from others, and without a class, it is at distance 1. A task
    fills whole rows of the union, so that distances are never joined. The candidates are bounded by POOL of a length and class.
    """
    found = pool.select("y", "k", "gram").collect()
    names = sorted({(r["k"], r["gram"]) for r in found})
    at = {name: i for i, name in enumerate(names)}
    own = {y: sorted(at[r["k"], r["gram"]] for r in found if r["y"] == y) for y in {r["y"] for r in found} - {None}}
    shared = sequences.sparkSession.sparkContext.broadcast((names, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = shared.value
        lengths, grams = np.array([k for k, _ in names], np.int32), pa.array([g for _, g in names], pa.string())
        tables = {y: _tables({k: [names[i][1] for i in at if names[i][0] == k] for k in sorted({names[i][0] for i in at})}) for y, at in own.items()}
        step = max(1, CELLS // max(1, len(names)))
        for batch in batches:
            for a in range(0, batch.num_rows if names else 0, step):
                part = batch.slice(a, step)
                dist = np.ones((part.num_rows, len(names)))
                for row, y, seq in zip(dist, part.column("y").to_pylist(), part.column("seq").to_pylist(), strict=True):
                    if y in own:
                        row[own[y]] = _misses(seq, tables[y]) / lengths[own[y]]
                each = pa.array(np.repeat(np.arange(part.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(each), part.column("y").take(each), pa.array(np.tile(lengths, part.num_rows)), pa.concat_arrays([grams] * part.num_rows), pa.array(dist.ravel())],
                    names=["item_id", "y", "k", "gram", "dist"],
                )

    # a short row makes many distances: the tasks are dealt by what they make
    parts = max(sequences.sparkSession.sparkContext.defaultParallelism, -(-sequences.count() * len(names) // TASK_CELLS))
    return sequences.select("item_id", "y", "seq").repartition(parts).mapInArrow(run, "item_id long, y long, k int, gram string, dist double")
