"""Packing: length buckets that minimise padding, and token-budget batches inside each.

The histogram of lengths covers all documents. Lengths above EXACT are rounded up
to one of STEPS values in each octave, so the histogram has at most
EXACT + STEPS * (63 - log2(EXACT)) rows, about 240,000: the bound on what the driver
and the dynamic programme see. A document longer than the budget makes a batch alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.mixing import size_of
from tracelore.llm.textkit import stored

#: Production parameters: buckets, and padded tokens that a batch holds.
BUCKETS, BUDGET = 16, 65_536
EXACT, STEPS = 8192, 4096
#: Cells that the documents of one bucket are dealt over to be numbered.
CELLS = 4096


def rounded(length: Column) -> Column:
    """The length, or from EXACT on the next of STEPS values in its octave."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - int(math.log2(STEPS)), F.lit(0).cast("long")))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths with the least padding in all.

    Among equal optima the programme keeps the one whose last cut is lowest. Costs are
    exact integers in Python's range of int64: n * length must stay below 2**63.
    """
    n = len(lengths)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    words = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of one bucket over entries i .. j-1."""
        return lengths[j - 1] * (docs[j] - docs[i]) - (words[j] - words[i])

    best = np.array([0, *(int(cost(np.array([0]), j)[0]) for j in range(1, n + 1))], np.int64)
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n + 1, np.int64)
        # the best cut never moves down as j grows, so halves narrow each other
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            new[j], cut[j] = total[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    else:
        out.append(int(lengths[j - 1]))
    return sorted(set(out))


def plan_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bucket bounds for a frame with a column ``length``; the driver gets the rounded histogram only."""
    rows = lengths.groupBy(rounded(F.col("length")).alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()
    return boundaries(np.array([r["length"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), buckets)


def pack(docs: DataFrame, *, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot, padding): one row per row of ``docs`` (doc_id, text).

    A token is a word. Batch numbers start at 0 in each bucket and batches are full but for
    the last; every batch holds at most max(1, budget // bucket_len) documents. Null and empty
    texts have 0 tokens and are packed like others. Repeated rows each get their own slot.
    """
    # two numbers per document, counted once and read three times
    rows = stored(docs.select("doc_id", size_of(F.col("text")).alias("n_tokens")), "lengths")
    bounds = plan_buckets(rows.select(F.col("n_tokens").alias("length")), buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("padding"))
    rows = rows.withColumn("_l", rounded(F.col("n_tokens"))).withColumn("bucket", sum(((F.col("_l") > x).cast("int") for x in bounds[:-1]), F.lit(0))).drop("_l")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens")) - 1)
    cells = rows.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    # at most BUCKETS * CELLS rows
    placed = ranked.join(F.broadcast(before), ["bucket", "cell"])
    bound = F.element_at(F.array(*[F.lit(x).cast("long") for x in bounds]), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1).cast("long"))))
    at = F.col("before") + F.col("rank")
    placed = placed.withColumn("bucket_len", bound).withColumn("fits", fits)
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(at / F.col("fits")).alias("batch"), (at % F.col("fits")).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
