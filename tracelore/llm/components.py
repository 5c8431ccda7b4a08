"""Connected components of a graph given as rows, by alternating large and small stars.

No task needs more than its share of the edges: the minimum of a hub is broadcast, and
its rows stay where they are. Each round is written to the shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.textkit import drop_stored, lean, stored

#: Edges that a task contracts at once before they are shuffled.
CONTRACTED = 1_000_000
#: Edges that make a node a hub, and most hubs: the bound of a broadcast of two numbers each.
HUB, MOST_HUBS = 1000, 10_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the given edges that are not the least."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)].ravel(), flat[len(a) :].ravel()
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    out = root != np.arange(len(nodes))
    return nodes[out], nodes[root[out]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += len(batch)
        if n > CONTRACTED:
            u, v = forest(*np.concatenate(held, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held, n = [], 0
    if n:
        u, v = forest(*np.concatenate(held, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` (u, v) with m of their u. Hubs, of which there are 2 * n_edges / limit at most, are broadcast, so that their rows stay where they are."""
    limit = max(HUB, 2 * n_edges // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") >= limit).select("u", "m"))
    others = least.where(F.col("n") < limit).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def _large(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return _with_least(both.where("v > u"), least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame, n_edges: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the least of its component, with the least. ``edges`` has two long columns.

    Null ends, loops and repeated edges are ignored. Nodes without an edge do not come out.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = stored(pairs.mapInArrow(lean(_contract), "u long, v long").distinct(), "edges")
    mark = _print(now)
    while mark[0]:
        half = stored(_large(now, mark[0]), "edges")
        new = stored(_small(half, mark[0]), "edges")
        drop_stored(half)
        drop_stored(now)
        now, last, mark = new, mark, _print(new)
        if mark == last:
            break
    return now
