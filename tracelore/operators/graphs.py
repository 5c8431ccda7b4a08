"""Graphs of traces: edges as rows, and descriptors of each trace's graph.

Edges and the counts of them are joins and windows on the trace's key. Spectra, paths and
communities have no relational form; they run on one trace at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelore.operators.sequences import BEHAVIORS

#: Least distance of a recurrence; behaviors that revise, and what they refer to.
MIN_GAP, REVISING, REFERRED = 3, ("X", "R", "B", "S"), ("F", "V")
#: Fixed value: path lengths are cut off here.
MAX_PATH = 8


def edges(episodes: DataFrame, *, revisions: bool = False) -> DataFrame:
    """(item_id, src, dst, weight, edge_type): 0 to the next episode, 1 to a like one at least MIN_GAP later, 2 from a revision to what it revises."""
    key = Window.partitionBy("item_id").orderBy("position")
    e = episodes.select("item_id", "position", "behavior")
    chain = e.withColumn("dst", F.lead("position").over(key)).where("dst IS NOT NULL").select("item_id", F.col("position").alias("src"), "dst", F.lit(1.0).alias("weight"), F.lit(0).alias("edge_type"))
    later = e.select("item_id", "behavior", F.col("position").alias("dst"))
    again = e.join(later, ["item_id", "behavior"]).where(F.col("dst") - F.col("position") >= MIN_GAP).select("item_id", F.col("position").alias("src"), "dst", (1.0 / (F.col("dst") - F.col("position"))).alias("weight"), F.lit(1).alias("edge_type"))
    out = chain.unionByName(again)
    if revisions:
        # as-of join: the nearest earlier episode that can be referred to
        target = F.last(F.when(F.col("behavior").isin(*REFERRED), F.col("position")), ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))
        back = e.withColumn("dst", target).where(F.col("behavior").isin(*REVISING) & F.col("dst").isNotNull())
        out = out.unionByName(back.select("item_id", F.col("position").alias("src"), "dst", (1.0 / F.greatest(F.col("position") - F.col("dst"), F.lit(1))).alias("weight"), F.lit(2).alias("edge_type")))
    return out


def node_features(episodes: DataFrame, *, floor: bool = False) -> DataFrame:
    """Ten features of each node: behavior, place, standardised tokens, log confidence. ``floor`` adds 1e-6 to the deviation instead of giving 0 where it is tiny."""
    w = Window.partitionBy("item_id")
    s = episodes.withColumns({"n": F.count("*").over(w), "mu": F.avg("token_count").over(w), "sd": F.stddev_pop("token_count").over(w)})
    centred = F.col("token_count") - F.col("mu")
    z = centred / (F.col("sd") + 1e-6) if floor else F.when(F.col("sd") < 1e-6, 0.0).otherwise(centred / F.col("sd"))
    return s.select("item_id", "position", *[(F.col("behavior") == b).cast("double").alias(f"is_{b}") for b in BEHAVIORS], (F.col("position") / F.greatest(F.col("n") - 1, F.lit(1))).alias("place"), z.alias("z_tokens"), F.log1p("confidence").alias("log_confidence"))


def counts(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degrees of each graph; the constants of an acyclic graph with them."""
    n = nodes.groupBy("item_id").agg(F.count("*").alias("n_nodes"))
    e = edge_rows.groupBy("item_id").agg(F.count("*").alias("n_edges"))
    out = n.join(e, "item_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)).cast("long"))
    degree = F.col("n_edges") / F.col("n_nodes")
    return out.select("item_id", "n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("edge_density"), degree.alias("avg_in_degree"), degree.alias("avg_out_degree"), (1.0 / F.col("n_nodes")).alias("largest_scc_frac"), F.lit(0.0).alias("cycles_leq5"))


def clustering(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean local clustering of the undirected graph, by joining its edges within a trace; nodes of degree under two count as 0."""
    pair = edge_rows.select("item_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = pair.union(pair.select("item_id", "b", "a")).toDF("item_id", "u", "v")
    degree = both.groupBy("item_id", "u").agg(F.count("*").alias("d"))
    x, y = both.toDF("item_id", "u", "v"), both.toDF("item_id", "u", "w")
    closed = x.join(y, ["item_id", "u"]).where("v < w").join(pair.toDF("item_id", "v", "w"), ["item_id", "v", "w"]).groupBy("item_id", "u").agg(F.count("*").alias("t"))
    local = degree.join(closed, ["item_id", "u"], "left").withColumn("c", F.when(F.col("d") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))))
    total = local.groupBy("item_id").agg(F.sum("c").alias("s"))
    n = nodes.groupBy("item_id").agg(F.count("*").alias("n"))
    return n.join(total, "item_id", "left").select("item_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("avg_clustering"))


def adjacency(behaviors: np.ndarray) -> np.ndarray:
    """Symmetric weights of a trace's chain and recurrences."""
    n = len(behaviors)
    gap = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    a = np.where((behaviors[:, None] == behaviors[None, :]) & (gap >= MIN_GAP), 1.0 / np.maximum(gap, 1), 0.0)
    a[gap == 1] = 1.0
    return a


def path_lengths(linked: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Steps from each source to every node, -1 where there is no way; all sources advance together."""
    out = np.full((len(sources), len(linked)), -1, np.int64)
    front = np.zeros(out.shape, bool)
    front[np.arange(len(sources)), sources] = True
    step = 0
    while front.any():
        out[front] = step
        front = ((front.astype(np.float32) @ linked) > 0) & (out < 0)
        step += 1
    return out


def betweenness(linked: np.ndarray) -> np.ndarray:
    """Share of shortest paths through each node, per source level by level."""
    n = len(linked)
    total = np.zeros(n)
    for s in range(n):
        depth, paths = np.full(n, -1), np.zeros(n)
        depth[s], paths[s], level = 0, 1, [np.array([s])]
        while len(level[-1]):
            reach = paths[level[-1]] @ linked[level[-1]]
            new = np.flatnonzero((reach > 0) & (depth < 0))
            depth[new], paths[new] = len(level), reach[new]
            level.append(new)
        passed = np.zeros(n)
        for near, far in zip(level[-3::-1], level[-2:0:-1], strict=False):
            if len(far):
                passed[near] += paths[near] * (linked[np.ix_(near, far)] @ ((1 + passed[far]) / paths[far]))
        passed[s] = 0
        total += passed
    return total / ((n - 1) * (n - 2)) if n > 2 else total


def centralization(values: np.ndarray) -> float:
    return float((values.max() - values).sum() / (len(values) - 1)) if len(values) > 1 else 0.0


def local_clustering(linked: np.ndarray) -> float:
    degree = linked.sum(1)
    closed = np.einsum("ij,jk,ki->i", linked, linked, linked, optimize=True)
    return float(np.where(degree > 1, closed / np.maximum(degree * (degree - 1), 1), 0).mean()) if len(linked) else 0.0


def modularity(a: np.ndarray) -> float:
    """Modularity of communities merged greedily, the best pair first."""
    total = a.sum()
    if total <= 0:
        return 0.0
    e = a / total
    share = e.sum(1)
    alive = np.ones(len(a), bool)
    score = float(np.trace(e) - (share**2).sum())
    while alive.sum() > 1:
        gain = 2 * (e - np.outer(share, share))
        gain[~alive] = gain[:, ~alive] = -np.inf
        gain[np.tril_indices(len(a))] = -np.inf
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[i, j] <= 1e-15:
            break
        score += float(gain[i, j])
        e[i] += e[j]
        e[:, i] += e[:, j]
        share[i] += share[j]
        alive[j] = False
    return score


def small_world(linked: np.ndarray, seed: int = 42) -> float:
    """(C / C of rewired) / (L / L of rewired) on the largest component; 1 where undefined."""
    n = len(linked)
    if n < 4 or linked.sum() < 4:
        return 1.0
    reach = path_lengths(linked, np.arange(n)) >= 0
    part = np.flatnonzero(reach[int(np.argmax(reach.sum(1)))])
    h = linked[np.ix_(part, part)]
    if len(part) < 4:
        return 1.0

    def measure(g: np.ndarray) -> tuple[float, float]:
        d = path_lengths(g, np.arange(len(g)))
        return local_clustering(g), float(d[d > 0].mean()) if (d > 0).any() else 0.0

    c, length = measure(h)
    rng, g = np.random.default_rng(seed), h.copy()
    pairs = np.argwhere(np.triu(g) > 0)
    for _ in range(len(pairs) * 5):
        x, y = rng.integers(0, len(pairs), 2)
        (a, b), (p, q) = pairs[x], pairs[y]
        if len({a, b, p, q}) == 4 and not g[a, q] and not g[p, b]:
            g[a, b] = g[b, a] = g[p, q] = g[q, p] = 0
            g[a, q] = g[q, a] = g[p, b] = g[b, p] = 1
            pairs[x], pairs[y] = (a, q), (p, b)
    cr, lr = measure(g)
    return (c / cr) / (length / lr) if cr > 0 and lr > 0 and length > 0 else 1.0


DESCRIPTORS = ("avg_clustering", "approx_diameter", "betweenness_centralization", "eigenvector_centralization", "modularity", "spectral_radius", "von_neumann_entropy", "small_world_sigma")


def describe(behaviors: np.ndarray, *, most_betweenness: int | None = None, most_small_world: int | None = None, diameter_sources: int | None = None) -> dict[str, float]:
    """Descriptors of one trace's graph that have no relational form.

    All are exact unless a limit is given: graphs of more nodes than ``most_betweenness`` or
    ``most_small_world`` then get the neutral value of that descriptor, and the diameter is
    sought from ``diameter_sources`` nodes.
    """
    n = len(behaviors)
    if n < 2:
        return dict.fromkeys(DESCRIPTORS, 0.0) | {"small_world_sigma": 1.0}
    a = adjacency(behaviors)
    linked = (a > 0).astype(np.float32)
    sources = np.arange(n) if diameter_sources is None or n <= diameter_sources else np.random.default_rng(42).choice(n, diameter_sources, replace=False)
    value, vector = np.linalg.eigh(linked.astype(np.float64))
    lead = np.abs(vector[:, -1])
    degree = a.sum(1)
    scale = 1 / np.sqrt(np.where(degree > 0, degree, 1))
    spectrum = np.clip(np.linalg.eigvalsh(np.diag((degree > 0).astype(float)) - scale[:, None] * a * scale), 0, None)
    p = spectrum / spectrum.sum() if spectrum.sum() > 1e-12 else np.zeros(0)
    p = p[p > 1e-12]
    return {
        "avg_clustering": local_clustering(linked.astype(np.float64)), "approx_diameter": float(path_lengths(linked, sources).max()), "betweenness_centralization": centralization(betweenness(linked.astype(np.float64))) if most_betweenness is None or n <= most_betweenness else 0.0,
        "eigenvector_centralization": centralization(lead), "modularity": modularity(a.copy()), "spectral_radius": float(np.abs(np.linalg.eigvalsh(a)).max()), "von_neumann_entropy": float(-(p * np.log(p)).sum() / np.log(n)) if len(p) else 0.0, "small_world_sigma": small_world(linked.astype(np.float64)) if most_small_world is None or n <= most_small_world else 1.0,
    }


def descriptors(episodes: DataFrame, **limits: int) -> DataFrame:
    """One row of DESCRIPTORS per trace; ``limits`` as of ``describe``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        return pd.DataFrame([{"item_id": part["item_id"].iloc[0], **describe(part["behavior"].to_numpy(), **limits)}])

    return episodes.select("item_id", "position", "behavior").groupBy("item_id").applyInPandas(run, "item_id long, " + ", ".join(f"{d} double" for d in DESCRIPTORS))


def path_types(behaviors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, edge type) of each two episodes: path lengths over the undirected graph of all three kinds of edges, and the greatest kind on the path.

    Of paths of one length the one that the middle nodes, tried in order, gave first counts,
    and of edges between the same two nodes the kind that comes first.
    """
    n = len(behaviors)
    gap = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    kind = np.zeros((n, n), np.int64)
    steps = np.where(gap == 1, 1, n + MAX_PATH)
    again = (behaviors[:, None] == behaviors[None, :]) & (gap >= MIN_GAP)
    steps[again], kind[again] = 1, 1
    target = -1
    for k in range(n):
        if behaviors[k] in REVISING and target >= 0 and steps[k, target] > 1:
            steps[k, target] = steps[target, k] = 1
            kind[k, target] = kind[target, k] = 2
        if behaviors[k] in REFERRED:
            target = k
    np.fill_diagonal(steps, 0)
    for k in range(n):
        through = steps[:, k, None] + steps[None, k, :]
        nearer = through < steps
        steps = np.where(nearer, through, steps)
        kind = np.where(nearer, np.maximum(kind[:, k, None], kind[None, k, :]), kind)
    return np.minimum(steps, MAX_PATH), kind


def shortest_paths(episodes: DataFrame) -> DataFrame:
    """(item_id, src, dst, steps, edge_type) for src < dst: ``path_types`` of each trace, lengths at most MAX_PATH; pairs without a way get that too."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        steps, kind = path_types(part["behavior"].to_numpy())
        i, j = np.triu_indices(len(part), 1)
        return pd.DataFrame({"item_id": part["item_id"].iloc[0], "src": i, "dst": j, "steps": steps[i, j], "edge_type": kind[i, j]})

    return episodes.select("item_id", "position", "behavior").groupBy("item_id").applyInPandas(run, "item_id long, src long, dst long, steps long, edge_type long")
