"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to their nearest of a bounded number of centres, and to every
other one whose cell may hold a vector within range, by their distance to the plane between
the two: all partners of a vector are in its first shard. A shard cuts itself into
overlapping leaves, links every vector of a leaf to its nearest ones pruned robustly, and takes the union of the leaves' adjacency lists; a
greedy search from the leaves' medoids leads to a vector's surroundings, and from there the
search widens over all neighbours within range, each verified in double precision. Each
shard audits the search against a comparison with all its vectors, on vectors that have
links or nearly do and on any others, and is compared in blocks where it falls short, or
where a dense group makes links a large share of all pairs. Of a shard too large for a task
every block is searched so, and blocks are compared with each other in tasks of their own.
Tasks give back one count per vector, the audited recall and a spanning forest of the
links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.components import connected, forest
from tracelore.llm.textkit import lean, shuffle_width, stored

LINK = 0.98
#: Vectors per centre aimed at; most centres in all (bounds the broadcast); vectors of a shard that one task takes.
PER_CENTRE, MOST_CENTRES, WHOLE = 2000, 8192, 16_384
#: Vectors of a leaf; neighbours tried and kept; slack of the pruning; beam and most steps of the greedy search.
LEAF, TRIED, KEPT, SLACK, BEAM, STEPS = 1024, 48, 20, 1.2, 16, 40
#: Pairs of one block of a comparison; vectors of each kind that a shard is audited on; share of the linked ones that must have all their links.
BLOCK, AUDITED, RECALL = 1 << 22, 200, 0.97
#: Pairs of a query and a vector that the range search marks at once; neighbours that it looks up at once; share
#: of all pairs of a shard above which links are compared and not followed.
MARKED, FOLLOWED, DENSE = 1 << 24, 1 << 20, 1 / 32


def leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Overlapping groups of at most about 2 * LEAF rows that cover all rows."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= 2 * LEAF:
            out.append(rows)
            continue
        picks = rng.choice(len(rows), min(64, -(-len(rows) // LEAF) + 1), replace=False)
        near = np.argpartition(-(x[rows] @ x[rows[picks]].T), 1, axis=1)[:, :2]
        parts = [rows[(near == k).any(1)] for k in range(len(picks))]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.8 * len(rows):
            # a dense group that centres don't part: even pieces, tied together by shared rows
            order, bridge = rng.permutation(rows), rows[rng.choice(len(rows), 32, replace=False)]
            parts = [np.unique(np.concatenate([order[a : a + LEAF], bridge, order[a + LEAF : a + LEAF + 64]])) for a in range(0, len(order), LEAF)]
        todo += parts
    return out


def pruned(x: np.ndarray) -> np.ndarray:
    """For each row its KEPT neighbours, -1 where fewer: of the TRIED nearest, those not much nearer to one already kept."""
    n = len(x)
    tried = min(TRIED, n - 1)
    out = np.full((n, KEPT), -1, np.int64)
    if tried < 1:
        return out
    for a in range(0, n, 512):
        dots = x[a : a + 512] @ x.T
        here = np.arange(len(dots))
        dots[here, a + here] = -2
        near = np.argpartition(-dots, tried - 1, axis=1)[:, :tried]
        order = np.argsort(-np.take_along_axis(dots, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(dots, near, 1), 0))
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("nid,njd->nij", x[near], x[near]), 0))
        open_, count = np.ones(near.shape, bool), np.zeros(len(near), np.int64)
        for k in range(tried):
            take = open_[:, k] & (count < KEPT)
            rows = np.flatnonzero(take)
            out[a + rows, count[rows]] = near[rows, k]
            count[rows] += 1
            open_[rows] &= SLACK * among[rows, k] > dist[rows]
    return out


def graph(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbour lists joined, start of each list, medoids) of the union of the leaves' graphs."""
    rng = np.random.default_rng(seed)
    source, target, medoids = [], [], []
    for rows in leaves(x, rng):
        part = x[rows]
        adj = pruned(part)
        s, k = np.nonzero(adj >= 0)
        source.append(rows[s])
        target.append(rows[adj[s, k]])
        centre = part.mean(0)
        medoids.append(rows[int(np.argmax(part @ centre))])
        # a few entries spread over the leaf, so that the medoid's surroundings are not the only way in
        medoids += rows[rng.choice(len(rows), min(len(rows), 24), replace=False)].tolist()
    s, t = np.concatenate(source), np.concatenate(target)
    pairs = np.unique(np.concatenate([s * len(x) + t, t * len(x) + s]))
    s, t = pairs // len(x), pairs % len(x)
    return t, np.searchsorted(s, np.arange(len(x) + 1)), np.unique(np.array(medoids))


def _neighbours(of: np.ndarray, lists: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, neighbour) of all neighbours of the given rows."""
    size = start[of + 1] - start[of]
    where = np.repeat(np.arange(len(of)), size)
    return where, lists[np.repeat(start[of], size) + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)]


def approach(x: np.ndarray, queries: np.ndarray, lists: np.ndarray, start: np.ndarray, medoids: np.ndarray) -> np.ndarray:
    """Greedy search: for each query row the BEAM nearest rows that it came to, -1 where fewer."""
    q = x[queries]
    first = min(BEAM, len(medoids))
    dots = q @ x[medoids].T
    near = np.argpartition(-dots, first - 1, axis=1)[:, :first] if first < len(medoids) else np.tile(np.arange(first), (len(q), 1))
    beam = np.full((len(q), BEAM), -1, np.int64)
    score = np.full((len(q), BEAM), -3.0, x.dtype)
    beam[:, :first], score[:, :first] = medoids[near], np.take_along_axis(dots, near, 1)
    done = beam < 0
    for _ in range(STEPS):
        best = np.argmax(np.where(done, -4, score), axis=1)
        rows = np.flatnonzero(~done[np.arange(len(q)), best])
        if not len(rows):
            break
        done[rows, best[rows]] = True
        where, new = _neighbours(beam[rows, best[rows]], lists, start)
        width = int(np.bincount(where, minlength=len(rows)).max())
        block = np.full((len(rows), width), -1, np.int64)
        place = np.arange(len(where)) - np.searchsorted(where, where)
        block[where, place] = new
        value = np.full(block.shape, -3.0, x.dtype)
        value[where, place] = np.einsum("nd,nd->n", q[rows[where]], x[new])
        value[(block[:, :, None] == beam[rows][:, None, :]).any(2)] = -3
        both, scores = np.hstack([beam[rows], block]), np.hstack([score[rows], value])
        flags = np.hstack([done[rows], np.zeros(block.shape, bool)])
        top = np.argpartition(-scores, BEAM - 1, axis=1)[:, :BEAM]
        beam[rows], score[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (both, scores, flags))
        done |= (beam < 0) | (score < -2.5)
    beam[score < -2.5] = -1
    return beam


def in_range(x: np.ndarray, queries: np.ndarray, lists: np.ndarray, start: np.ndarray, medoids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight linked to each query without itself, and one pair of rows per link found that joins new rows)."""
    coarse = x.astype(np.float32)
    total = np.zeros(len(queries), np.int64)
    edges: list[np.ndarray] = []
    step = max(1, min(512, MARKED // len(x)))
    hits_at_once = max(1, FOLLOWED // max(1, len(lists) // len(x)))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        beam = approach(coarse, part, lists, start, medoids)
        # the query's own row is a way in as well
        q = np.concatenate([np.repeat(np.arange(len(part)), BEAM)[beam.ravel() >= 0], np.arange(len(part))])
        r = np.concatenate([beam.ravel()[beam.ravel() >= 0], part])
        seen = np.zeros(len(part) * len(x), bool)
        new = np.unique(q * len(x) + r)
        seen[new] = True
        while len(new):
            q, r = new // len(x), new % len(x)
            hit = np.concatenate([np.einsum("nd,nd->n", x[part[q[b : b + 100_000]]], x[r[b : b + 100_000]]) for b in range(0, len(q), 100_000)]) >= LINK
            q, r = q[hit], r[hit]
            other = r != part[q]
            total[a : a + step] += np.bincount(q[other], weight[r[other]], len(part)).astype(np.int64)
            if other.any():
                edges.append(np.stack(forest(part[q[other]], r[other])))
            fresh = [np.zeros(0, np.int64)]
            for b in range(0, len(q), hits_at_once):
                where, near = _neighbours(r[b : b + hits_at_once], lists, start)
                near += q[b : b + hits_at_once][where] * len(x)
                near = np.unique(near[~seen[near]])
                seen[near] = True
                fresh.append(near)
            new = np.concatenate(fresh)
    u, v = forest(*np.concatenate(edges, 1)) if edges else (np.zeros(0, np.int64),) * 2
    return total, u, v


def compared(x: np.ndarray, queries: np.ndarray, weight: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What ``in_range`` gives, and the number of links, by a comparison of the queries with all rows, or with those given."""
    total = np.zeros(len(queries), np.int64)
    edges: list[np.ndarray] = []
    rows = np.arange(len(x)) if rows is None else rows
    y, pairs = x[rows].T, 0
    step = max(1, BLOCK // max(len(rows), 1))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        q, r = np.nonzero(x[part] @ y >= LINK)
        r = rows[r]
        other = r != part[q]
        q, r = q[other], r[other]
        total[a : a + step] = np.bincount(q, weight[r], len(part)).astype(np.int64)
        pairs += len(q)
        if len(q):
            edges.append(np.stack(forest(part[q], r)))
    u, v = forest(*np.concatenate(edges, 1)) if edges else (np.zeros(0, np.int64),) * 2
    return total, u, v, pairs


def audit_rows(x: np.ndarray, queries: np.ndarray, lists: np.ndarray, start: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of the queries that an audit looks at, AUDITED of each kind: any, those with a neighbour in range, and those that come nearest to having one."""
    where, near = _neighbours(queries, lists, start)
    best = np.full(len(queries), -2, x.dtype)
    for a in range(0, len(where), 100_000):
        np.maximum.at(best, where[a : a + 100_000], np.einsum("nd,nd->n", x[queries[where[a : a + 100_000]]], x[near[a : a + 100_000]]))
    tied, rest = rng.permutation(np.flatnonzero(best >= LINK)), np.flatnonzero(best < LINK)
    rest = rest[np.argsort(-best[rest], kind="stable")]
    return np.unique(np.concatenate([rng.permutation(len(queries))[:AUDITED], tied[:AUDITED], rest[:AUDITED]]))


def linked(x: np.ndarray, queries: np.ndarray, weight: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float | None]:
    """What ``in_range`` gives by the graph, and the audited recall: the share of audited queries with links that got all of them, each counted once whatever the weight of its links.

    The recall is None where no audited query has a link. An exact comparison in blocks
    stands in, with recall 1, where the recall is under RECALL; where a sample shows so
    dense a group that links make more than DENSE of all pairs; and for at most KEPT
    vectors, which would all be each other's neighbours.
    """
    if len(x) <= KEPT or not len(queries):
        return *compared(x, queries, weight)[:3], 1.0
    rng = np.random.default_rng(seed)
    some = rng.permutation(len(queries))[:AUDITED]
    if compared(x, queries[some], weight)[3] > DENSE * len(some) * len(x):
        return *compared(x, queries, weight)[:3], 1.0
    coarse = x.astype(np.float32)
    lists, start, medoids = graph(coarse)
    total, u, v = in_range(x, queries, lists, start, medoids, weight)
    tried = audit_rows(coarse, queries, lists, start, rng)
    true, s, t, _ = compared(x, queries[tried], weight)
    has = true > 0
    recall = float((total[tried] == true)[has].mean()) if has.any() else None
    if recall is not None and recall < RECALL:
        return *compared(x, queries, weight)[:3], 1.0
    total[tried] = true
    return total, *forest(np.concatenate([u, s]), np.concatenate([v, t])), recall


def across(x: np.ndarray, queries: np.ndarray, weight: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``in_range`` gives for links between two blocks of a shard: each query against the rows of the other block."""
    total, u, v = np.zeros(len(queries), np.int64), [], []
    for own in np.unique(block):
        mine = block[queries] == own
        total[mine], s, t, _ = compared(x, queries[mine], weight, np.flatnonzero(block != own))
        u.append(s)
        v.append(t)
    return total, *forest(np.concatenate(u), np.concatenate(v))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers that can link, their unit vectors, their lengths): no nulls, all finite, not zero. Vectors may differ in length."""
    ok, vectors, sizes = [], [], []
    for k, v in enumerate(column.to_pylist()):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        a = np.array(v, np.float64)
        top = np.abs(a).max()
        if not np.isfinite(top) or top == 0 or np.isnan(a).any():
            continue
        a = a / top
        ok.append(k)
        vectors.append(a / np.sqrt(a @ a))
        sizes.append(len(a))
    return np.array(ok, np.int64), vectors, np.array(sizes, np.int64)


def prepared(vectors: DataFrame) -> DataFrame:
    """(key, vec_id, label, unit): a number for every row; unit is null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ok, units, _ = unit_rows(batch.column(2))
            out: list = [None] * len(batch)
            for k, u in zip(ok.tolist(), units, strict=True):
                out[k] = u
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(batch))), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(out, pa.list_(pa.float64()))], ["key", "vec_id", "label", "unit"])
            key += len(batch)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(lean(run), "key long, vec_id long, label string, unit array<double>")


def _centres(classes: DataFrame, sizes: dict[tuple, int]) -> dict[tuple, tuple[int, np.ndarray]]:
    """By (label, dimension): the number of its first shard and its centres; MOST_CENTRES in all, as one sample."""
    total = max(1, sum(sizes.values()))
    share = max(PER_CENTRE, -(-total // MOST_CENTRES))
    wanted = min(MOST_CENTRES, max(64, 4 * total // share))
    # a share of the hash's range with about twice as many: no task sorts more
    few = classes.where(F.xxhash64("key") <= min((1 << 63) - 1, int(2 * wanted / total * (1 << 64)) - (1 << 63)))
    rows = few.orderBy(F.xxhash64("key"), "key").limit(wanted).select("label", "unit").collect()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["label"], len(r["unit"])), []).append(r["unit"])
    out, first = {}, 0
    for k in sorted(by):
        n = max(1, round(sizes[k] / share))
        picks = np.array(by[k][: max(n, 1)])
        out[k] = (first, picks)
        first += len(picks)
    # labels that the sample missed are few rows each: they share shards by a hash
    return out


def reached(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, whether it is the nearest) for the centres that may be nearest to a vector in range of the row: none is beyond the plane between the row's nearest centre and them by more than the range."""
    found = []
    step = max(1, BLOCK // 4 // len(centres))
    for a in range(0, len(x), step):
        dots = x[a : a + step] @ centres.T
        near = np.argmax(dots, axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * (centres[near] @ centres.T), 0))
        gap = dots[np.arange(len(dots)), near][:, None] - dots
        row, centre = np.nonzero(gap <= np.sqrt(2 - 2 * LINK) * apart + 1e-7)
        found.append((row + a, centre, centre == near[row]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


DEALT = "shard int, key long, label string, unit array<double>, weight long, home boolean"


def search(classes: DataFrame) -> DataFrame:
    """(key, n, root, recall): links of each class, in parts to be added up, and rows (key, null, root) that tie linked classes; recall is that audited in the shard.

    A shard of over WHOLE vectors is cut into blocks by a hash, and every two of its blocks
    are compared in a task of their own.
    """
    spark = classes.sparkSession
    grouped = classes.groupBy("label", F.size("unit").alias("d")).agg(F.count("*").alias("n"))
    # a bounded number of the largest labels get centres; the driver never sees more
    sizes = {(r["label"], r["d"]): r["n"] for r in grouped.orderBy(F.col("n").desc(), "label", "d").limit(MOST_CENTRES).collect()}
    centres = _centres(classes.join(F.broadcast(spark.createDataFrame([(*k,) for k in sizes] or [("", 0)], "label string, d int")), ["label"]).where(F.size("unit") == F.col("d")), sizes) if sizes else {}
    shared = spark.sparkContext.broadcast(centres)
    width = shuffle_width(spark)

    def places(batch: pa.RecordBatch) -> tuple[list, list, list]:
        """(row, shard, whether it is the first) for all shards that rows (key, label, unit, ..) go to."""
        known = shared.value
        rows, shard, home = [], [], []
        labels, values = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        groups: dict[tuple, list[int]] = {}
        for k, (label, u) in enumerate(zip(labels, values, strict=True)):
            groups.setdefault((label, len(u)), []).append(k)
        for name, at in groups.items():
            if name not in known:
                rows += at
                shard += [-1] * len(at)
                home += [True] * len(at)
                continue
            first, c = known[name]
            row, centre, nearest = reached(np.array([values[k] for k in at]), c)
            rows += np.array(at)[row].tolist()
            shard += (first + centre).tolist()
            home += nearest.tolist()
        return rows, shard, home

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shard, home = places(batch)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(batch.column(i).take(take) for i in range(4)), pa.array(home, pa.bool_())], [f.split()[0] for f in DEALT.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shard, _ = places(batch)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(1).take(take), pc.list_value_length(batch.column(2)).take(take)], ["shard", "label", "d"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            x = np.array(rows["unit"].to_pylist())
            keys, weight, home, block = rows["key"].to_numpy(), rows["weight"].to_numpy(), rows["home"].to_numpy(zero_copy_only=False), rows["block"].to_numpy()
            queries = np.flatnonzero(home)
            total, u, v, recall = (*across(x, queries, weight, block), 1.0) if rows["i"][0] != rows["j"][0] else linked(x, queries, weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys[queries], keys[u]])), pa.array(np.concatenate([total, np.zeros(len(u), np.int64)]), mask=np.append(np.zeros(len(queries), bool), np.ones(len(u), bool))), pa.array(np.concatenate([keys[queries], keys[v]])), pa.array([recall] * (len(queries) + len(u)), pa.float64())],
                ["key", "n", "root", "recall"],
            )

    members = classes.select("key", "label", "unit", "weight")
    dealt = members.mapInArrow(lean(deal), DEALT).withColumn("d", F.size("unit"))
    zero = F.lit(0).cast("int")
    if max(sizes.values(), default=0) > WHOLE:
        large = members.mapInArrow(lean(count), "shard int, label string, d int").groupBy("shard", "label", "d").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE)
        # one row for every WHOLE rows that are dealt, at most
        large = F.broadcast(large.select("shard", "label", "d", F.ceil(F.col("n") * 2 / WHOLE).cast("int").alias("blocks")))
        dealt = dealt.join(large, ["shard", "label", "d"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), zero))
        with_all = F.transform(F.sequence(zero, F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
        dealt = dealt.withColumn("at", F.explode(with_all)).select("shard", "key", "label", "unit", "weight", "home", "block", "at.i", "at.j")
    else:
        dealt = dealt.select("shard", "key", "label", "unit", "weight", "home", zero.alias("block"), zero.alias("i"), zero.alias("j"))
    by = ["shard", "label", "i", "j"]
    return dealt.repartition(width, *by).sortWithinPartitions("shard", "label", F.size("unit"), "i", "j").mapInArrow(lean(find), "key long, n long, root long, recall double")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of one shard, label, dimension and two blocks."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not len(batch):
            continue
        label, shard = batch.column(2).to_pylist(), batch.column(0).to_pylist()
        d = pc.list_value_length(batch.column(3)).to_pylist()
        ids = list(zip(shard, label, d, batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True))
        cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ids[a] != name and held:
                yield name, pa.Table.from_batches(held).combine_chunks()
                held = []
            name = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held).combine_chunks()


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall): one row per row of ``vectors`` (vec_id, label, embedding).

    recall is the least one audited where the vector was searched: 1 where it was compared
    with all others, null where no audited vector has a link or the vector can't link.

    Vectors are compared within a label and a dimension. Equal vectors are one class, so a
    hot vector costs one row. Rows with a null label or a vector that is null, empty, zero or
    not finite have no links. A null vec_id has a null component unless it has links, and
    is not kept. Rows that repeat a vec_id are vectors of their own. An empty table gives none.
    """
    rows = stored(prepared(vectors), "vectors")
    able = rows.where(F.col("label").isNotNull() & F.col("unit").isNotNull())
    named = able.withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(1), "unit"))
    classes = stored(named.groupBy("label", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("weight"), F.first("unit").alias("unit")), "vector-classes")
    found = stored(search(classes), "links")
    ties = connected(found.where("n IS NULL").select("key", "root"))
    classes = classes.join(found.where("n IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.min("recall").alias("recall")), "key", "left").join(ties.select(F.col("u").alias("key"), F.col("v").alias("top")), "key", "left")
    classes = classes.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("top", "key").alias("top"), "recall")
    member = named.select("key", "vec_id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"])
    least = member.groupBy("top").agg(F.min("vec_id").alias("component_id"))
    linked = member.join(least, "top").select("vec_id", "n_links", "component_id", "recall")
    alone = rows.where(F.col("label").isNull() | F.col("unit").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    return linked.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")
