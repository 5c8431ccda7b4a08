"""Join of documents whose sets of word n-grams overlap: a count-vector R-tree behind exact signatures.

1. Candidates. Two sets that link differ in at most r elements, r known from the size of
   the smaller. Hash the elements into more than r groups: one group at least holds the same
   elements in both. So documents of a class of sizes share a signature (the content of
   a group) if they link; every document writes its groups' signatures for its own class
   of sizes and the next lower one. Equal sets write them once per task.
2. Pruning. A document is also a point, its counts of elements in GROUPS hash groups. Where
   a signature is shared, an R-tree over the points of its documents compares boxes, then
   points, by the sum of the coordinates' minima, which bounds the overlap. Documents that
   pairs which survive connect form a cluster; others that happen to share a signature,
   such as a very common passage, do not.
3. Verification. Within a cluster the same tree leads to pairs that are verified on the sets
   themselves. Pairs that are already connected are skipped: components are asked for.
4. Clusters over BLOCK documents are cut into blocks that share pivots; what stays apart
   from the cluster's largest component is then compared with all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.components import connected, forest
from tracelore.llm.textkit import LOWER, chunks, ids_of, join_sizes, lean, left_by_key, likely_in, mix, segment_sums, shuffle_width, stored, word_bounds, word_hashes

#: Default: words of a shingle, and the least similarity as a fraction.
WORDS, NUM, DEN = 5, 80, 100
#: Hash groups of the count vectors; points of a leaf; children of a node.
GROUPS, LEAF, FAN = 64, 16, 16
#: Documents that one task compares at once; pivots that blocks of a larger cluster share.
BLOCK, PIVOTS = 2000, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
ROWS = "kind byte, key long, doc long, aux long, n long, point binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each document, size of each set). Texts of fewer words are one shingle; those of none are empty."""
    data = LOWER[data]
    starts, ends, per_doc = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(per_doc), np.int64)
    h = word_hashes(data, starts, ends)
    first = np.cumsum(per_doc) - per_doc
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    place = np.arange(len(h)) - first[doc_of]
    full = place <= per_doc[doc_of] - words
    at = np.flatnonzero(full)
    s = h[at]
    for j in range(1, words):
        s = mix(s * _ODD + h[at + j])
    doc = doc_of[at]
    for size in range(1, words):
        short = np.flatnonzero(per_doc == size)
        if len(short):
            v = mix(h[first[short]] + np.uint64(size))
            for j in range(1, size):
                v = mix(v * _ODD + h[first[short] + j])
            s, doc = np.concatenate([s, v]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.append(True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))
    return s[new], np.bincount(doc[new], minlength=len(per_doc))


def size_classes(largest: int, num: int, den: int) -> np.ndarray:
    """First size of every class: documents that link are of one class or of neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        # the next class starts above the largest partner of this one's first size
        out.append(max(out[-1] + 1, out[-1] * den // num + 1))
    return np.array([*out, out[-1] * den // num + 1], np.int64)


def weight_of(num: int, den: int) -> tuple[int, float]:
    """Elements that a group must hold to be written, and groups per element of difference such that enough hold them."""
    mean = num / (den - num)
    return (3, 1.25) if mean >= 5.5 else (2, 1.17) if mean >= 3.8 else (1, 1.1)


def signatures(s: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of the groups of every document, in the schemes of its own class and the one below.

    Of a pair that links, the sets differ in at most (den - num) / num times the smaller
    one's size. So where a document has more groups of some weight than that, one of them is
    the same in both, and lighter groups need not be written; else all groups are, empty
    ones too.
    """
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bounds = size_classes(int(sizes.max()), num, den)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    content = mix(s ^ np.uint64(0xA5A5A5A5_5A5A5A5A))
    weight, share = weight_of(num, den)
    out, owner = [], []
    own = np.searchsorted(bounds, sizes, side="right") - 1
    for below in (0, 1):
        scheme = own - below
        ok = (scheme >= 0) & (sizes > 0)
        differ = (den - num) * (bounds[np.maximum(scheme, 0) + 1] - 1) // num
        parts = np.where(differ == 0, 1, np.ceil(differ * share).astype(np.int64) + 2)
        pick = ok[doc]
        d = doc[pick]
        part = ((s[pick] >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)
        if not len(d):
            continue
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])))
        total = np.add.reduceat(content[pick], first)
        count = np.diff(np.append(first, len(d)))
        d, part = d[first], part[first]
        salt = scheme[d].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        sig = mix(mix(total * _ODD + part) + salt + count.astype(np.uint64))
        most = np.minimum(differ, (den - num) * sizes // num)
        heavy = np.bincount(d[count >= weight], minlength=len(sizes)) > most
        keep = (count >= weight) | ~heavy[d]
        out.append(sig[keep])
        owner.append(d[keep])
        used = np.bincount(d, minlength=len(sizes))
        for k in np.flatnonzero(ok & (used <= most)):
            empty = np.setdiff1d(np.arange(parts[k]), part[d == k].astype(np.int64)).astype(np.uint64)
            out.append(mix(mix(empty) + np.uint64(int(scheme[k]) * 0xD6E8FEB86659FD93 % (1 << 64))))
            owner.append(np.full(len(empty), k))
    return np.concatenate(out), np.concatenate(owner)


def _write(kind: int, key: np.ndarray, doc: np.ndarray, aux: np.ndarray, n: np.ndarray, point: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(doc), 200_000):
        z = slice(a, a + 200_000)
        size = len(doc[z])
        points = pa.nulls(size, pa.binary()) if point is None else pa.array([p.tobytes() for p in point[z]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), pa.array(key[z].view(np.int64)), pa.array(doc[z]), pa.array(aux[z].view(np.int64)), pa.array(n[z]), points], ["kind", "key", "doc", "aux", "n", "point"])


def count_points(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts of each set's elements in GROUPS hash groups, as bytes in units of the last two bytes, rounded up."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(doc * GROUPS + (s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=len(sizes) * GROUPS).reshape(-1, GROUPS)
    unit = np.maximum(1, -(-counts.max(1, initial=0) // 255))
    out = np.empty((len(sizes), GROUPS + 2), np.uint8)
    out[:, :GROUPS] = -(-counts // unit[:, None])
    out[:, GROUPS], out[:, GROUPS + 1] = unit >> 8, unit & 255
    return out


def read_points(column: pa.Array) -> np.ndarray:
    """The counts back, each at least what it was."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS + 2).astype(np.int32)
    return raw[:, :GROUPS] * ((raw[:, GROUPS] << 8) | raw[:, GROUPS + 1])[:, None]


def _sign(words: int, num: int, den: int):
    """Documents to rows: 0 a document (key and aux its set's two hashes, and its point), 1 a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch).fill_null(0).to_numpy()
            real = ids_of(batch).is_valid().to_numpy(zero_copy_only=False)
            parts = [(first, end, *shingle_sets(data, offsets, words)) for first, end, data, offsets in chunks(batch.column(1))]
            if not parts:
                continue
            n, one, two = np.concatenate([p[3] for p in parts]), np.concatenate([segment_sums(mix(p[2]), p[3]) for p in parts]), np.concatenate([segment_sums(mix(p[2] ^ _ODD), p[3]) for p in parts])
            able = real & (n > 0)
            # of equal sets in the batch, the first document alone writes signatures
            order = np.lexsort((ids, two, one, n, ~able))
            order = order[able[order]]
            head = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (n[order][1:] != n[order][:-1]))[: len(order)]
            writer = np.zeros(len(ids), bool)
            writer[order[head]] = True
            key = np.where(able, mix(one + n.astype(np.uint64)), mix(ids.astype(np.uint64)))
            while parts:
                first, end, s, size = parts.pop(0)
                z = slice(first, end)
                yield from _write(0, key[z], ids[z], two[z], np.where(real[z], size, -1 - size), count_points(s, size))
                sig, owner = signatures(s[np.repeat(writer[z], size)], size[writer[z]], num, den)
                owner = ids[z][writer[z]][owner]
                zero = np.zeros(len(owner), np.int64)
                yield from _write(1, sig, owner, zero, zero)

    return run


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's keys: 0 (document, n, first document with the same set, point) and 1 (document, route, signature) where two documents or more have it."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    kind, key, doc, aux, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5))
    points = pa.concat_arrays([b.column(5) for b in held])
    del held

    def rows(kind: int, a: np.ndarray, n: np.ndarray, b: np.ndarray, point: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 200_000):
            z = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[z]), kind, np.int8)), pa.array(a[z]), pa.array(n[z]), pa.array(b[z]), pa.nulls(len(a[z]), pa.binary()) if point is None else point[z]], ["kind", "a", "n", "b", "point"])

    at = np.flatnonzero(kind == 0)
    at = at[np.lexsort((doc[at], n[at], aux[at], key[at]))]
    if len(at):
        able = n[at] > 0
        head = np.append(True, (key[at][1:] != key[at][:-1]) | (aux[at][1:] != aux[at][:-1]) | (n[at][1:] != n[at][:-1])) | ~able
        yield from rows(0, doc[at], n[at], doc[at][head][np.cumsum(head) - 1], points.take(pa.array(at)))
    at = np.flatnonzero(kind == 1)
    at = at[np.lexsort((doc[at], key[at]))]
    if len(at):
        new = np.append(True, key[at][1:] != key[at][:-1])
        other = new | np.append(True, doc[at][1:] != doc[at][:-1])
        at, new = at[other], new[other]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        # of signatures that the same documents share, one is enough
        group = np.add.reduceat(mix(doc[at].astype(np.uint64)), first)
        once = np.zeros(len(first), bool)
        once[np.unique(mix(group + size.astype(np.uint64)), return_index=True)[1]] = True
        # where the rows go next: signatures of one first document together, as their documents are much the same,
        # but those of many documents to as many places as their number asks for
        places = np.clip(size // TOGETHER, 1, 256).astype(np.uint64)
        route = mix(doc[at][first].astype(np.uint64) * _ODD + key[at][first].view(np.uint64) % places).view(np.int64)
        keep = np.repeat(once & (size > 1), size)
        yield from rows(1, doc[at][keep], np.repeat(route, size)[keep], key[at][keep])


def likely_links(points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (row, row) of the graph of pairs whose summed minima allow a link."""
    least = lambda x, y: -(-num * (x + y) // (num + den))
    n = len(sizes)
    if n <= 2 * LEAF:
        x, y = np.triu_indices(n, 1)
        ok = np.minimum(points[x], points[y]).sum(1) >= least(sizes[x], sizes[y])
        return x[ok], y[ok]
    # most rows of a group of near copies are like one of a few of them; what that leaves apart goes to the tree
    root = np.arange(n)
    for lead in range(0, n, max(1, n // 4)):
        like = np.minimum(points, points[lead]).sum(1) >= least(sizes, sizes[lead])
        if like.any():
            root[np.isin(root, root[like])] = root[like].min()
    parts = [(np.arange(n)[root != np.arange(n)], root[root != np.arange(n)])]
    if len(np.unique(root)) > 1:
        for x, y in Tree(points, sizes).pairs(points, sizes, least, root):
            parts.append((x, y))
    return tuple(np.concatenate(z) for z in zip(*parts, strict=True))


def _prune(num: int, den: int):
    """Rows (signature, doc, n, point) in order of signature to a forest of likely links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in [*batches, None]:
            if batch is not None:
                rest.append(batch)
                if sum(map(len, rest)) < PRUNED:
                    continue
            if not rest:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            sig, doc, n = (whole.column(i).to_numpy() for i in range(3))
            # the last signature may go on in the next batch
            end = len(sig) if batch is None else int(np.searchsorted(sig, sig[-1]))
            rest = whole.slice(end).to_batches()
            if not end:
                continue
            points = read_points(whole.column(3).slice(0, end).combine_chunks() if whole.num_rows else whole.column(3))
            cut = np.flatnonzero(np.append(True, sig[1:end] != sig[: end - 1]))
            size = np.diff(np.append(cut, end))
            out = []
            for k in np.unique(size[size <= 2 * LEAF]):
                # groups of one size together
                x, y = np.triu_indices(k, 1)
                first = cut[size == k]
                for b in range(0, len(first), max(1, 20_000 // max(1, len(x)))):
                    a = first[b : b + max(1, 20_000 // max(1, len(x)))]
                    i, j = (a[:, None] + x).ravel(), (a[:, None] + y).ravel()
                    ok = np.minimum(points[i], points[j]).sum(1) >= -(-num * (n[i] + n[j]) // (num + den))
                    out.append(np.stack([doc[i[ok]], doc[j[ok]]]))
            for a, k in zip(cut[size > 2 * LEAF], size[size > 2 * LEAF], strict=True):
                i, j = likely_links(points[a : a + k], n[a : a + k], num, den)
                out.append(np.stack([doc[a + i], doc[a + j]]))
            if out:
                u, v = forest(*np.concatenate(out, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


#: Documents that share signatures up to which one place takes all of those.
TOGETHER = 64
#: Rows of shared signatures that a task prunes at once, unless one signature has more.
PRUNED = 300_000


class Tree:
    """An R-tree over count vectors, packed by size and then by the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        wide = int(np.argmax(points.var(0)))
        order = np.concatenate([part[np.argsort(points[part, wide], kind="stable")] for part in np.split(order, range(slab, len(order), slab))])
        self.order = order
        high, low = points[order], sizes[order]
        self.levels = []
        width = LEAF
        while len(high) > 1 or not self.levels:
            cut = np.arange(0, len(high), width)
            high, low = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))
            width = FAN

    def pairs(self, points: np.ndarray, sizes: np.ndarray, least, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose summed minima reach ``least`` of their two sizes, in batches of leaves; with ``root``, not those below nodes of one root."""
        a = b = np.zeros(1, np.int64)
        low_root, high_root = self._roots(root) if root is not None else (None, None)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            keep = [np.minimum(high[a[i : i + 8192]], high[b[i : i + 8192]]).sum(1) >= least(low[a[i : i + 8192]], low[b[i : i + 8192]]) for i in range(0, len(a), 8192)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            if root is not None:
                keep &= ~((low_root[depth][a] == high_root[depth][a]) & (low_root[depth][b] == high_root[depth][b]) & (low_root[depth][a] == low_root[depth][b]))
            a, b = a[keep], b[keep]
            width, n = (FAN, len(self.levels[depth - 1][0])) if depth else (LEAF, len(self.order))
            if depth:
                a, b = _children(a, b, width, n)
        for i in range(0, len(a), 256):
            x, y = _children(a[i : i + 256], b[i : i + 256], LEAF, len(self.order))
            off = x != y
            x, y = self.order[x[off]], self.order[y[off]]
            if root is not None:
                off = root[x] != root[y]
                x, y = x[off], y[off]
            ok = np.concatenate([np.minimum(points[x[j : j + 8192]], points[y[j : j + 8192]]).sum(1) >= least(sizes[x[j : j + 8192]], sizes[y[j : j + 8192]]) for j in range(0, len(x), 8192)] or [np.zeros(0, bool)])
            yield x[ok], y[ok]


    def _roots(self, root: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest root below every node of every level."""
        low = high = root[self.order]
        lows, highs, width = [], [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), width)
            low, high, width = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), FAN
            lows.append(low)
            highs.append(high)
        return lows, highs


def _children(a: np.ndarray, b: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (first <= second) of children of pairs of nodes."""
    k = np.arange(width)
    x = np.broadcast_to((a[:, None] * width + k)[:, :, None], (len(a), width, width)).ravel()
    y = np.broadcast_to((b[:, None] * width + k)[:, None, :], (len(b), width, width)).ravel()
    ok = (x <= y) & (y < n)
    return x[ok], y[ok]


def link_block(sets: list[np.ndarray], num: int, den: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row, row) of the links among the sets; with ``fresh``, of those pairs that have a fresh row."""
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    out_a, out_b = [], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return int(k)

    def least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Overlap that linked sets of these sizes have at least."""
        return -(-num * (x + y) // (num + den))

    def verify(i: int, j: int) -> None:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    points = np.zeros((len(sets), GROUPS), np.int32)
    for k, s in enumerate(sets):
        points[k] = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    for x, y in Tree(points, sizes).pairs(points, sizes, least):
        if fresh is not None:
            some = fresh[x] | fresh[y]
            x, y = x[some], y[some]
        while len(x):
            # drop what is connected by now, then verify one pair per document
            while (root != root[root]).any():
                root = root[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            _, now = np.unique(root[y], return_index=True)
            for k in now.tolist():
                i, j = int(x[k]), int(y[k])
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * den >= num * (sizes[i] + sizes[j] - both):
                    verify(i, j)
                    out_a.append(i)
                    out_b.append(j)
            rest = np.ones(len(x), bool)
            rest[now] = False
            x, y = x[rest], y[rest]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _verify(words: int, num: int, den: int):
    """Rows (cluster, block, doc, text, fresh) in order of cluster and block to a forest of true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, docs, sets, fresh = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(docs) > 1:
                flags = np.array(fresh)
                a, b = link_block(sets, num, den, None if flags.all() else flags)
                if len(a):
                    ids = np.array(docs, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        for batch in batches:
            cluster, block, ids, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in chunks(batch.column(3)):
                s, n = shingle_sets(data, offsets, words)
                parts = np.split(s, np.cumsum(n)[:-1])
                for k in range(first, end):
                    if (cluster[k], block[k]) != name:
                        yield from done()
                        name, docs, sets, fresh = (cluster[k], block[k]), [], [], []
                    docs.append(int(ids[k]))
                    # a copy: the chunk is not kept for one of its sets
                    sets.append(parts[k - first].copy())
                    fresh.append(bool(flags[k]))
        yield from done()

    return run


def _links(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """True links among documents of the same (cluster, block); members: doc, cluster, block, fresh."""
    width = shuffle_width(texts.sparkSession)
    rows = members.join(texts, "doc").select("cluster", "block", "doc", "text", "fresh")
    return rows.repartition(width, "cluster", "block").sortWithinPartitions("cluster", "block", "doc").mapInArrow(lean(_verify(words, num, den)), "a long, b long")


def jaccard_components(docs: DataFrame, *, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs`` (doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their sets of
    lower-cased word n-grams; a text of fewer words is one n-gram; one without words, or
    null, has none and links with nothing. component_id is the least doc_id that links
    lead to. Rows that repeat a doc_id are one document with several texts: they
    share a component. Rows without a doc_id have no component. No table: no rows.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    signed = docs.select("doc_id", "text").mapInArrow(lean(_sign(words, num, den)), ROWS)
    tied = stored(signed.repartition(width, "key").mapInArrow(lean(_tie), "kind byte, a long, n long, b long, point binary"), "ties")
    nodes = tied.where("kind = 0 AND n >= 0")
    shared = tied.where("kind = 1").select(F.col("b").alias("sig"), F.col("a").alias("doc"), F.col("n").alias("route"))
    known = nodes.where("n > 0").groupBy(F.col("a").alias("doc"), "n").agg(F.max("point").alias("point"))
    met = shared.join(known, "doc").select("sig", "doc", "n", "point", "route")
    likely = stored(met.repartition(width, "route").sortWithinPartitions("sig", "doc").mapInArrow(lean(_prune(num, den)), "a long, b long"), "likely")
    same = nodes.where("a <> b").select("a", "b").distinct()
    clusters = connected(likely.union(same))
    # one document per distinct set takes part; clusters of one set are done
    leaders = nodes.where("n > 0").select(F.col("b").alias("doc")).distinct()
    placed = stored(leaders.join(clusters.select(F.col("u").alias("doc"), F.col("v").alias("cluster")), "doc", "left").select("doc", F.coalesce("cluster", "doc").alias("cluster")), "placed")
    salted = [F.min_by("doc", F.xxhash64("doc", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"), *salted).where("size > 1")
    pivots = F.array(*[F.col(f"p{k}") for k in range(PIVOTS)])
    sizes = stored(sizes, "clusters")
    members = stored(join_sizes(placed, sizes, "cluster", "size", placed.count()).select("doc", "cluster", "size", F.array_distinct(pivots).alias("pivots")), "members")
    # the texts of these documents alone go on; they are moved once
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("doc").isNotNull())
    texts = stored(likely_in(rows, "doc", members.select("doc")).join(members.select("doc"), "doc", "left_semi"), "texts")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    everywhere = F.array_contains("pivots", F.col("doc")) & (F.col("size") > BLOCK)
    dealt = members.withColumn("block", F.explode(F.when(everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).select("doc", "cluster", "block", F.lit(True).alias("fresh"))
    links = stored(_links(dealt, texts, words, num, den).union(same), "links")
    large = members.where(F.col("size") > BLOCK).select("doc", "cluster", "size", own.alias("block"))
    if large.limit(1).count():
        links = _rest(large, links, texts, words, num, den)
    comp = connected(links).select(F.col("u").alias("doc"), F.col("v").alias("component"))
    out = nodes.select(F.col("a").alias("doc"), F.col("n").alias("n_shingles")).join(comp, "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    lost = tied.where("kind = 0 AND n < 0").select(F.lit(None).cast("long").alias("doc_id"), (-1 - F.col("n")).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(lost)


def _rest(large: DataFrame, links: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The links so far, and those between blocks of large clusters: what is not in the largest component against all blocks."""
    comp = connected(links)
    rows = large.join(comp.select(F.col("u").alias("doc"), F.col("v").alias("component")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rows = stored(rows, "large")
    per = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("top"))
    rows = rows.join(main, "cluster").where(F.col("all") > F.col("top"))
    apart = F.col("component") != F.col("main")
    pieces = F.ceil((F.col("all") - F.col("top")) / BLOCK).cast("int")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # task (piece of what is apart, block): the piece goes to every block, a block meets every piece
    left = rows.where(apart).select("doc", "cluster", F.pmod(F.xxhash64("doc", F.lit(1)), pieces).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("fresh"), blocks.alias("blocks"))
    right = rows.select("doc", "cluster", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "block", F.lit(False).alias("fresh"), blocks.alias("blocks"))
    both = left.union(right).groupBy("doc", "cluster", (F.col("piece") * F.col("blocks") + F.col("block")).alias("block")).agg(F.max("fresh").alias("fresh"))
    return stored(_links(both.select("doc", "cluster", "block", "fresh"), texts, words, num, den).union(links), "links")


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, all columns; rows without a doc_id stay."""
    found = jaccard_components(docs, **options)
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"), F.lit(True).alias("_out")).distinct(), "gone")
    return left_by_key(docs, "doc_id", gone, "_gone").where("_out IS NULL").drop("_out")
