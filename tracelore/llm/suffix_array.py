"""Suffix arrays by induced sorting, and permuted common prefixes, in vector operations.

The induction visits characters in order and, for one character, all suffixes that are
known at a time: those before them are put into their buckets together, in stable
order, which is the order of the one-by-one rule.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    n = len(t)
    small = np.zeros(n, bool)
    if n < 2:
        return small
    differs = np.append(t[1:] != t[:-1], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    inner = at < n - 1
    small[inner] = t[at[inner]] < t[at[inner] + 1]
    return small


def _put(sa: np.ndarray, place: np.ndarray, t: np.ndarray, found: np.ndarray, step: int) -> None:
    """Append suffixes to their buckets, in order, moving each bucket's place by ``step``."""
    c = t[found]
    order = np.argsort(c, kind="stable")
    found, c = found[order], c[order]
    head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(head, len(c)))
    rank = np.arange(len(c)) - np.repeat(head, size)
    sa[place[c] + step * rank] = found
    place[c[head]] += step * size


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that the given order of leftmost-smaller suffixes induces."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int32)
    tail = end - 1
    if len(lms):
        _put(sa, tail, t, lms[::-1], -1)
    seeds_from = tail + 1
    head = start.copy()
    # suffixes that are larger than the next one, from the front
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    used = np.flatnonzero(count)
    for c in used.tolist():
        at = start[c]
        while at < head[c]:
            now, at = sa[at : head[c]], int(head[c])
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _put(sa, head, t, before, 1)
        seeds = sa[seeds_from[c] : end[c]]
        if len(seeds):
            before = seeds[seeds > 0] - 1
            before = before[~small[before]]
            if len(before):
                _put(sa, head, t, before, 1)
    # smaller ones, from the back; the seeds are placed anew
    large_to = head
    tail = end - 1
    for c in used[::-1].tolist():
        sa[large_to[c] : tail[c] + 1] = -1
        at = end[c] - 1
        while at > tail[c]:
            now, at = sa[tail[c] + 1 : at + 1][::-1], int(tail[c])
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _put(sa, tail, t, before, -1)
        now = sa[start[c] : large_to[c]][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            _put(sa, tail, t, before, -1)
    return sa


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string over many names, by ranks of doubling lengths; only suffixes that are still equal to others are sorted on."""
    n = len(t)
    key = t.astype(np.int64) * (int(t.max()) + 2) + np.append(t[1:] + 1, 0)
    order = np.argsort(key)
    key = key[order]
    # the place of the first of its equals is a suffix's rank, and 0 is what follows the end
    rank = np.zeros(n + 1, np.int64)
    live, step = np.arange(n), 2
    while True:
        head = np.append(True, key[1:] != key[:-1])
        rank[order[live]] = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))] + 1
        live = live[~(head & np.append(head[1:], True))]
        if not len(live):
            return order
        at = order[live]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)]
        by = np.argsort(key)
        order[live], key = at[by], key[by]
        step *= 2


def _packed(t: np.ndarray) -> tuple[np.ndarray, int]:
    """The letters at each place and after it as one number, the first lowest, zeros after the end; and how many these are."""
    padded = np.concatenate([t, np.zeros(8, t.dtype)])
    return np.ndarray(len(t) + 1, "<u8", padded, strides=padded.strides), 8 // t.itemsize


#: Alphabets up to this size are sorted by induction at every depth, larger ones by doubling.
INDUCED = 1024


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Positions of all suffixes in order; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    if sigma > INDUCED:
        return _by_doubling(t).astype(np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, small, lms.astype(np.int32), sigma)
    sa = _induce(t, small, lms.astype(np.int32), sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: equal leftmost-smaller substrings get one name
    size = np.zeros(n, np.int32)
    size[lms] = np.append(np.diff(lms) + 1, n - lms[-1])
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    same &= (a != lms[-1]) & (b != lms[-1])
    live = np.flatnonzero(same)
    packed, many = _packed(t)
    k = 0
    while len(live):
        x, y = a[live], b[live]
        # of the letters read at once only those count that belong to both: sizes are equal
        left = size[x] - k
        over = np.maximum(many - left, 0).astype(np.uint64) * np.uint64(8 * t.itemsize)
        equal = (packed[x + k] ^ packed[y + k]) << over == 0
        same[live[~equal]] = False
        live = live[equal & (left > many)]
        k += many
    name = np.empty(n, np.int32)
    name[order] = np.cumsum(np.append(False, ~same))
    reduced = name[lms]
    top = int(reduced.max()) + 1
    if top < len(lms):
        order = lms[suffix_array(reduced, top)]
    return _induce(t, small, order.astype(np.int32), sigma)


def longest_shared(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix that its suffix shares with any other suffix.

    Permuted common prefixes with the previous suffix are compared directly only where the
    letters before differ; elsewhere they are one less than at the position before.
    """
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    packed, many = _packed(t)
    i = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (t[:-1] == t[np.maximum(before[1:] - 1, 0)])
    live = i[~follows & (before >= 0)]
    plcp = np.zeros(n, np.int64)
    done = np.zeros(len(live), np.int64)
    x, y = live, before[live]
    while len(live):
        limit = n - np.maximum(x, y)
        differ = packed[np.minimum(x, n)] ^ packed[np.minimum(y, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, many, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // (8 * t.itemsize))
        same = np.minimum(same, limit)
        done = done + same
        plcp[live] = done
        go = (same == many) & (limit > many)
        live, done, x, y = live[go], done[go], x[go] + many, y[go] + many
    head = np.maximum.accumulate(np.where(follows, 0, i))
    plcp = np.maximum(plcp[head] - (i - head), 0)
    plcp[before < 0] = 0
    best = plcp.copy()
    some = before >= 0
    np.maximum.at(best, before[some], plcp[some])
    return best
