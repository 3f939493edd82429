"""Suffix arrays by induced sorting, bucket by bucket in vector steps.

Suffixes are classified as larger or smaller than their successor; substrings between
leftmost-smaller positions are sorted by one induction, named, and the string of names
is sorted recursively; a second induction gives the order of all suffixes. A bucket's
entries are handled together, as all of them are scanned one after the other anyway.
Every suffix is placed once per induction, so the work is linear.
"""

from __future__ import annotations

import numpy as np

#: Alphabets beyond this are sorted by rank doubling, in which buckets cost nothing.
BUCKETS = 1024
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last, a unique least, is."""
    n = len(t)
    step = t[1:].astype(np.int64) - t[:-1]
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, dtype=bool)
    small[:-1] = np.append(step, 1)[at] > 0
    return small


def _scatter(sa: np.ndarray, edge: np.ndarray, entries: np.ndarray, t: np.ndarray, sign: int) -> None:
    """Puts entries, in order, at the moving edge of their buckets."""
    chars = t[entries]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    start = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    heads = chars[start]
    sizes = np.diff(np.append(start, len(chars)))
    base = edge[heads]
    place = np.repeat(base - sign * start, sizes) + sign * np.arange(len(chars))
    sa[place] = entries[order]
    edge[heads] = base + sign * sizes


def induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from leftmost-smaller ones given in order."""
    n, size = len(t), len(bounds) - 1
    sa = np.full(n, -1, dtype=np.int64)
    chars = t[leftmost]
    by = np.argsort(chars, kind="stable")
    sorted_left, cut = leftmost[by], np.searchsorted(chars[by], np.arange(size + 1))
    head = bounds[:-1].copy()
    used = np.flatnonzero(np.diff(bounds))
    for c in used.tolist():
        lo = int(bounds[c])
        while lo < (hi := int(head[c])):
            e = sa[lo:hi] - 1
            lo = hi
            e = e[e >= 0]
            e = e[~small[e]]
            if len(e):
                _scatter(sa, head, e, t, 1)
        e = sorted_left[cut[c] : cut[c + 1]] - 1
        e = e[e >= 0]
        if len(e):
            _scatter(sa, head, e, t, 1)
    tail = bounds[1:] - 1
    for c in used[::-1].tolist():
        hi = int(bounds[c + 1]) - 1
        if c == 0:
            sa[0] = n - 1
        while hi > (lo := int(tail[c])):
            e = sa[lo + 1 : hi + 1][::-1] - 1
            hi = lo
            e = e[e >= 0]
            e = e[small[e]]
            if len(e):
                _scatter(sa, tail, e, t, -1)
        e = sa[bounds[c] : head[c]][::-1] - 1
        e = e[e >= 0]
        e = e[small[e]]
        if len(e):
            _scatter(sa, tail, e, t, -1)
    sa[0] = n - 1
    return sa


def doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by ``depth`` names at least; equal ones by position."""
    rank, h, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1 or h >= min(depth, n):
            return order


def _sort(t: np.ndarray, size: int, depth: int) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = classify(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=size))))
    sa = induce(t, small, left, bounds)
    if len(left) > 1:
        index = np.full(n, -1, dtype=np.int64)
        index[left] = np.arange(len(left))
        order = index[sa]
        order = order[order >= 0]
        # a substring reaches to the next leftmost-smaller position; equal ones share a name
        power = np.full(n, _PRIME, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n, _INVERSE, dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(0x51ED27)) * power, dtype=np.uint64)))
        end = np.append(left[1:], n - 1) + 1
        value = ((total[end] - total[left]) * back[left])[order]
        length = (end - left)[order]
        differ = (value[1:] != value[:-1]) | (length[1:] != length[:-1])
        name = np.concatenate(([0], np.cumsum(differ)))
        names = np.empty(len(left), dtype=np.int64)
        names[order] = name
        distinct = int(name[-1]) + 1
        if distinct == len(left):
            ranked = np.argsort(names)
        elif distinct <= BUCKETS and depth > 2:
            ranked = _sort(names, distinct, depth)
        else:
            ranked = doubling(names, depth)
        sa = induce(t, small, left[ranked], bounds)
    return sa


def suffix_array(text: np.ndarray, depth: int = 128) -> np.ndarray:
    """Suffixes of a byte string in the order of their first ``depth`` bytes at least."""
    t = np.concatenate((text.astype(np.int64) + 1, [0]))
    return _sort(t, 257, depth)[1:]


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, cap: int = 128) -> np.ndarray:
    """For each position, how long a prefix its suffix shares with its predecessor's in order.

    In text order, compared by hashes of doubling lengths; ``cap`` (a power of two) and
    longer count as ``cap``.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    hashes, h, width = [], (text.astype(np.uint64) + np.uint64(1)) * _PRIME, 1
    while width <= cap and len(h):
        hashes.append((width, h))
        if len(h) <= width:
            break
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * width) + h[width:]
        width *= 2
    length = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(before >= 0)
    a, b = at.copy(), before[at]
    for width, h in reversed(hashes):
        fits = (np.maximum(a, b) < len(h)) & (length[at] < cap)
        same = np.zeros(len(at), dtype=bool)
        same[fits] = h[a[fits]] == h[b[fits]]
        a[same] += width
        b[same] += width
        length[at[same]] += width
    return np.minimum(length, cap)
