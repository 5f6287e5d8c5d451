"""Suffix arrays by induced sorting, and permuted longest common prefixes, on NumPy arrays.

Induced sorting goes bucket by bucket. All suffixes that a bucket holds at some moment induce their predecessors in one
vectorised step; those that fall into the same bucket make the bucket's next step. That keeps the order of the usual
one-by-one loops, with a number of steps near that of the distinct symbols. The recursion's strings have many symbols
and go one by one.
"""

from __future__ import annotations

import numpy as np

#: A string is induced bucket by bucket if it has so many suffixes a symbol, which texts have and the recursion's reduced
#: strings mostly don't; else suffix by suffix. Both are linear and give the same order.
LEAST_PER_SYMBOL = 100


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (S-type). The last symbol is a unique least one."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        up, differs = t[:-1] < t[1:], t[:-1] != t[1:]
        at = np.where(differs, np.arange(n - 1), n)  # the last pair always differs
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = up[nearest]
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The suffix array, given the leftmost S-type suffixes in order."""
    n = len(t)
    end = np.cumsum(count)
    start = end - count
    used = np.flatnonzero(count)
    sa = np.full(n, -1, np.int32)
    per = np.bincount(t[lms], minlength=len(count))
    first = np.cumsum(per) - per

    def spread(block: np.ndarray, kind: bool, at: np.ndarray, sign: int) -> None:
        j = block - 1
        j = j[(j >= 0)]
        j = j[s[j] == kind]
        if not len(j):
            return
        c = t[j]
        if len(j) > 1:
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
            cut = np.flatnonzero(c[1:] != c[:-1]) + 1
            heads = np.concatenate([[0], cut])
            sizes = np.diff(np.append(heads, len(c)))
            place = np.arange(len(c)) - np.repeat(heads, sizes)
            sa[at[c] + sign * place] = j
            at[c[heads]] += sign * sizes
        else:
            sa[at[c]] = j
            at[c] += sign

    head = start.copy()
    for c in used:
        i = start[c]
        while i < head[c]:
            i, block = head[c], sa[i : head[c]]
            spread(block, False, head, 1)
        if per[c]:
            spread(lms[first[c] : first[c] + per[c]], False, head, 1)
    tail = end - 1
    sa[0] = n - 1
    for c in used[::-1]:
        i = end[c] - 1
        while i > tail[c]:
            i, block = tail[c], sa[tail[c] + 1 : i + 1]
            spread(block[::-1], True, tail, -1)
        if c == t[n - 1]:
            spread(sa[:1], True, tail, -1)
        if head[c] > start[c]:
            spread(sa[start[c] : head[c]][::-1], True, tail, -1)
    return sa


def _induce_one_by_one(t: np.ndarray, s: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``_induce`` in the usual loops, for strings whose buckets hold too few suffixes to go by bucket."""
    n, t = len(t), t.astype(np.int64)
    end = np.cumsum(count)
    head, tail = (end - count).tolist(), (end - 1).tolist()
    left = np.where(s, -1, t).tolist()
    first = np.full(n, -1, np.int64)
    own = t[lms]  # in order, so equal symbols stand side by side
    behind = np.searchsorted(own, own, side="right") - np.arange(len(own))
    first[end[own] - behind] = lms
    sa = first.tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0:
            c = left[j]
            if c >= 0:
                sa[head[c]] = j
                head[c] += 1
    right = np.where(s, t, -1).tolist()
    del left
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0:
            c = right[j]
            if c >= 0:
                sa[tail[c]] = j
                tail[c] -= 1
    return np.array(sa, np.int32)


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Of integers below ``symbols``, whose last one is less than all others."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    induce = _induce if symbols * LEAST_PER_SYMBOL <= n else _induce_one_by_one
    count = np.bincount(t, minlength=symbols)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        sorted_ = induce(t, s, lms[np.argsort(t[lms], kind="stable")], count)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sorted_ = sorted_[is_lms[sorted_]]
        order_of = np.zeros(n, np.int32)
        order_of[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms), 0) + 1
        own = length[order_of[sorted_]]
        same = own[1:] == own[:-1]
        for d in range(int(own.max())):  # names: compare neighbours symbol by symbol, as long as any are alike
            live = np.flatnonzero(same & (own[1:] > d))
            if not len(live):
                break
            same[live] = t[sorted_[live] + d] == t[sorted_[live + 1] + d]
        name = np.concatenate([[0], np.cumsum(~same)])
        if name[-1] == len(lms) - 1:
            lms = sorted_
        else:
            reduced = np.zeros(len(lms), np.int64)
            reduced[order_of[sorted_]] = name
            lms = lms[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(t, s, lms, count)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position i, phi(i), the position before i's in the array (-1 for the first), and the length of the
    common prefix of the two suffixes. Only irreducible positions are compared; each other one follows its left
    neighbour with one symbol less."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    need = (phi < 1) | (at == 0)
    rest = np.flatnonzero(~need)
    need[rest] = t[rest - 1] != t[phi[rest] - 1]
    i = np.flatnonzero(need & (phi >= 0))
    wide = np.zeros(n + 8, np.uint64)
    for k in range(min(4, n)):
        wide[: n - k] |= t[k:].astype(np.uint64) << np.uint64(16 * k)
    lcp, a, b = np.zeros(n, np.int64), i.copy(), phi[i]
    live, depth = np.arange(len(i)), 0
    found = np.zeros(len(i), np.int64)
    while len(live):
        x = wide[np.minimum(a[live] + depth, n)] ^ wide[np.minimum(b[live] + depth, n)]
        ends = x != 0
        done, y = live[ends], x[ends]
        part = ((y & np.uint64(0xFFFF)) == 0).astype(np.int64)
        part += (y & np.uint64(0xFFFFFFFF)) == 0
        part += (y & np.uint64(0xFFFFFFFFFFFF)) == 0
        found[done] = depth + part
        live, depth = live[~ends], depth + 4
    lcp[i] = found + i
    head = np.where(need, at, 0)
    np.maximum.accumulate(head, out=head)
    return phi, np.maximum(lcp[head] - at, 0)
