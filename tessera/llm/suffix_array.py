"""Suffix arrays by induced sorting.

Suffixes are classified (L when larger than their successor, S when smaller), the leftmost S suffixes (LMS)
are bucketed and their substrings sorted by inducing L suffixes left to right and S suffixes right to left,
named, and the string of names is sorted the same way, down to a string whose names all differ; a last induction
places all suffixes.  Where buckets are long, a bucket is placed in waves of array operations: all its suffixes
at hand at once, then those they put into the same bucket.  In a string of names buckets are short, and suffixes
are placed one by one; the order is the same.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a bucket, on average, from which buckets are placed in waves.
LONG_BUCKET = 256


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type; the last symbol is the unique smallest."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    kind = np.ones(n, bool)
    kind[:-1] = np.append(step, 1)[nxt] > 0
    return kind


def _place(sa: np.ndarray, s: np.ndarray, j: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Puts suffixes, in order, at the growing edge of their buckets."""
    if not len(j):
        return
    d = s[j]
    order = np.argsort(d, kind="stable")
    j, d = j[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    count = np.diff(np.append(first, len(d)))
    rank = np.arange(len(d)) - np.repeat(first, count)
    c = d[first].astype(np.int64)
    if down:
        sa[np.repeat(edge[c], count) - 1 - rank] = j
        edge[c] -= count
    else:
        sa[np.repeat(edge[c], count) + rank] = j
        edge[c] += count


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, kinds: int, long_bucket: int = LONG_BUCKET) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order (or, for their substrings, in any order)."""
    n = len(s)
    if n < kinds * long_bucket:
        return _one_by_one(s, small, lms, kinds)
    size = np.bincount(s, minlength=kinds)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    head, tail = begin.copy(), end.copy()
    key = s[lms]
    lms = lms[np.argsort(key, kind="stable")]
    upto = np.cumsum(np.bincount(key, minlength=kinds))
    present = np.flatnonzero(size).tolist()
    for c in present:
        lo = begin[c]
        while lo < head[c]:
            hi = head[c]
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            _place(sa, s, j[~small[j]], head, False)
            lo = hi
        own = lms[upto[c - 1] if c else 0 : upto[c]]
        if len(own):
            j = own - 1
            j = j[j >= 0]
            _place(sa, s, j[~small[j]], head, False)
    sa[0] = n - 1  # the sentinel, alone in its bucket
    tail[s[n - 1]] -= 1
    for c in reversed(present):
        hi = end[c]
        while hi > tail[c]:
            lo = tail[c]
            j = sa[lo:hi][::-1] - 1
            j = j[j >= 0]
            _place(sa, s, j[small[j]], tail, True)
            hi = lo
        j = sa[begin[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        _place(sa, s, j[small[j]], tail, True)
    return sa


def _one_by_one(s: np.ndarray, small: np.ndarray, lms: np.ndarray, kinds: int) -> np.ndarray:
    """The same induction over plain lists, which are read while they fill."""
    n, s = len(s), s.astype(np.int64)
    size = np.bincount(s, minlength=kinds)
    end = np.cumsum(size)
    key = s[lms]
    order = np.argsort(key, kind="stable")
    key, lms = key[order], lms[order]
    upto = np.cumsum(np.bincount(key, minlength=kinds))
    begin = np.full(n, -1, np.int64)
    begin[end[key] - upto[key] + np.arange(len(lms))] = lms
    sa = begin.tolist()
    # the bucket of the suffix before each one, if that is of the kind sought, else -1; an empty place reads the last entry
    before = np.full((2, n + 1), -1, np.int64)
    before[0, 1:n] = np.where(small[:-1], -1, s[:-1])
    before[1, 1:n] = np.where(small[:-1], s[:-1], -1)
    bucket, edge = before[0].tolist(), (end - size).tolist()
    for j in sa:
        c = bucket[j]
        if c >= 0:
            at = edge[c]
            sa[at] = j - 1
            edge[c] = at + 1
    bucket, edge = before[1].tolist(), end.tolist()
    for j in reversed(sa):
        c = bucket[j]
        if c >= 0:
            at = edge[c] - 1
            sa[at] = j - 1
            edge[c] = at
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings, equal ones alike, in text order."""
    n = len(s)
    where = np.full(n + 1, -1, np.int64)
    where[lms] = np.arange(len(lms))
    stop = np.append(lms[1:], n - 1)  # a substring ends with the next LMS symbol
    length = (stop - lms + 1)[where[sorted_lms]]
    length[sorted_lms == n - 1] = 1
    a, b = sorted_lms[:-1], sorted_lms[1:]
    new = length[:-1] != length[1:]
    live = np.flatnonzero(~new)
    k = 0
    while len(live):
        differ = s[a[live] + k] != s[b[live] + k]
        new[live[differ]] = True
        k += 1
        live = live[~differ]
        live = live[length[:-1][live] > k]
    name = np.empty(len(lms), np.int64)
    name[where[sorted_lms]] = np.concatenate([[0], np.cumsum(new)])
    return name


def suffix_array(s: np.ndarray, long_bucket: int = LONG_BUCKET) -> np.ndarray:
    """Suffixes of ``s``, which ends in its only 0, in order."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1]
    small = classify(s)
    kinds = int(s.max()) + 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(s, small, lms, kinds, long_bucket)
    ranked = sa[is_lms[sa]]
    name = _names(s, lms, ranked)
    if name.max(initial=0) + 1 < len(lms):
        ranked = lms[suffix_array(name, long_bucket)]
    return induce(s, small, ranked, kinds, long_bucket)


def common_prefixes(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each position its neighbour before in the array, and the common prefix, at most ``room``.

    room: symbols left in the position's own piece of text.  A prefix that the position before already shares
    one symbol longer is not compared again; only irreducible ones, and those that begin a piece, are.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    i = np.arange(n)
    direct = np.ones(n, bool)
    direct[1:] = (phi[1:] <= 0) | (text[i[1:] - 1] != text[np.maximum(phi[1:] - 1, 0)]) | (room[1:] >= room[:-1]) | (phi[:-1] < 0)
    first = np.flatnonzero(direct)
    padded = np.concatenate([text.astype(np.uint64) & np.uint64(0xFFFF), np.arange(16, dtype=np.uint64) + np.uint64(60000)])
    word = padded[: n + 8].copy()
    for k in range(1, 4):
        word[: n + 8] |= padded[k : n + 8 + k] << np.uint64(16 * k)
    a, b, limit = first, phi[first], room[first]
    got = np.zeros(len(first), np.int64)
    live = np.flatnonzero((b >= 0) & (limit > 0))
    k = 0
    while len(live):
        p, q = a[live] + k, b[live] + k
        inside = (p < n) & (q < n)
        diff = np.where(inside, word[np.minimum(p, n)] ^ word[np.minimum(q, n)], np.uint64(1))
        same = diff == 0
        ended = live[~same]
        low = diff[~same]
        got[ended] = k + ((low & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((low & np.uint64(0xFFFFFFFF)) == 0) + ((low & np.uint64(0xFFFFFFFFFFFF)) == 0)
        k += 4
        live = live[same]
        over = limit[live] <= k
        got[live[over]] = k
        live = live[~over]
    got = np.minimum(got, limit)
    back = np.maximum.accumulate(np.where(direct, i, 0))
    base = np.zeros(n, np.int64)
    base[first] = got
    return phi, np.minimum(np.maximum(base[back] - (i - back), 0), room)
