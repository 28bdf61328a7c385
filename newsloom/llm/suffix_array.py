"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes; numpy inside one task.

Suffixes are classified as S (smaller than the next suffix) or L; the leftmost S ones (LMS) are sorted first, the
rest are induced from them in two linear sweeps over the 256 character buckets. A bucket is swept in waves: a wave
holds the entries that the one before induced into the same bucket, so a wave costs a few array operations however
many suffixes it holds, and there are as many waves as the longest run of one byte.
"""

from __future__ import annotations

import numpy as np


def _suffix_types(t: np.ndarray) -> np.ndarray:
    n = len(t)
    step = t[:-1].astype(np.int16) - t[1:]
    after = np.where(step != 0, np.arange(n - 1), n - 1)
    after = np.minimum.accumulate(after[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = step[np.minimum(after, n - 2)] < 0
    return s


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in the order wanted."""
    n = len(t)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int32)
    lms_char = t[lms]
    by_char = lms[np.argsort(lms_char, kind="stable")]
    lms_ends = np.cumsum(np.bincount(lms_char, minlength=256))
    lms_begins = np.r_[0, lms_ends[:-1]]
    head = begins.copy()

    def push(items: np.ndarray, want_s: bool, place: np.ndarray, sign: int) -> None:
        before = items - 1
        before = before[(before >= 0)]
        before = before[is_s[before] == want_s]
        if not len(before):
            return
        ch = t[before]
        order = np.argsort(ch, kind="stable")
        ch = ch[order]
        got = np.bincount(ch, minlength=256)
        rank = np.arange(len(ch)) - (np.cumsum(got) - got)[ch]
        sa[place[ch] + sign * rank] = before[order]
        place += sign * got

    for c in np.flatnonzero(counts):
        done = begins[c]
        while done < head[c]:
            items = sa[done : head[c]]
            done = head[c]
            push(items, False, head, 1)
        push(by_char[lms_begins[c] : lms_ends[c]], False, head, 1)
    tail = ends - 1
    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            items = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            push(items, True, tail, -1)
        push(sa[begins[c] : head[c]][::-1], True, tail, -1)
    sa[0] = n - 1
    return sa


def _name_lms(t: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers for the sorted LMS substrings, equal ones alike."""
    a, b, la = order[1:], order[:-1], length[1:]
    same = la == length[:-1]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[la[live] > k]
        ok = t[a[live] + k] == t[b[live] + k]
        same[live[~ok]] = False
        live = live[ok]
        k += 1
    return np.r_[0, np.cumsum(~same)]


def _rank_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string: names of pairs, then of pairs of those, until all differ.

    Its alphabet is too large for byte buckets. Suffixes that agree in ``depth`` names stay tied, by position.
    """
    n, width, rank = len(names), 1, names.astype(np.int64)
    while width < depth:
        key = rank * (rank.max() + 2)
        key[: n - width] += rank[width:] + 1 if width < n else 0
        values, rank = np.unique(key, return_inverse=True)
        if len(values) == n:
            break
        width *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """Of a uint8 string whose last value is smaller than all others. Order is exact in the first ``depth`` values at least."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    is_s = _suffix_types(t)
    leftmost = np.r_[False, is_s[1:] & ~is_s[:-1]]
    lms = np.flatnonzero(leftmost).astype(np.int32)
    counts = np.bincount(t, minlength=256)
    if len(lms) > 1:
        first = _induce(t, is_s, lms, counts)
        order = first[leftmost[first]]
        size = np.zeros(n, np.int32)
        size[lms] = np.diff(np.r_[lms, n - 1]) + 1
        names = np.empty(n, np.int32)
        names[order] = _name_lms(t, order, size[order])
        reduced = names[lms]
        lms = lms[np.argsort(reduced, kind="stable") if reduced.max() == len(lms) - 1 else _rank_names(reduced, depth)]
    return _induce(t, is_s, lms, counts)


def permuted_common_prefix(t: np.ndarray, sa: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """For each position: the prefix (up to ``cap``, a multiple of 8) that its suffix shares with the one before it in
    order; only where ``at`` holds for both, else 0. Compared eight values at a time."""
    n = len(t)
    out = np.zeros(n, np.int32)
    a, b = sa[1:], sa[:-1]
    live = at[a] & at[b]
    a, b = a[live].astype(np.int64), b[live].astype(np.int64)
    padded = np.r_[t, np.zeros(cap + 8, np.uint8)]
    eights = np.lib.stride_tricks.as_strided(padded, (n + cap, 8), (1, 1))
    whole = np.ascontiguousarray(eights).view(np.uint64).ravel()
    k = 0
    while len(a) and k < cap:
        differ = whole[a + k] ^ whole[b + k]
        stop = differ != 0
        if stop.any():
            low = differ[stop] & (~differ[stop] + np.uint64(1))
            out[a[stop]] = k + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
            a, b = a[~stop], b[~stop]
        k += 8
    out[a] = cap
    return np.minimum(out, cap)
