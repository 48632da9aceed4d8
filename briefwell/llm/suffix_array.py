"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text in memory.

Suffixes are smaller (S) or larger (L) than the one after them. The leftmost S of each run (LMS) starts a substring that
ends at the next; these are sorted by one induction, named, and their sequence sorted by the same method. From their order
one left-to-right sweep places the L suffixes and one right-to-left sweep the S suffixes.

Small alphabets are swept bucket by bucket in arrays: what a bucket induces goes to later buckets, or in waves to itself.
Names have large alphabets; each is spelt as two or three digits of a small one, so that the same sweeps serve one level
down. There the recursion ends: names of names are ranked by pairs, pairs of pairs and so on.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are swept in arrays.
SMALL = 1024
#: Levels of names that are spelt as digits, and the least number of names that is.
DIGIT_LEVELS, DIGIT_NAMES = 1, 500


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as smaller."""
    n = len(t)
    small = np.ones(n, bool)
    if n > 1:
        step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
        where = np.where(step != 0, np.arange(n - 1), n - 1)
        following = np.minimum.accumulate(where[::-1])[::-1]
        small[:-1] = np.where(following < n - 1, step[np.minimum(following, n - 2)] > 0, False)
    return small


def _swept(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array induced from LMS positions in order (bucket by bucket: their own order within a character)."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    heads = t[lms]
    order = np.argsort(heads, kind="stable")
    lms, cuts = lms[order], np.searchsorted(heads[order], np.arange(size + 1)).tolist()
    starts = (ends - counts).tolist()
    held = np.empty(n, np.int32)  # L suffixes from the starts of buckets on, then S suffixes, from right to left

    def deal(j: np.ndarray, at: np.ndarray) -> None:
        """Append positions, in order, to the buckets of their characters."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        groups = np.bincount(c, minlength=size)
        held[at[c] + np.arange(len(c)) - (np.cumsum(groups) - groups)[c]] = j[order]
        at += groups

    def with_waves(first: np.ndarray, c: int, kind: bool) -> np.ndarray:
        """A bucket with what it induces into itself."""
        parts, wave = [first], first
        while len(wave):
            j = wave[wave > 0] - 1
            wave = j[(t[j] == c) & (small[j] == kind)]
            if len(wave):
                parts.append(wave)
        return np.concatenate(parts) if len(parts) > 1 else first

    at, left = ends - counts, []
    for c in range(size):
        bucket = with_waves(held[starts[c] : at[c]].copy(), c, False)
        left.append(bucket)
        sources = np.concatenate([bucket, lms[cuts[c] : cuts[c + 1]]])
        j = sources[sources > 0] - 1
        j = j[(t[j] > c) & ~small[j]]
        if len(j):
            deal(j, at)
    at, out, end = ends - counts, np.empty(n, np.int32), n
    deal(np.array([n - 1], np.int32), at)
    for c in range(size - 1, -1, -1):
        bucket = with_waves(held[starts[c] : at[c]].copy(), c, True)
        sources = np.concatenate([bucket, left[c][::-1]])  # right to left
        out[end - len(sources) : end] = sources[::-1]
        end -= len(sources)
        j = sources[sources > 0] - 1
        j = j[(t[j] < c) & small[j]]
        if len(j):
            deal(j, at)
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """The suffix array of a text of names: ranks of single names, then of pairs, of pairs of pairs, until all differ."""
    m = len(names)
    open_ = np.argsort(names, kind="stable")
    order, rank, place = open_.copy(), np.zeros(m, np.int64), np.arange(m)
    key, span = names[open_].astype(np.int64), 0
    while True:
        first = np.append(True, key[1:] != key[:-1])
        begins = np.flatnonzero(first)
        size = np.diff(np.append(begins, len(key)))
        rank[open_] = np.repeat(place[begins], size)
        more = np.repeat(size > 1, size)
        open_, place = open_[more], place[more]
        if not len(open_):
            return order
        span = 2 * span or 1
        after = open_ + span
        key = rank[open_] * (m + 1) + np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        open_, key = open_[sort], key[sort]
        order[place] = open_


def _of_names(names: np.ndarray, most: int, level: int) -> np.ndarray:
    """The suffix array of a text of names below ``most``, of which the last is the only 0."""
    m = len(names)
    if level >= DIGIT_LEVELS or m < DIGIT_NAMES:
        return _ranked(names)
    digits = 2 if most <= (SMALL - 2) ** 2 else 3
    base = int(np.ceil(most ** (1 / digits))) + 1
    spelt = np.zeros(digits * m + 1, np.int16)
    for k in range(digits):
        spelt[k:-1:digits] = names // base ** (digits - 1 - k) % base + 1
    sa = suffix_array(spelt, base + 1, level + 1)[1:]
    return sa[sa % digits == 0] // digits


def suffix_array(t: np.ndarray, size: int, level: int = 0) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order; entries lie in [0, size), and the last is the only 0."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    if size > SMALL:
        return _ranked(t)
    small = classify(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        sa = _swept(t, small, lms, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        length = np.zeros(n, np.int32)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        a, b = ordered[:-1], ordered[1:]
        same = length[a] == length[b]
        open_ = np.flatnonzero(same)
        step = 0
        while len(open_):  # first characters, then second ones, of the pairs still alike
            x, y = a[open_] + step, b[open_] + step
            differ = t[x] != t[y]  # of equal lengths, so characters tell the types
            same[open_[differ]] = False
            step += 1
            open_ = open_[~differ]
            open_ = open_[length[a[open_]] > step]
        names = np.zeros(n, np.int32)
        names[ordered] = np.concatenate([[0], np.cumsum(~same)])
        reduced = names[lms]
        most = int(reduced.max()) + 1
        if most == len(lms):
            by_rank = np.empty(most, np.int32)
            by_rank[reduced] = np.arange(most)
        else:
            by_rank = _of_names(reduced, most, level)
        lms = lms[by_rank]
    return _swept(t, small, lms, size)


def permuted_prefixes(t: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For suffix starts in suffix order: how many characters (below 2^16) each has in common with the one before, ``most`` at most; 0 for the first.

    Computed in text order, from the permuted array of predecessors, where neighbours read neighbouring characters.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    limit = len(t)
    before = np.full(limit, -1, np.int32)
    before[starts[1:]] = starts[:-1]
    at = np.sort(starts)
    at = at[before[at] >= 0]
    common = np.zeros(limit, np.int32)
    bits = 8 if t.dtype == np.uint8 else 16
    width = 64 // bits
    padded = np.zeros(limit + width - 1, np.uint64)
    padded[:limit] = t
    words, size = padded, 1
    while size < width:
        words = words[:-size] | words[size:] << np.uint64(bits * size)
        size *= 2

    def grown(open_: np.ndarray, size: int, by: int, of: np.ndarray) -> np.ndarray:
        """Those of the starts that have ``by`` further characters in common after ``size``."""
        other = before[open_]
        inside = np.maximum(open_, other) + (size + by) <= limit
        open_, other = open_[inside], other[inside]
        return open_[of[open_ + size] == of[other + size]]

    open_, size = at, 0
    while len(open_) and size + width <= most:  # a word of characters at a time, then what is left one by one
        open_ = grown(open_, size, width, words)
        size += width
        common[open_] = size
    for _ in range(width - 1):
        at = at[common[at] < most]
        other = before[at]
        more = np.maximum(at, other) + common[at] < limit
        at, other = at[more], other[more]
        at = at[padded[at + common[at]] == padded[other + common[at]]]
        common[at] += 1
    return common[starts]
