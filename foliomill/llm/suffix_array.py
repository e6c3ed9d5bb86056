"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The byte level is vectorised bucket by bucket; the recursion on named substrings, whose alphabet is
large and whose length is at most half, runs over plain lists.
"""

from __future__ import annotations

import numpy as np


def _s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, -1)[nxt] > 0, True) if len(t) > 1 else np.ones(1, bool)


class _Level:
    """Induced sorting of the suffixes of ``t``, whose last symbol 0 is unique and least."""

    def __init__(self, t: np.ndarray):
        self.t, self.n = t, len(t)
        self.s = _s_types(t)
        self.lms = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.ends = np.cumsum(np.bincount(t))
        self.heads = np.concatenate([[0], self.ends[:-1]])

    def _scatter(self, sa: np.ndarray, js: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends suffixes to their buckets in the given order, upwards or downwards."""
        symbols = self.t[js]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        count = np.diff(np.append(first, len(js)))
        rank = np.arange(len(js)) - np.repeat(first, count)
        sa[at[symbols] + step * rank] = js[order]
        at[symbols[first]] += step * count

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, given the leftmost-smaller ones in the order wanted within buckets."""
        t, s = self.t, self.s
        sa = np.full(self.n, -1, np.int64)
        tail = self.ends - 1
        self._scatter(sa, lms[::-1], tail, -1)
        tail_lms = tail.copy()
        head = self.heads.copy()
        for c in range(len(self.ends)):
            done = self.heads[c]
            while done < head[c]:  # waves: what the last wave put into this same bucket
                wave, done = sa[done : head[c]], head[c]
                js = wave[wave > 0] - 1
                js = js[~s[js]]
                if len(js):
                    self._scatter(sa, js, head, 1)
            wave = sa[tail_lms[c] + 1 : self.ends[c]]
            js = wave[wave > 0] - 1
            js = js[~s[js]]
            if len(js):
                self._scatter(sa, js, head, 1)
        tail = self.ends - 1
        for c in range(len(self.ends) - 1, -1, -1):
            done = self.ends[c] - 1
            while done > tail[c]:
                wave, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
                js = wave[wave > 0] - 1
                js = js[s[js]]
                if len(js):
                    self._scatter(sa, js, tail, -1)
            wave = sa[self.heads[c] : head[c]][::-1]
            js = wave[wave > 0] - 1
            js = js[s[js]]
            if len(js):
                self._scatter(sa, js, tail, -1)
        sa[0] = self.n - 1  # the last suffix has no bucket but its own
        return sa

    def names(self, sa: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks of the leftmost-smaller substrings, in text order, and how many differ."""
        is_lms = np.zeros(self.n, bool)
        is_lms[self.lms] = True
        ordered = sa[is_lms[sa]]
        size = np.zeros(self.n, np.int64)
        size[self.lms] = np.diff(np.append(self.lms, self.n - 1)) + 1
        a, b = ordered[:-1], ordered[1:]
        differs = size[a] != size[b]
        open_pairs, k = np.flatnonzero(~differs), 0
        while len(open_pairs):
            x, y = a[open_pairs] + k, b[open_pairs] + k
            same = self.t[x] == self.t[y]
            differs[open_pairs[~same]] = True
            k += 1
            open_pairs = open_pairs[same & (size[a[open_pairs]] > k)]
        rank = np.zeros(self.n, np.int64)
        rank[ordered] = np.concatenate([[0], np.cumsum(differs)])
        return rank[self.lms], int(differs.sum()) + 1


def _list_suffixes(t: list[int], symbols: int) -> list[int]:
    """The same over a list of names whose last one, 0, is unique."""
    n = len(t)
    small = bytearray(n)
    small[-1] = 1
    after, flag = t[-1], 1
    for i in range(n - 2, -1, -1):
        c = t[i]
        if c != after:
            flag = c < after
        small[i] = flag
        after = c
    counts = [0] * symbols
    for c in t:
        counts[c] += 1
    heads, total = [], 0
    for k in counts:
        heads.append(total)
        total += k
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        at = [h + k for h, k in zip(heads, counts)]
        for i in reversed(order):
            c = t[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads[:]
        for i in sa:
            if i > 0 and not small[i - 1]:
                c = t[i - 1]
                sa[at[c]] = i - 1
                at[c] += 1
        at = [h + k for h, k in zip(heads, counts)]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and small[i - 1]:
                c = t[i - 1]
                at[c] -= 1
                sa[at[c]] = i - 1
        sa[0] = n - 1
        return sa

    if n == 1:
        return [0]
    ends = {a: b + 1 for a, b in zip(lms, lms[1:] + [n - 1])}
    name = dict.fromkeys(lms, 0)
    rank, before = -1, None
    for i in induce(lms):
        if i in ends:
            piece = t[i : ends[i]]
            if piece != before:
                rank += 1
                before = piece
            name[i] = rank
    reduced = [name[i] for i in lms]
    if rank + 1 == len(lms):
        order = [0] * len(lms)
        for i, r in zip(lms, reduced):
            order[r] = i
    else:
        order = [lms[k] for k in _list_suffixes(reduced, rank + 1)]
    return induce(order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``: small symbols, of which the last, 0, is unique and least."""
    if len(t) < 2:
        return np.zeros(len(t), np.int64)
    level = _Level(t)
    names, distinct = level.names(level.sort(level.lms))
    if distinct == len(level.lms):
        order = np.empty(distinct, np.int64)
        order[names] = level.lms
    else:
        order = level.lms[np.array(_list_suffixes(names.tolist(), distinct))]
    return level.sort(order)


def common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """In text order, the common prefix of each suffix with the one before it in ``sa``, up to the
    next symbol ``stop`` or the end.

    A prefix is one shorter than that of the suffix one place to the left whenever the two texts
    agree to their left; only the others are compared, all at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    j = before
    fresh = (i == 0) | (j <= 0)
    fresh[1:] |= (t[:-1] != t[np.maximum(j[1:] - 1, 0)]) | (t[:-1] <= stop)
    at = np.flatnonzero(fresh)
    length = np.zeros(n, np.int64)
    live = at[j[at] >= 0]
    k = 0
    while len(live):
        x, y = live + k, j[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = (t[x[ok]] == t[y[ok]]) & (t[x[ok]] > stop)
        live = live[ok]
        length[live] += 1
        k += 1
    source = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(length[source] - (i - source), 0)


def repeated_starts(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece, the places where a ``width``-byte string starts that occurs elsewhere too."""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.int16) + 2
    begins = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
    joined[begins + sizes] = 1
    t = np.append(joined, 0).astype(np.uint16)
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa, 1)[sa]
    long = prefix >= width
    found = np.zeros(len(t), bool)
    found[sa] = long | np.append(long[1:], False)
    return [np.flatnonzero(found[b : b + s]) for b, s in zip(begins, sizes)]
