"""Re-Pair grammars of sequences of token ids: compression with access at any place.

Frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), again and again.
A round replaces all pairs that are at least a ``SHARE``-th as frequent as the most frequent one and
that cannot overlap (no symbol is the left one of one pair and the right one of another); what they
leave is counted anew in the next round.  Rounds end when no pair occurs ``LEAST`` times, or when one
shortens the sequence by less than a ``GAIN``-th.  Pairs are counted in two steps: a table of hashed
counts tells which places may hold a frequent pair, and only those are sorted.

A rule is the pair that its symbol stands for.  With the length of each rule's expansion the symbols
that cover any stretch of ids are found by a binary search, and they alone are expanded.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: A pair becomes a rule if it occurs so often: a rule takes three numbers.
LEAST = 8
SHARE, GAIN = 32, 50
#: Bits of the table of hashed counts.
TABLE_BITS = 18
#: Up to so many symbols a table tells which ones rules have.
MARKED = 1 << 22
MAGIC = b"FMG1"

_U32, _HALF = np.uint32, np.uint64(0xFFFFFFFF)


def _frequent(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs of neighbours, as keys with their counts, and the places that may hold one with their keys."""
    h = (a * _U32(0x9E3779B1) + b * _U32(0x85EBCA6B)) >> _U32(32 - TABLE_BITS)
    table = np.bincount(h, minlength=1 << TABLE_BITS)
    limit = max(LEAST, int(table.max()) // SHARE)
    while True:
        at = np.flatnonzero((table >= limit)[h])
        keys = (a[at].astype(np.uint64) << np.uint64(32)) | b[at]
        row = np.sort(keys)
        first = np.flatnonzero(np.diff(row, prepend=~row[:1]))
        n = np.diff(np.append(first, len(row)))
        enough = n >= limit
        if enough.any() or limit == LEAST:
            return row[first][enough], n[enough], at, keys
        limit = max(LEAST, limit // SHARE)  # several pairs shared a place of the table


def _compatible(pairs: list[int]) -> np.ndarray:
    """Of pairs in order of choice those that cannot overlap an earlier one, sorted."""
    side, out = {}, []
    for key in pairs:
        x, y = key >> 32, key & 0xFFFFFFFF
        if x == y:
            if x not in side:
                side[x] = "both"
                out.append(key)
        elif side.get(x, "left") == "left" and side.get(y, "right") == "right":
            side[x], side[y] = "left", "right"
            out.append(key)
    return np.sort(np.array(out, np.uint64))


def _every_second(places: np.ndarray) -> np.ndarray:
    """In each run of consecutive places the first, third, ..."""
    start = np.concatenate([[True], np.diff(places) != 1])
    return (np.arange(len(places)) - np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))) % 2 == 0


@dataclass
class Grammar:
    """``sequence`` of symbols; symbol ``base + k`` stands for ``left[k], right[k]`` and expands to
    ``lengths[k]`` ids; rules refer to earlier ones and to ids, which are below ``base``."""

    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Grammar:
        sequence = np.array(ids, _U32)
        base = new = int(sequence.max()) + 1 if len(sequence) else 0
        if base > 1 << 31:
            raise ValueError("ids must leave room for symbols: they are below 2**31")
        rules = [np.zeros(0, np.uint64)]
        while len(sequence) > 1:
            pairs, n, at, keys = _frequent(sequence[:-1], sequence[1:])
            if not len(pairs):
                break
            chosen = _compatible(pairs[np.argsort(-n, kind="stable")].tolist())
            if new <= MARKED:  # only where both symbols are those of rules is a rule looked for
                sides = np.zeros((2, new), bool)
                sides[0, (chosen >> np.uint64(32)).astype(_U32)] = sides[1, (chosen & _HALF).astype(_U32)] = True
                likely = np.flatnonzero(sides[0][sequence[at]] & sides[1][sequence[at + 1]])
                at, keys = at[likely], keys[likely]
            rule = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
            hit = chosen[rule] == keys
            at, rule = at[hit], rule[hit]
            twins = np.flatnonzero(sequence[at] == sequence[at + 1])
            if len(twins):
                stays = np.ones(len(at), bool)
                stays[twins] = _every_second(at[twins])
                at, rule = at[stays], rule[stays]
            sequence[at] = new + rule
            kept = np.ones(len(sequence), bool)
            kept[at + 1] = False
            sequence = sequence[kept]
            rules.append(chosen)
            new += len(chosen)
            if len(at) * GAIN < len(sequence):
                break
        rules = np.concatenate(rules)
        out = cls(base, (rules >> np.uint64(32)).astype(_U32), (rules & _HALF).astype(_U32), np.zeros(len(rules), np.int64), sequence)
        for a, b in out._rounds():
            out.lengths[a:b] = out.sizes(out.left[a:b]) + out.sizes(out.right[a:b])
        return out

    def _rounds(self) -> list[tuple[int, int]]:
        """Ranges of rules that refer to earlier ranges only."""
        latest = np.maximum(self.left, self.right).astype(np.int64) - self.base
        edges = [0]
        while edges[-1] < len(latest):
            later = np.flatnonzero(latest[edges[-1] :] >= edges[-1])
            edges.append(edges[-1] + int(later[0]) if len(later) else len(latest))
            if edges[-1] == edges[-2]:
                raise ValueError("a rule refers to itself or a later one")
        return list(zip(edges, edges[1:]))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        rule = symbols.astype(np.int64) - self.base
        out = np.ones(len(symbols), np.int64)
        out[rule >= 0] = self.lengths[rule[rule >= 0]]
        return out

    def ids(self) -> np.ndarray:
        """The whole sequence of ids: each rule is expanded once, then copied."""
        first = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), _U32)

        def copied(symbols: np.ndarray) -> np.ndarray:
            own = np.flatnonzero(symbols >= self.base)
            rule = symbols[own] - self.base
            source, sizes = np.arange(len(flat), len(flat) + len(symbols)), np.ones(len(symbols), np.int64)
            source[own], sizes[own] = first[rule], self.lengths[rule]
            ends = np.cumsum(sizes)
            return np.concatenate([flat, symbols])[np.repeat(source - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

        for a, b in self._rounds():
            flat[first[a] : first[b - 1] + self.lengths[b - 1]] = copied(np.stack([self.left[a:b], self.right[a:b]], axis=1).ravel())
        return copied(self.sequence)

    def slice(self, start: int, size: int, ends: np.ndarray | None = None) -> np.ndarray:
        """``size`` ids from ``start`` on (fewer at the end): only the symbols that cover them are
        expanded, rule by rule.  ``ends`` may be kept from ``np.cumsum(sizes(sequence))``."""
        ends = np.cumsum(self.sizes(self.sequence)) if ends is None else ends
        if size <= 0 or not len(ends) or start >= ends[-1]:
            return np.zeros(0, _U32)
        a, b = np.searchsorted(ends, [start, start + size - 1], side="right")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.sequence[a : b + 1])[skip : skip + size]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that some symbols stand for, one level of rules after another."""
        while (own := symbols >= self.base).any():
            place = np.cumsum(own + 1) - own - 1
            wide = np.empty(len(symbols) + int(own.sum()), _U32)
            wide[place] = symbols
            rule = symbols[own] - self.base
            wide[place[own]], wide[place[own] + 1] = self.left[rule], self.right[rule]
            symbols = wide
        return symbols

    def tobytes(self) -> bytes:
        """Little-endian: magic, ``base``, numbers of rules and of symbols, then left and right symbols
        and lengths of the rules, and the sequence, all unsigned 32-bit."""
        arrays = (self.left, self.right, self.lengths, self.sequence)
        return MAGIC + struct.pack("<III", self.base, len(self.left), len(self.sequence)) + b"".join(a.astype("<u4").tobytes() for a in arrays)

    @classmethod
    def frombytes(cls, raw: bytes) -> Grammar:
        base, rules, n = struct.unpack_from("<III", raw, 4) if raw[:4] == MAGIC and len(raw) >= 16 else (0, 0, -1)
        if len(raw) != 16 + 4 * (3 * rules + n):
            raise ValueError("not a grammar, or not a whole one")
        left, right, lengths, sequence = np.split(np.frombuffer(raw, "<u4", offset=16), [rules, 2 * rules, 3 * rules])
        return cls(base, left, right, lengths.astype(np.int64), sequence)
