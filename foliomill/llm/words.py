"""Words of UTF-8 texts and their hashes, for a slice of documents at a time.

``hashes`` and ``windows`` are polynomials modulo 2**64, for which some pairs of strings agree whatever
the base: they choose anchors and buckets, never decide that two strings are equal.  Where equality
counts, ``residues`` and ``residue_windows`` are polynomials modulo the prime 2**61 - 1, for which two
strings of n symbols agree for at most n of all bases.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = (_odd(11, 256), _odd(12, 256))
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

PRIME = (1 << 61) - 1
_PRIME, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << n) - 1) for n in (61, 30, 31, 32))
#: Bases modulo the prime: of letters and of words, for each of two families.
_LETTERS, _WORDS = np.random.default_rng(13).integers(1 << 32, PRIME, (2, 2)).tolist()
#: Numbers that are multiplied at once, so that what lies between stays in the cache.
_AT_ONCE = 1 << 14


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a Python worker for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def residue(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return x - _PRIME * (x >= _PRIME)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of residues; halves of 30 and 31 bits, so that nothing overflows."""
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(a), _AT_ONCE):
        x, y = a[at : at + _AT_ONCE], b[at : at + _AT_ONCE]
        xh, xl, yh, yl = x >> np.uint64(31), x & _LOW31, y >> np.uint64(31), y & _LOW31
        mid = xh * yl + xl * yh
        out[at : at + _AT_ONCE] = residue(((xh * yh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + xl * yl)
    return out


def _times(x: np.ndarray, bits: int) -> np.ndarray:
    """x * 2**bits modulo the prime, of residues: a rotation."""
    return ((x << np.uint64(bits)) & _PRIME) | (x >> np.uint64(61 - bits))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, product(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
    return out


def residue_powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo the prime."""
    size = 1 << max(8, (n - 1).bit_length())
    return (_powers if size <= SLICE_BYTES else _powers.__wrapped__)(base, size)[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in runs of about ``limit`` bytes; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for at, value in enumerate(texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = at + 1, [], 0
    if held:
        yield first, held


class Words:
    """Words of some texts in one row: ``starts`` and ``ends`` in ``data``, ``counts`` per text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
        self.data = _LOWER[data] if lower else data
        gap = _SEPARATOR[self.data]
        edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        self.starts, self.ends = edges[::2], edges[1::2]
        places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, places)
        self.counts = np.diff(self.bounds)

    def hashes(self, family: int = 0) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        letters = self.data[~_SEPARATOR[self.data]]
        place = np.arange(len(letters)) - np.repeat(first, size)
        terms = _BYTE[family][letters] * powers(_BASE[family], int(size.max()))[place]
        return mixed(np.add.reduceat(terms, first) + size.astype(np.uint64))

    def residues(self, family: int = 0) -> np.ndarray:
        """Hashes of the words modulo the prime: the words as numbers to a base, without leading zeros."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        letters = self.data[~_SEPARATOR[self.data]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(first, size)
        up = residue_powers(_LETTERS[family], int(size.max()))
        if size.max() >= 1 << 22:  # sums of halves of residues; of products with letters they might overflow
            terms = product(letters, up[place])
            low, high, bits = terms & _LOW32, terms >> np.uint64(32), 32
        else:
            low, high, bits = letters * (up & _LOW31)[place], letters * (up >> np.uint64(31))[place], 31
        return residue(residue(np.add.reduceat(low, first)) + _times(residue(np.add.reduceat(high, first)), bits))


def residue_windows(residues: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Rabin-Karp hashes modulo the prime of ``width`` consecutive residues, for each start in the
    row, spread over 64 bits."""
    n = len(residues) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _WORDS[family]
    terms = product(residues, residue_powers(base, len(residues)))
    low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms & _LOW32, terms >> np.uint64(32)))
    sums = residue(residue(low[width:] - low[:n]) + _times(residue(high[width:] - high[:n]), 32))
    return mixed(product(sums, residue_powers(pow(base, -1, PRIME), n)))


def windows(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of ``width`` consecutive numbers, for each start in the row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[1 - family]
    up = powers(base, len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    down = powers(pow(base, -1, 1 << 64), n)
    return mixed((sums[width:] - sums[:n]) * down)
