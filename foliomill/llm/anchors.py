"""Anchors: a lossless way to bring equal windows together without moving every window.

Of the ``gram``-long sub-windows of a window the one with the least Rabin-Karp hash, leftmost of
several, is its anchor.  Equal windows have equal anchors at equal offsets, so a window whose anchor
occurs once in the corpus occurs once.  Neighbouring windows mostly share their anchor; such a run
of windows is one record, with a digest of the whole stretch that its windows cover.  Two windows of
one record are never equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .words import windows

#: A run of windows: anchor, digest of the stretch (128 bits), first place, number of windows.
RUN = "m: long, s: long, t: long, p: int, n: int"
_RUN = pa.struct([("m", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("p", pa.int32()), ("n", pa.int32())])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values, for each start."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of ``data[start:end]``, in each row two halves of the first 128 bits of SHA-256."""
    view = memoryview(data)
    raw = b"".join([hashlib.sha256(view[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def run_lists(texts: int, owner: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, digest: np.ndarray) -> pa.Array:
    """The runs of each of so many texts."""
    columns = [anchor.view(np.int64), digest[:, 0], digest[:, 1], start.astype(np.int32), n.astype(np.int32)]
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)), flat)


def runs(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: ``text, start, windows, anchor``.

    ``symbols`` are the hashed symbols of several texts in a row, ``bounds`` where each begins (and
    the last ends); starts count from the text's own first symbol.
    """
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    n = len(symbols) - width + 1
    if n <= 0:
        return nothing
    grams = windows(symbols, gram)
    low = np.uint64(0xFFFFFFFF)
    place = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1) & low
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + width <= bounds[1:][text]
    before = np.concatenate([[False], inside[:-1] & (place[1:] == place[:-1])])
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return nothing
    ends = np.flatnonzero(inside & ~np.concatenate([before[1:] & inside[1:], [False]])) + 1
    owner = text[first]
    return owner, first - bounds[owner], ends - first, grams[place[first].astype(np.int64)]


def covered(intervals: list[tuple[int, int]], size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the half-open intervals."""
    steps = np.zeros(size + 1, np.int64)
    for a, b in intervals:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps)[:size] > 0
