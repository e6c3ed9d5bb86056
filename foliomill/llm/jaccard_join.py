"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is its set of distinct word 5-grams.  Sets are grouped into size bands; the scheme of a
band deals the universe of grams into segments by hash, one more than the grams in which two sets
of that band at the threshold can differ, and some to spare.  So two linked sets agree in a whole
segment.  Allocation goes by cost: a segment that is empty would meet everyone, so it is skipped;
all others are indexed as they are; and only a set with too few filled segments also indexes the
one-deletion neighbourhoods of its segments, which count twice in the pigeonhole argument.  Of two
sets with ``f`` and ``g`` filled segments at least one agreement is certain if ``max(f, g) > H``
or both index neighbourhoods and ``f + g > H``; as pairs of two sets with ``f <= H`` may meet neither
condition, all such sets (few but for small ones) share one further key per band.  So no link is missed.
A signature that more than ``COSTLY`` sets hold is skipped in the same way by each set that has
more than ``H`` other filled segments: two sets that agree in it both know that it is costly, so
one of them has too few others, or they agree in another.

Signatures travel as packed arrays, 8 bytes each, and are compared in their bucket; identical sets
are one node from the start.  In a bucket, an exact bound (parities of gram hashes, and sizes)
splits the members of a signature that cannot be linked.  What is left is compared with its most
connected member: a finer exact bound of the same kind, half a byte per gram, drops most pairs that
are no links, and the texts of the others meet at their centre (a busy centre in several places) to
be compared gram by gram.  Members already connected need no more checks, so a group of near copies
costs one pass and not all its pairs.  In further rounds the members outside a group's largest
component are held, in blocks and by their fine sketches, against the others; only pairs that the
bound leaves possible become rows, a number for each member that grows by the round.  Rounds end
when no group holds two components with an unchecked possible pair.

Grams are compared by their hashes modulo 2**61 - 1, sets by 64 bits of the SHA-256 of those hashes.

Edge cases: a text with fewer words than a gram is one gram; null, empty or blank texts have no
gram and are linked with nothing; rows without id take no part; repeated ids are separate rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .components import components
from .scratch import batches_of, cut, only
from .words import Words, give_back, mixed, residue_windows, slices

GRAM = 5
THRESHOLD = 80  # per cent
FLUSH = 1 << 18  # signatures held before they are packed
TEXT_ROWS = 256  # texts that reach Python at once
TEXT_BYTES = 1 << 18  # texts hashed at once, but for longer ones
BATCH_BYTES = 1 << 22  # packed rows leave Python in batches of about this size
BLOCK = 4096  # members of a signature that are compared at once
COSTLY = 32  # holders beyond which a signature is skipped by sets that can do without
BANDS = 64
BUCKET_BYTES = 1 << 25  # text whose signatures share a bucket, at every size of the input
SKETCH_WORDS = 4


def gram_sets(texts: list[bytes], width: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text, after lower-casing A-Z."""
    words = Words(texts, lower=True)
    h = words.residues()
    grams = residue_windows(h, width) if len(h) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(words.bounds, words.bounds[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mixed(residue_windows(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def schemes(size: int, threshold: int) -> tuple[tuple[int, int, int], ...]:
    """``band, segments, H`` of every scheme under which a set of this size is indexed."""
    out, low, band = [], 1, 0
    while low <= size:
        high = max(low, low * 3 // 2 - 1)
        top = high * 100 // threshold
        if size <= top:
            most = (100 - threshold) * (high + top) // (100 + threshold)
            segments = most + 1
            for m in range(most + 1, 2 * most + 3):
                p = 1 - (1 - 1 / m) ** low
                if m * p - 3 * (m * p * (1 - p)) ** 0.5 >= (most + 1) * 1.08 + 1:  # some to spare
                    segments = m
                    break
            else:
                segments = max(1, most * 3 // 2 + 1) if most else 1
            out.append((band, segments, most))
        low, band = high + 1, band + 1
    return tuple(out)


def signatures(grams: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Signatures of one set under its schemes, the band in their lowest bits, and for each band how
    many segments it can do without."""
    out, spare = [], []
    for band, m, most in schemes(len(grams), threshold):
        segment = (mixed(grams) >> np.uint64(20)) % np.uint64(m)
        order = np.argsort(segment, kind="stable")
        segment, values = segment[order], mixed(grams[order] + np.uint64(77))
        first = np.flatnonzero(np.diff(segment, prepend=np.uint64(m)))
        sums = np.add.reduceat(values, first)
        tag = segment[first] + np.uint64((band + 1) << 40)
        made = [mixed(sums + mixed(tag))]
        if len(first) <= most:
            sizes = np.diff(np.append(first, len(grams)))
            rest = np.repeat(sums, sizes) - values
            made.append(mixed(rest + mixed(np.repeat(tag, sizes)))[np.repeat(sizes, sizes) > 1])
            made.append(mixed(np.array([(band + 1) << 50], np.uint64)))
        out += [(x & ~np.uint64(BANDS - 1)) | np.uint64(band % BANDS) for x in made]
        spare.append((band % BANDS, len(first) - most - 1))
    return (np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)), spare


def set_id(grams: np.ndarray) -> np.int64:
    """One number for equal sets, of sorted distinct grams."""
    return np.frombuffer(hashlib.sha256(np.ascontiguousarray(grams, "<u8")).digest()[:8], "<i8")[0]


def sketch(grams: np.ndarray) -> np.ndarray:
    """256 parities; as many bits as differ between two sets, so many grams do at least."""
    count = np.bincount((mixed(grams) >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.packbits((count & 1).astype(np.uint8)).view(np.uint64)


def fine_sketch(grams: np.ndarray) -> bytes:
    """Parities as in ``sketch``, four to eight bits per gram; folds to any smaller power of two."""
    bits = max(64, 1 << int(4 * len(grams) - 1).bit_length())
    place = (mixed(grams + np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many grams are in one of two sets only, from their fine sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


PACKED = (
    "bucket int, sigs binary, counts binary, sets binary, sizes binary, sketches binary, "
    "docs binary, doc_sets binary, doc_sizes binary, doc_sketches array<binary>, spare binary"
)
#: Rows by kind: 0 a document (id, set, size, fine sketch), 1 a member of a group (group, set),
#: 2 what a set can do without (set, band, segments), 3 a member of a costly group (group, set,
#: band), 4 costly signatures of a set (set, band, how many).
GROUPED = "kind int, a long, b long, c long, sketch binary"
GROUP_NAMES = ["kind", "a", "b", "c", "sketch"]


def _rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in (a, b, c)), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=GROUP_NAMES)


def _packer(buckets: int, threshold: int, width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn, seen = TaskContext.get().partitionId(), set()
        docs, doc_sets, doc_sizes, fine, spares, sigs, sets, sizes, sketches = ([] for _ in range(9))
        held = 0

        names = [c.split()[0] for c in PACKED.split(", ")]
        types = [pa.int32(), *[pa.binary()] * 8, pa.list_(pa.binary()), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            own = (np.array(x, "<i8").tobytes() for x in (docs, doc_sets, doc_sizes))
            yield packed([(turn % buckets, b"", b"", b"", b"", b"", *own, list(fine), np.array(spares, "<i8").tobytes())])
            if not sigs:
                return
            flat, owner = np.concatenate(sigs), np.repeat(np.arange(len(sigs), dtype=np.int32), [len(s) for s in sigs])
            bucket = ((flat >> np.uint64(6)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            flat, owner, bucket = flat[order], owner[order], bucket[order]
            ids, ns, bits = np.array(sets, "<i8"), np.array(sizes, "<i4"), np.array(sketches, "<u8").reshape(-1, SKETCH_WORDS)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows, waiting = [], 0
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                who = owner[a:b][first]
                count = np.diff(np.append(first, b - a)).astype("<i4")
                rows.append((int(bucket[a]), flat[a:b].tobytes(), count.tobytes(), ids[who].tobytes(), ns[who].tobytes(), bits[who].tobytes(), b"", b"", b"", None, b""))
                waiting += sum(len(x) for x in rows[-1][1:6])
                if waiting > BATCH_BYTES:
                    yield packed(rows)
                    rows, waiting = [], 0
            if rows:
                yield packed(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column(1), TEXT_BYTES):
                for doc, grams in zip(ids[first:], gram_sets(texts, width)):
                    docs.append(doc)
                    doc_sizes.append(len(grams))
                    doc_sets.append(key := set_id(grams) if len(grams) else np.int64(0))
                    fresh = bool(len(grams)) and key not in seen
                    fine.append(fine_sketch(grams) if fresh else None)
                    if fresh:
                        seen.add(key)
                        made, spare = signatures(grams, threshold)
                        sigs.append(made)
                        spares += [(key, *x) for x in spare]
                        sets.append(key)
                        sizes.append(len(grams))
                        sketches.append(sketch(grams))
                        held += len(sigs[-1])
                if held > FLUSH or len(docs) > 100_000:
                    yield from flush()
                    turn += 1
                    held = 0
                    for x in (docs, doc_sets, doc_sizes, fine, spares, sigs, sets, sizes, sketches):
                        x.clear()
        if docs:
            yield from flush()
        for x in (docs, doc_sets, doc_sizes, fine, spares, sigs, sets, sizes, sketches, seen):
            x.clear()
        give_back()

    return pack


def _split(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Members of a signature in parts that the bounds on size and difference connect."""
    n, size = sizes.astype(np.int64), len(ids)
    near = np.empty((size, size), bool)
    for a in range(0, size, 256):
        part = slice(a, a + 256)
        differ = np.bitwise_count(bits[part, None] ^ bits[None]).sum(2, dtype=np.int64)
        small, large = np.minimum(n[part, None], n[None]), np.maximum(n[part, None], n[None])
        near[part] = (differ * (100 + threshold) <= (100 - threshold) * (small + large)) & (100 * small >= threshold * large)
    parts, left = [], np.ones(size, bool)
    while left.any():
        reached = np.zeros(size, bool)
        wave = np.flatnonzero(left)[:1]
        while len(wave):
            reached[wave] = True
            wave = np.flatnonzero(near[wave].any(0) & ~reached)
        left &= ~reached
        if reached.sum() > 1:
            parts.append(ids[reached])
    return parts


def _grouper(threshold: int):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # signatures, and how many each set has
        entries: list[list[np.ndarray]] = [[], [], []]  # id, size and sketch of those sets
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if len(raw := get["docs"][k].as_py()):
                    cols = [raw, get["doc_sets"][k].as_py(), get["doc_sizes"][k].as_py()]
                    arrays = [pa.array(np.frombuffer(c, "<i8")) for c in cols]
                    fine = pa.array(get["doc_sketches"][k].as_py(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(arrays[0]), np.int32)), *arrays, fine], names=GROUP_NAMES)
                    yield _rows(2, *np.frombuffer(get["spare"][k].as_py(), "<i8").reshape(-1, 3).T)
                else:
                    held.append((np.frombuffer(get["sigs"][k].as_py(), "<u8"), np.frombuffer(get["counts"][k].as_py(), "<i4")))
                    for part, name, kind in zip(entries, ("sets", "sizes", "sketches"), ("<i8", "<i4", "<u8")):
                        part.append(np.frombuffer(get[name][k].as_py(), kind))
        if not held:
            return
        flat = np.concatenate([x for x, _ in held])
        flat.sort()
        repeated = np.unique(flat[1:][flat[1:] == flat[:-1]])
        del flat
        if not len(repeated):
            return
        kept, owners, before = [], [], 0
        for x, count in held:
            hit = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, x), len(repeated) - 1)] == x)
            kept.append(x[hit])
            owners.append(np.repeat(np.arange(before, before + len(count)), count)[hit])
            before += len(count)
        held.clear()
        sigs, drawing = np.concatenate(kept), np.concatenate(owners)
        ids, sizes, drawn = (np.concatenate(x) for x in entries)
        drawn = drawn.reshape(-1, SKETCH_WORDS)
        ids, sizes = ids[drawing], sizes[drawing]
        order = np.lexsort((ids, sigs))
        sigs, ids, sizes, drawing = sigs[order], ids[order], sizes[order], drawing[order]
        new = (np.diff(sigs, prepend=~sigs[:1]) != 0) | (np.diff(ids, prepend=~ids[:1]) != 0)
        sigs, ids, sizes, drawing = sigs[new], ids[new], sizes[new], drawing[new]
        edges = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]))
        ends = np.append(edges[1:], len(sigs))
        costly = ends - edges > COSTLY
        held_by = np.repeat(costly, ends - edges)
        if held_by.any():
            pairs = np.stack([ids[held_by], (sigs[held_by] & np.uint64(BANDS - 1)).astype(np.int64)])
            pairs, count = np.unique(pairs, axis=1, return_counts=True)
            yield _rows(4, pairs[0], pairs[1], count)
        seen, out, waiting = set(), {1: [], 3: []}, 0
        for a, b, dear in zip(edges, ends, costly):
            if b - a < 2:
                continue
            members, band = ids[a:b], int(sigs[a] & np.uint64(BANDS - 1))
            if (whole := (band, members.tobytes())) in seen:
                continue
            seen.add(whole)
            big = b - a > BLOCK  # compared in rounds over the cluster, not here
            for part in [members] if big else _split(members, sizes[a:b], drawn[drawing[a:b]], threshold):
                key = mixed(np.add.reduce(mixed(part.view(np.uint64) + np.uint64(9)), keepdims=True)).view(np.int64)[0]
                if (key, len(part), dear and band) in seen:
                    continue
                seen.add((key, len(part), dear and band))
                out[3 if dear else 1].append((np.full(len(part), key), part, np.full(len(part), band)))
                waiting += len(part)
            if waiting > 1 << 18:
                yield from _members(out)
                out, waiting = {1: [], 3: []}, 0
        yield from _members(out)
        del entries, kept, owners, sigs, ids, sizes, drawing, drawn, order, new, seen, out
        give_back()

    return group


def _members(out: dict[int, list]) -> Iterator[pa.RecordBatch]:
    for kind, parts in out.items():
        if parts:
            yield _rows(kind, *(np.concatenate(x) for x in zip(*parts)))


def _pruner(threshold: int):
    """Pairs that the fine bound and the sizes leave possible."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, x, n, m, a, b = (batch.column(k) for k in range(6))
            good = []
            for k in range(batch.num_rows):
                p, q = n[k].as_py(), m[k].as_py()
                good.append(100 * min(p, q) >= threshold * max(p, q) and least_difference(a[k].as_py(), b[k].as_py()) * (100 + threshold) <= (100 - threshold) * (p + q))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([centre.filter(keep), x.filter(keep)], names=["centre", "id"])

    return prune


def _fold(sketches: list[bytes], size: int) -> np.ndarray:
    """Fine sketches of one length, folded to ``size`` bytes, as rows of 64-bit words."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return np.ascontiguousarray(x).view(np.uint64)


def _possible(few: list[tuple], many: list[tuple], threshold: int) -> np.ndarray:
    """Which pairs of ``few`` and ``many`` (``id, component, n, sketch``) lie in two components and
    may be links by the bounds on size and difference."""
    out = np.zeros((len(few), len(many)), bool)
    n, m = (np.array([r[2] for r in x], np.int64) for x in (few, many))
    of, to = (np.array([r[1] for r in x], np.int64) for x in (few, many))
    lengths, widths = (np.array([len(r[3]) for r in x]) for x in (few, many))
    for length in np.unique(lengths):
        for width in np.unique(widths):
            rows, columns = np.flatnonzero(lengths == length), np.flatnonzero(widths == width)
            least = min(length, width)
            x, y = _fold([few[k][3] for k in rows], least), _fold([many[k][3] for k in columns], least)
            step = max(1, (1 << 22) // y.size)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                differ = np.bitwise_count(x[at : at + step, None] ^ y[None]).sum(2, dtype=np.int64)
                both = n[part, None] + m[None, columns]
                small = np.minimum(n[part, None], m[None, columns])
                good = (differ * (100 + threshold) <= (100 - threshold) * both) & (100 * small >= threshold * (both - small))
                out[np.ix_(part, columns)] = good & (of[part, None] != to[None, columns])
    return out


def _seeker(threshold: int, most: int):
    """For each member outside its group's largest component, the first ``most`` members of other
    components that the fine bound leaves possible; ``more`` tells whether there are others."""

    def found(few: list[tuple], many: list[tuple]) -> pa.RecordBatch:
        u, v, more = [], [], []
        good = _possible(few, many, threshold) if few and many else np.zeros((0, 0), bool)
        for row, partners in zip(few, good):
            at = np.flatnonzero(partners)
            u += [row[0]] * len(at[:most])
            v += [many[k][0] for k in at[:most]]
            more += [len(at) > most] * len(at[:most])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(more, pa.bool_())], names=["centre", "id", "more"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few, many = None, [], []
        for batch in batches:
            for h, by, i, j, few_side, *row in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (unit := (h, by, i, j)) != now:
                    if now is not None:
                        yield found(few, many)
                    now, few, many = unit, [], []
                (few if few_side else many).append(tuple(row))
        if now is not None:
            yield found(few, many)

    return seek


def _verifier(threshold: int, width: int):
    """Links of each centre with the texts that follow it."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            centres, salts, roles, ids = (batch.column(k).to_pylist() for k in range(4))
            out: list[list[int]] = [[], []]
            for first, texts in slices(batch.column(4)):
                for k, grams in enumerate(gram_sets(texts, width), first):
                    if set_id(grams) != ids[k]:  # another text under the same document id
                        continue
                    if roles[k] == 0:
                        at, own = (centres[k], salts[k]), grams
                        continue
                    if at != (centres[k], salts[k]):
                        continue
                    x, y = (own, grams) if len(own) < len(grams) else (grams, own)
                    place = np.searchsorted(y, x)
                    common = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                    if 100 * common >= threshold * (len(x) + len(y) - common):
                        out[0].append(centres[k])
                        out[1].append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v"])
        give_back()

    return verify


#: Texts that meet a centre in one place, and about as many sketches a side that meet in a block.
MEETING = 1000
#: Possible partners for each member in the first round between components.
FIRST_PARTNERS = 16


def _pruned(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Those of ``pairs`` (``centre, id``) that the fine bound leaves possible."""
    side = lambda key, n, s: sketches.select(F.col("id").alias(key), F.col("n").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("centre", "n", "s"), "centre").join(side("id", "m", "t"), "id")
    return cut(both.select("centre", "id", "n", "m", "s", "t").mapInArrow(_pruner(threshold), "centre long, id long"), "possible")


def _sought(members: DataFrame, sketches: DataFrame, threshold: int, most: int) -> DataFrame:
    """``centre, id, more``: possible pairs between components of the groups of ``members`` (``g,
    id, weight, component``), ``most`` for each member outside its group's largest component.

    Groups with the same largest component are compared as one where that takes fewer comparisons
    than one after another.  Sketches meet in blocks of about ``MEETING``, so no task holds a group.
    """
    parts = members.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("g").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").cast("double").alias("all"))
    groups = cut(groups.select("g", F.col("top.component").alias("major"), "all", (F.col("all") - F.col("top.n")).alias("others")), "groups")
    merged = members.join(groups.select("g", "major"), "g").groupBy("major", "id").agg(F.first("component").alias("component"))
    merged = merged.groupBy("major").agg((F.count(F.lit(1)) * F.count_if(F.col("component") != F.col("major")).cast("double")).alias("once"))
    apart = groups.groupBy("major").agg(F.sum(F.col("all") * F.col("others")).alias("apart"))
    whole = merged.join(apart, "major").select("major", (F.col("once") <= F.col("apart")).alias("whole"))
    # Decided for groups, a row each; members, of which a component may have any number, meet that table by their group.
    places = groups.select("g", "major").join(whole, "major")
    places = cut(places.select("g", "major", F.when(F.col("whole"), F.col("major")).otherwise(F.col("g")).alias("h"), F.col("whole").alias("by")), "places")
    dealt = members.join(places, "g").select("h", "by", "id", "weight", "component", "major")
    dealt = cut(dealt.groupBy("h", "by", "id").agg(F.first("weight").alias("weight"), F.first("component").alias("component"), F.first("major").alias("major")), "dealt")
    blocks = dealt.groupBy("h", "by").agg(
        F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("wide"), F.ceil(F.count_if(F.col("component") != F.col("major")) / MEETING).cast("int").alias("high")
    )
    rows = dealt.join(blocks, ["h", "by"]).join(sketches, "id")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("component <> major").select("h", "by", at("high").alias("i"), every("wide").alias("j"), F.lit(True).alias("few"), "weight", "id", "component", "n", "sketch")
    many = rows.filter("high > 0").select("h", "by", every("high").alias("i"), at("wide").alias("j"), F.lit(False).alias("few"), "weight", "id", "component", "n", "sketch")
    units = few.union(many).repartition("h", "by", "i", "j").sortWithinPartitions("h", "by", "i", "j", F.desc("weight"), "id").drop("weight")
    return units.mapInArrow(_seeker(threshold, most), "centre long, id long, more boolean")


def _verified(left: DataFrame, representatives: DataFrame, rows: DataFrame, threshold: int, width: int, first: bool) -> DataFrame:
    """The links among the possible pairs ``left`` (``centre, id``)."""
    places = left.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("places"))
    routes = left.join(places, "centre").select("centre", F.pmod(F.xxhash64("id"), "places").cast("int").alias("salt"), F.lit(1).alias("role"), "id")
    routes = routes.union(places.select("centre", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("centre").alias("id")))
    routes = routes.join(representatives, "id")
    n = left.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "u long, v long")
    # The first round's texts are dealt by id at every size; later rounds are small, and up to a
    # checked size (100,000 pairs of numbers) their texts are met where they are read.
    routes = F.broadcast(routes) if n <= 100_000 and not first else routes.hint("merge")
    met = rows.join(routes, "doc_id").select("centre", "salt", "role", "id", "text")
    met = met.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return cut(met.mapInArrow(_verifier(threshold, width), "u long, v long"), "verified")


def _buckets(rows: DataFrame) -> int:
    """One for each ``BUCKET_BYTES`` of text, whose signatures take about as much; four for each core at least."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(1 << 20, max(4 * rows.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES))


def jaccard_components(
    docs: DataFrame, threshold: int = THRESHOLD, width: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` that has an id."""
    return only(lambda: _components(docs, threshold, width, id_col, text_col), "jaccard-components")


def _components(docs: DataFrame, threshold: int, width: int, id_col: str, text_col: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = _buckets(rows)
    found = (
        rows.mapInArrow(_packer(buckets, threshold, width), PACKED)
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_grouper(threshold), GROUPED)
    )
    with batches_of(spark, TEXT_ROWS):
        found = cut(found, "signature-groups")
    nodes = found.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("id"), F.col("c").alias("n_shingles"))
    spare = found.filter("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("band"), F.col("c").alias("spare")).distinct()
    costs = found.filter("kind = 4").groupBy(F.col("a").alias("id"), F.col("b").alias("band")).agg(F.sum("c").alias("costly"))
    bound = costs.join(spare, ["id", "band"]).filter("costly > spare").select("id", "band")
    dear = found.filter("kind = 3").select(F.col("a").alias("g"), F.col("b").alias("id"), F.col("c").alias("band"))
    members = found.filter("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("id"))
    members = cut(members.union(dear.join(bound, ["id", "band"], "left_semi").select("g", "id")).distinct(), "members")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    weight = members.join(sizes, "g").groupBy("id").agg(F.sum("members").alias("weight"))
    members = cut(members.join(weight, "id").withColumn("component", F.col("id")), "members")
    drawn = found.filter("kind = 0 and sketch is not null").select(F.col("b").alias("id"), F.col("c").alias("n"), "sketch")
    sketches = drawn.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = cut(sketches, "sketches")
    representatives = cut(nodes.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "representatives")
    if members.isEmpty():
        return _finish(nodes, spark.createDataFrame([], "node long, component long"))

    # First, every member meets the most connected one of its group.
    order = Window.partitionBy("g").orderBy(F.desc("weight"), "id")
    centres = members.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    centres = cut(centres.select("g", F.col("id").alias("centre")), "centres")
    pairs = members.join(centres, "g").filter("id <> centre")
    pairs = pairs.groupBy(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).agg(F.first("centre").alias("centre"))
    star = pairs.select("centre", F.when(F.col("centre") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("id"))
    tested = _pruned(star, sketches, threshold)
    links = _verified(tested, representatives, rows, threshold, width, True)
    comps = only(lambda: components(links), "components")
    left = cut(members.join(centres.select("g", F.col("centre").alias("id")), ["g", "id"], "left_anti").select("g", "id", "weight"), "left")

    # Then what is possible between the components of a group, ever more for each member.
    most, more = FIRST_PARTNERS, True
    while more:
        state = left.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = state.groupBy("g").agg(F.min("component").alias("least"), F.max("component").alias("last")).filter("least <> last").select("g")
        state = cut(state.join(split, "g", "left_semi"), "members")
        sought = cut(_sought(state, sketches, threshold, most), "sought")
        more = not sought.filter("more").isEmpty()
        known = tested.select(F.least("centre", "id").alias("u"), F.greatest("centre", "id").alias("v"))
        pairs = sought.groupBy(F.least("centre", "id").alias("u"), F.greatest("centre", "id").alias("v")).agg(F.first("centre").alias("centre"))
        pairs = pairs.join(known, ["u", "v"], "left_anti")
        pairs = cut(pairs.select("centre", F.when(F.col("centre") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("id")), "pairs")
        fresh = _verified(pairs, representatives, rows, threshold, width, False)
        tested = tested.union(pairs)
        if not fresh.isEmpty():
            links = links.union(fresh)
            comps = only(lambda links=links: components(links), "components")
        most *= 16
    return _finish(nodes, comps)


def _finish(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Least document of each component, for every row."""
    named = nodes.filter("n_shingles > 0").join(comps, F.col("id") == F.col("node"), "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = nodes.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id").union(empty)
