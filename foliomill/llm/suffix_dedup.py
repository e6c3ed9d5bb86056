"""Suffix-array dedup: every byte covered by a 400-byte string that also starts elsewhere goes.

Texts are read once as bytes; their 400-byte windows travel as runs with a common anchor (see
``anchors``).  A run whose whole stretch occurs twice (by 128 bits of SHA-256) is settled.  Where an anchor recurs with
different stretches, one copy of each stretch goes to the anchor's shard; a shard sorts its suffixes
by induced sorting (see ``suffix_array``) and the permuted common prefixes tell which of its windows
recur.  A group always lies whole in one shard, so no match is lost between shards.

An anchor with more than ``HOT`` different stretches would not fit a shard.  Its stretches are
divided again by a second anchor, the least of longer sub-windows under another hash: equal windows
share that anchor, too, so they stay together, and what recurs whole is settled as before.  Groups
that are still too large are divided by ever longer sub-windows; at the length of a window itself all
windows of a group are equal, so this ends after four steps at most.  What has to be compared is
always judged by a suffix array.

Edge cases: a null text is empty; texts shorter than a window lose nothing; all copies of a string
go, the first too; repeated rows are copies of each other; rows without id take no part; rows that
share an id are told apart by a checksum of their text; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import RUN, covered, digests, run_lists, runs
from .scratch import batches_of, cut, only
from .suffix_array import repeated_starts
from .words import _BYTE, give_back, mixed, slices

WIDTH = 400
#: Different stretches (of less than two windows each) that a group may hold in a shard.
HOT = 2000
SHARD_BYTES = 1 << 19
#: Stretches that a task sorts, so that its time doesn't grow with the input; tasks at most.
TASK_BYTES, MOST_TASKS = 1 << 22, 1 << 17


def _symbols(texts: list[bytes], family: int = 0) -> np.ndarray:
    return _BYTE[family][np.frombuffer(b"".join(texts), np.uint8)]


def _scanner(width: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 18):
                bounds = np.cumsum([0, *map(len, texts)])
                owner, start, n, anchor = runs(_symbols(texts), bounds, width, gram)
                first = bounds[owner] + start
                stretch = digests(b"".join(texts), first, first + n - 1 + width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                        run_lists(len(texts), owner, start, n, anchor, stretch),
                    ],
                    names=["doc_id", "tag", "n_bytes", "digest", "runs"],
                )

    return scan


def _stretches(width: int, hot: bool):
    """One row per stretch of an anchor that is ``hot``, or is not."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "doc_id", "tag", "p", "bytes"]
        for batch in batches:
            ids, tags, texts, opened = (batch.column(k) for k in range(4))
            out = []
            for k in range(batch.num_rows):
                raw = texts[k].as_py()
                out += [(r["m"], ids[k].as_py(), tags[k].as_py(), r["p"], raw[r["p"] : r["p"] + r["n"] + width - 1]) for r in opened[k].as_py() if r["hot"] == hot]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return cut_out


def _shards(width: int):
    """Runs of recurring windows, from stretches sorted by anchor."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (_, doc, tag, p, _), found in zip(held, repeated_starts([h[4] for h in held], width)):
            steps = np.flatnonzero(np.diff(found, prepend=-2) != 1)
            for a, b in zip(steps, [*steps[1:], len(found)]):
                rows.append((doc, tag, p + int(found[a]), int(b - a)))
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "tag", "p", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if size >= SHARD_BYTES and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield solve(held)
        held = []
        give_back()

    return sort


def _divider(width: int, gram: int):
    """The runs of each stretch by its group and its least sub-window of length ``gram``."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, raw in slices(whole.column(4), 1 << 18):
                batch = whole.slice(at, len(raw))
                bounds = np.cumsum([0, *map(len, raw)])
                owner, start, n, anchor = runs(_symbols(raw, 1), bounds, width, gram)
                stretch = digests(b"".join(raw), bounds[owner] + start, bounds[owner] + start + n - 1 + width)
                groups = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)[owner]
                pieces = [raw[k][a : a + b + width - 1] for k, a, b in zip(owner, start, n)]
                places = (batch.column(3).to_numpy()[owner] + start).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mixed(anchor + mixed(groups)).view(np.int64)), *(pa.array(np.ascontiguousarray(stretch[:, k])) for k in (0, 1)), *(batch.column(c).take(pa.array(owner)) for c in (1, 2)),
                        pa.array(places), pa.array(n.astype(np.int32)), pa.array(pieces, pa.binary()),
                    ],
                    names=["g", "s", "t", "doc_id", "tag", "p", "n", "bytes"],
                )
        give_back()

    return divide


def _divided(pieces: DataFrame, width: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """Of the stretches ``g, doc_id, tag, p, bytes`` of large groups: those of groups that fit a
    shard, and runs that are settled (``doc_id, tag, p, n``)."""
    light, settled, step = [], [], 1
    while True:
        step = min(step + 1, -(-width // gram))
        parts = cut(pieces.mapInArrow(_divider(width, min(width, gram * step)), "g long, s long, t long, doc_id long, tag long, p int, n int, bytes binary"), "divided")
        here = F.struct("doc_id", "tag", "p")
        kinds = cut(parts.groupBy("g", "s", "t").agg(F.count(F.lit(1)).alias("copies"), F.min(here).alias("chosen")), "kinds")
        groups = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"))
        groups = cut(groups.filter("kinds > 1").select("g", (F.col("kinds") > HOT).alias("large")), "large-groups")
        settled.append(parts.join(kinds.filter("copies > 1"), ["g", "s", "t"]).select("doc_id", "tag", "p", "n"))
        open_ = parts.join(kinds, ["g", "s", "t"]).filter(here == F.col("chosen")).join(groups, "g").select("g", "doc_id", "tag", "p", "bytes", "large")
        light.append(open_.filter("not large").drop("large"))
        if groups.filter("large").isEmpty():
            return reduce(DataFrame.union, light), settled
        pieces = open_.filter("large").drop("large")


def _remover(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts, settled, found = (batch.column(k) for k in range(5))
            rows = []
            for k in range(batch.num_rows):
                raw = texts[k].as_py()
                places = [r for c in (settled, found) for r in c[k].as_py() or []]
                gone = covered([(r["p"], r["p"] + r["n"] - 1 + width) for r in places], len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                steps = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                rows.append((ids[k].as_py(), tags[k].as_py(), int(gone.sum()), steps.tolist(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "tag", "n_removed", "spans", "kept"])

    return remove


def repeated_bytes(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: every document (``doc_id, tag, n_bytes, digest, whole``: whether nothing of it
    stays), and those that lose a part (``doc_id, tag, n_removed, spans, kept``): the maximal
    removed runs of bytes, and the bytes that stay."""
    gram = max(1, width // 4)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    scanned = cut(
        rows.mapInArrow(_scanner(width, gram), f"doc_id long, tag long, n_bytes long, digest binary, runs array<struct<{RUN}>>"),
        "byte-runs",
    )
    records = scanned.select("doc_id", "tag", "n_bytes", F.explode("runs").alias("r")).select("doc_id", "tag", "n_bytes", "r.*")
    anchors = records.groupBy("m").agg(F.count(F.lit(1)).alias("c"), *(f(c).alias(f"{c}{k}") for c in "st" for k, f in enumerate((F.min, F.max))))
    anchors = anchors.filter("c > 1").select("m", F.expr("s0 < s1 or t0 < t1").alias("varied"))
    anchors = cut(anchors, "byte-anchors")  # a table of its own, so that the join's hot keys can be split
    shared = cut(records.join(anchors, "m"), "shared-byte-runs")
    here = F.struct("doc_id", "tag", "p")
    kinds = shared.groupBy("m", "s", "t").agg(F.count(F.lit(1)).alias("copies"), F.min(here).alias("chosen"))
    kinds = cut(kinds, "stretches")
    hot = cut(kinds.groupBy("m").agg((F.count(F.lit(1)) > HOT).alias("hot")).filter("hot"), "hot-anchors")
    judged = shared.join(kinds, ["m", "s", "t"]).join(hot, "m", "left")
    settled = F.col("copies") > 1
    opened = F.col("varied") & (here == F.col("chosen"))
    per_doc = judged.groupBy("doc_id", "tag").agg(
        (F.sum(F.when(settled, F.col("n")).otherwise(0)) == F.first("n_bytes") - (width - 1)).alias("whole"),
        F.collect_list(F.when(settled, F.struct("p", "n"))).alias("settled"),
        F.collect_list(F.when(opened, F.struct("m", "p", "n", F.coalesce("hot", F.lit(False)).alias("hot")))).alias("opened"),
    )
    per_doc = cut(per_doc, "byte-judged")
    size = per_doc.agg(F.sum(F.aggregate("opened", F.lit(0).cast("long"), lambda a, r: a + r["n"] + (width - 1)))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-size // TASK_BYTES)))
    partial = per_doc.filter("size(opened) > 0 or (not whole and size(settled) > 0)")
    part = cut(rows.join(partial.hint("merge"), (rows["doc_id"] == partial["doc_id"]) & (F.crc32("text") == partial["tag"])).select(partial["doc_id"], "tag", "text", "whole", "settled", "opened").distinct(), "byte-partial")
    need = part.filter("size(opened) > 0").select("doc_id", "tag", "text", "opened")
    cut_out = lambda large: need.mapInArrow(_stretches(width, large), "g long, doc_id long, tag long, p int, bytes binary")
    pieces, more = cut_out(False), []
    if not hot.isEmpty():
        with batches_of(docs.sparkSession):
            light, more = _divided(cut(cut_out(True), "large-stretches"), width, gram)  # a table, so that no task runs both Python steps
        pieces = pieces.union(light)
    found = pieces.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(_shards(width), "doc_id long, tag long, p int, n int")
    found = reduce(DataFrame.union, more, found)
    found = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("p", "n")).alias("found"))
    changed = part.filter("not whole").join(found, ["doc_id", "tag"], "left").filter("size(settled) > 0 or found is not null")
    changed = changed.select("doc_id", "tag", "text", "settled", "found").mapInArrow(
        _remover(width), "doc_id long, tag long, n_removed long, spans array<array<bigint>>, kept binary"
    )
    whole = per_doc.filter("whole").select("doc_id", "tag", "whole")
    every = scanned.drop("runs").join(whole, ["doc_id", "tag"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return every, changed


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, digest``: SHA-256 of the bytes that stay."""
    return only(lambda: _judged(docs, width, id_col, text_col), "suffix-dedup")


def _judged(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    every, changed = repeated_bytes(docs, width, id_col, text_col)
    changed = changed.select("doc_id", "tag", "n_removed", F.size("spans").alias("spans"), F.unhex(F.sha2("kept", 256)).alias("rest"))
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    whole = F.col("whole")
    return every.join(changed, ["doc_id", "tag"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("rest", "digest")).alias("digest"),
    )
