"""Substring dedup: fixed-length word windows, compared by Rabin-Karp hashes and counted in Spark.

A word goes if a window that covers it also starts in a document with a smaller id; windows are
judged on the input.  Sub-windows and whole stretches are hashed where the text is read, windows
themselves only in runs that are opened.  Windows travel as runs with a common anchor (see
``anchors``): a run whose whole stretch starts in an earlier document is settled at once; runs whose
anchor recurs with other stretches are opened into their windows, whose hashes
are grouped for the earliest document.  Windows with an anchor seen once need not move.  All
groupings are partial aggregates followed by joins whose hot keys Spark splits.

A stretch is identified by its anchor and 128 bits of its SHA-256, an opened window by two independent
hashes modulo 2**61 - 1.

Edge cases: a null text has no words; texts shorter than a window lose nothing; within one document
a repeat stays; rows without id take no part; rows that share an id are told apart by a checksum of
their text and never count as earlier than each other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import RUN, covered, digests, run_lists, runs
from .scratch import cut, only
from .words import Words, residue_windows, slices

WINDOW = 50


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _scanner(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 19):
                w = Words(texts)
                owner, start, n, anchor = runs(w.hashes(), w.bounds, window, gram)
                split = [t.split() for t in texts]
                edges = np.cumsum([0, *(w.ends - w.starts + 1)])  # of the words joined by one space
                first = w.bounds[owner] + start
                stretch = digests(b" ".join([x for words in split for x in words]), edges[first], edges[first + n - 1 + window] - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        pa.array([len(x) for x in split], pa.int64()),
                        pa.array([_digest(x) for x in split], pa.binary()),
                        run_lists(len(texts), owner, start, n, anchor, stretch),
                    ],
                    names=["doc_id", "tag", "n_words", "digest", "runs"],
                )

    return scan


def _opener(window: int):
    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts, opened = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                w = Words([texts[k].as_py().encode()])
                first, second = (residue_windows(w.residues(f), window, f) for f in (0, 1))
                places = np.unique(np.concatenate([np.arange(r["p"], r["p"] + r["n"]) for r in opened[k].as_py()]))
                size = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[places].view(np.int64)), pa.array(second[places].view(np.int64)), pa.array(np.full(size, ids[k].as_py())), pa.array(np.full(size, tags[k].as_py())), pa.array(places.astype(np.int32))],
                    names=["a", "b", "doc_id", "tag", "p"],
                )

    return open_runs


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts, settled, single = (batch.column(k) for k in range(5))
            rows = []
            for k in range(batch.num_rows):
                words = texts[k].as_py().encode().split()
                spans = [(r["p"], r["p"] + r["n"] - 1 + window) for r in settled[k].as_py() or []]
                spans += [(p, p + window) for p in single[k].as_py() or []]
                gone = covered(spans, len(words))
                kept = [x for x, g in zip(words, gone) if not g]
                steps = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                rows.append((ids[k].as_py(), tags[k].as_py(), int(gone.sum()), _digest(kept), steps.reshape(-1, 2).tolist(), b" ".join(kept).decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "tag", "n_removed", "digest", "spans", "kept"])

    return remove


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: every document (``doc_id, tag, n_words, digest, whole``: whether nothing of it
    stays), and those that lose a part (``doc_id, tag, n_removed, digest, spans, kept``): the
    maximal removed intervals of words, and the words kept, joined by one space."""
    gram = max(1, window // 3)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = cut(
        rows.mapInArrow(_scanner(window, gram), f"doc_id long, tag long, n_words long, digest binary, runs array<struct<{RUN}>>"),
        "runs",
    )
    records = scanned.select("doc_id", "tag", "n_words", F.explode("runs").alias("r")).select("doc_id", "tag", "n_words", "r.*")
    anchors = records.groupBy("m").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), *(f(c).alias(f"{c}{k}") for c in "st" for k, f in enumerate((F.min, F.max))))
    anchors = anchors.filter("d0 < d1").select("m", F.expr("s0 < s1 or t0 < t1").alias("varied"))
    anchors = cut(anchors, "anchors")  # a table of its own, so that the join's hot keys can be split
    shared = cut(records.join(anchors, "m"), "shared-runs")
    first = cut(shared.groupBy("m", "s", "t").agg(F.min("doc_id").alias("first")), "first-runs")
    judged = shared.join(first, ["m", "s", "t"])
    settled = F.col("first") < F.col("doc_id")
    run = F.struct("p", "n")
    per_doc = judged.groupBy("doc_id", "tag").agg(
        (F.sum(F.when(settled, F.col("n")).otherwise(0)) == F.first("n_words") - (window - 1)).alias("whole"),
        F.collect_list(F.when(settled, run)).alias("settled"),
        F.collect_list(F.when(~settled & F.col("varied"), run)).alias("opened"),
    ).filter("whole or size(settled) > 0 or size(opened) > 0")
    per_doc = cut(per_doc, "judged")
    whole = per_doc.filter("whole").select("doc_id", "tag", "whole").distinct()
    partial = per_doc.filter("not whole").drop("whole")
    tag = F.crc32(F.col("text").cast("binary"))
    part = cut(rows.join(partial.hint("merge"), (rows["doc_id"] == partial["doc_id"]) & (tag == partial["tag"])).select(partial["doc_id"], "tag", "text", "settled", "opened").distinct(), "partial")
    opened = part.filter("size(opened) > 0").select("doc_id", "tag", "text", "opened").mapInArrow(_opener(window), "a long, b long, doc_id long, tag long, p int")
    opened = cut(opened, "windows")
    earliest = opened.groupBy("a", "b").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 < d1").select("a", "b", "d0")
    single = opened.join(cut(earliest, "earliest"), ["a", "b"]).filter("d0 < doc_id").groupBy("doc_id", "tag").agg(F.collect_list("p").alias("single"))
    changed = part.join(single, ["doc_id", "tag"], "left").filter("size(settled) > 0 or single is not null")
    changed = changed.select("doc_id", "tag", "text", "settled", "single").mapInArrow(
        _remover(window), "doc_id long, tag long, n_removed long, digest binary, spans array<array<bigint>>, kept string"
    )
    every = scanned.drop("runs").join(whole, ["doc_id", "tag"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return every, changed


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, digest``: SHA-256 of the kept words joined by one space."""
    return only(lambda: _judged(docs, window, id_col, text_col), "substring-dedup")


def _judged(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    every, changed = repeated_windows(docs, window, id_col, text_col)
    changed = changed.select("doc_id", "tag", "n_removed", F.col("digest").alias("rest"))
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return every.join(changed, ["doc_id", "tag"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("rest", "digest")).alias("digest"),
    )
