"""Quality selection by importance resampling.

Two generative models of hashed word uni- and bigrams, one of target text and one of all raw text,
give each document the log ratio of its probabilities as weight.  Gumbel noise, a hash of the id and
a seed, is added to the weights, and the k largest sums are drawn: a sample without replacement in
proportion to the weights.  Counts cover every document; k follows the share of good labels.

Edge cases: null, empty or blank texts have weight 0; documents without label are raw only; labels
of documents that are not there, null labels and repeated labels are harmless; without target text
all weights come from the raw model alone; rows without id take no part; repeated rows each count;
ties in the sum go to the smaller id; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import cut, ranked
from .words import Words, mixed, slices, windows

BUCKETS = 1 << 16
#: Ids of target documents up to this number (8 MB) are broadcast, so that no other text is shuffled.
FEW_IDS = 1_000_000


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams of some texts, and the text of each."""
    h = w.hashes()
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    pairs = windows(h, 2) if len(h) > 1 else h[:0]
    inside = owner[1:] == owner[:-1]
    grams = np.concatenate([mixed(h), pairs[inside]])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            total += np.bincount(_features(Words(texts, lower=True))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])


def model(texts: DataFrame) -> np.ndarray:
    """Smoothed log probability of each bucket.  Partitions send at most ``BUCKETS`` counts each;
    the driver gets ``BUCKETS`` sums."""
    counts = np.ones(BUCKETS)
    for bucket, n in texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[bucket] += n
    return np.log(counts / counts.sum())


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_weight`` for each row of ``docs``; ``target`` holds the target texts."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratio = model(target.select(F.col(text_col).cast("string"))) - model(rows.select("text"))
    table = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                bucket, owner = _features(Words(texts, lower=True))
                weight = np.bincount(owner, table.value[bucket], minlength=len(texts)).astype(float)  # of integers if empty
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(weight)], names=["doc_id", "log_weight"])

    return rows.mapInArrow(weigh, "doc_id long, log_weight double")


def gumbel_top_k(weighted: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """The ``k`` rows with the largest ``log_weight`` plus Gumbel noise, as ``sampling_key``."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    weighted = cut(weighted, "weights")  # ranges are found by a sample, which would weigh every text once more
    keyed = weighted.withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(unit)))
    return ranked(keyed, [F.desc("sampling_key"), F.col("doc_id")], "place", "gumbel").filter(F.col("place") < k)


def select_quality(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """The sample of ``docs`` whose size is the share of good labels among all labels; the target is
    text labelled good and not toxic."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("good_id")).distinct()
    n_good, n_labels = labels.agg(F.count(F.when(F.col("quality") == 1, 1)), F.count("quality")).first()
    good = F.broadcast(good) if n_good <= FEW_IDS else good.hint("merge")
    target = docs.join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    n = docs.filter(F.col("doc_id").isNotNull()).count()
    k = round(n * n_good / n_labels) if n_labels else n
    return gumbel_top_k(importance(docs, target), k, seed)
