"""Hard negatives: rows of other labels that come close to an anchor's positives, by inner product.

Candidates are sorted by norm, longest first, and cut into buckets of a bounded number of bytes; runs of
``LANE_BUCKETS`` buckets are lanes.  Anchors are cut into blocks in the same way.  A task holds one lane
and takes a bounded number of blocks through it, bucket by bucket.  By Cauchy and Schwarz no score in a
bucket exceeds the anchor's norm times the bucket's largest; a bucket is left out for every search whose
lower limit, or whose k-th best score so far, is above that, and a lane isn't sent blocks of which it can
serve no search.

First each anchor's positives are sought, the best rows of its own label: in the lane of the longest
vectors, then in the others with the k-th score found there as lower limit.  Each positive then opens a
window of scores, and the best rows of other labels in that window are sought; its lower limit is known
from the start.

Vectors are of whole numbers and scored in double precision, exact up to 2**53; larger scores are rounded
and kept within the range of a long.  Labels are whole numbers.

Edge cases: rows without id or label, and vectors that are null, empty or hold null or non-finite
numbers, take no part; only vectors of equal length are compared; rows that share an anchor's id are its
own; repeated rows are candidates, and anchors, of their own; ties go to the smaller id; windows that no
whole number lies in, as of positives with negative scores, give nothing; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import batches_of, cut, numbered, only
from .topk_search import quantised
from .words import give_back

BUCKET_BYTES, BLOCK_BYTES = 1 << 21, 1 << 19
LANE_BUCKETS, GROUP_BLOCKS = 16, 16
#: Searches that are compared with a bucket at once.
AT_ONCE = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: What rounding may take from a norm.
SLACK = 1 + 1e-9

_PACKED = "width int, ids array<long>, labels array<long>, norms array<double>, vectors binary"
_WORK = ["lane", "grp", "kind", "place", "width", "ids", "labels", "norms", "vectors", "searches"]
_SEARCH = ("who", "slot", "low", "high")


def _packer(size: int):
    """Rows ``vec_id, label, v``, in order, packed into about ``size`` bytes of vectors of one length."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids, labels, v = zip(*rows)
        v = np.array(v, "<f8")
        columns = [v.shape[1], ids, labels, np.sqrt(np.einsum("ij,ij->i", v, v)), v.tobytes()]
        types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3))):
                width = len(row[2])
                if held and (len(held[0][2]) != width or (len(held) + 1) * 8 * width > size):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return pack


class Best:
    """The ``k`` best candidates of each of ``n`` searches so far: by score, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.found = k, np.full((n, k), -np.inf), np.full((n, k), MOST)

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of ascending ``ids`` for the searches ``who``; -inf is no candidate."""
        k, width = self.k, scores.shape[1]
        least = self.score[who, -1]
        if width > k:
            least = np.maximum(least, np.partition(scores, width - k, axis=1)[:, width - k])
        good = (scores >= least[:, None]) & (scores > -np.inf)
        if good.sum() > 4 * k * len(who):  # of many equal scores the first ids are enough
            tied = scores == least[:, None]
            good &= ~(tied & (np.cumsum(tied, axis=1) > k))
        row, col = np.nonzero(good)
        if not len(row):
            return
        touched = np.unique(row)
        q = np.concatenate([row, np.repeat(touched, k)])
        s = np.concatenate([scores[row, col], self.score[who[touched]].ravel()])
        i = np.concatenate([ids[col], self.found[who[touched]].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        take = np.flatnonzero(np.diff(q, prepend=-1))[:, None] + np.arange(k)
        self.score[who[touched]], self.found[who[touched]] = s[take], i[take]


class Bucket:
    """Vectors of about one norm, by ascending id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors, self.top = ids[order], labels[order], vectors[order], norms.max() * SLACK


class Block:
    """Anchors with their searches: of each the anchor's place, a number, and the scores it allows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray, searches: tuple[np.ndarray, ...]):
        self.ids, self.labels, self.norms, self.vectors = ids, labels, norms, vectors
        self.who, self.slot, low, high = searches
        self.low, self.high = np.where(low == LEAST, -np.inf, low), np.where(high == MOST, np.inf, high)

    def search(self, buckets: list[Bucket], k: int, own_label: bool) -> Best:
        best = Best(len(self.who), k)
        self.visited = 0  # searches that met a bucket
        for b in buckets:
            bound = self.norms[self.who] * b.top
            live = np.flatnonzero(~(bound < np.maximum(self.low, best.score[:, -1])))
            self.visited += len(live)
            for at in range(0, len(live), AT_ONCE):
                part = live[at : at + AT_ONCE]
                anchors, own = np.unique(self.who[part], return_inverse=True)
                scores = self.vectors[anchors] @ b.vectors.T
                allowed = (self.labels[anchors][:, None] == b.labels[None]) == own_label
                allowed &= self.ids[anchors][:, None] != b.ids[None]
                scores[~allowed] = -np.inf
                scores = scores[own]
                scores[~((scores >= self.low[part, None]) & (scores <= self.high[part, None]))] = -np.inf
                best.offer(part, scores, b.ids)
        return best


def _searcher(k: int, own_label: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buckets = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n] for c, name in enumerate(batch.schema.names)}
                if (key := (row["lane"].as_py(), row["grp"].as_py())) != now:
                    now, buckets = key, []
                width = row["width"].as_py()
                packed = [row[c].values.to_numpy() for c in ("ids", "labels", "norms")]
                packed.append(np.frombuffer(row["vectors"].as_py(), "<f8").reshape(-1, width))
                if row["kind"].as_py() == 0:  # before the blocks of its lane and group
                    buckets.append(Bucket(*packed))
                    continue
                block = Block(*packed, tuple(row["searches"].values.field(c).to_numpy() for c in _SEARCH))
                best = block.search([b for b in buckets if b.vectors.shape[1] == width], k, own_label)
                s, place = np.nonzero(best.score > -np.inf)
                score = np.clip(best.score[s, place], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                columns = [np.full(len(s), row["place"].as_py()), block.who[s], block.slot[s], best.found[s, place], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "who", "slot", "vec_id", "score"])
        buckets.clear()
        give_back()

    return search


def _packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` by length and falling norm, packed, with ``place`` (0, 1, 2, ...); and their number."""
    order = [F.size("v"), F.desc("norm"), F.col("vec_id")]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "v")
    table = cut(made.mapInArrow(_packer(size), _PACKED).withColumn("at", F.monotonically_increasing_id()), name)
    return numbered(table, "at", "place"), table.count()


def _found(blocks: DataFrame, buckets: DataFrame, lanes: DataFrame, n_lanes: int, searches: DataFrame, k: int, own_label: bool, which: Column) -> DataFrame:
    """``block, who, slot, vec_id, score``: the best of each lane that ``which`` names for ``searches``
    (``block, who, slot, low, high, norm``, the anchor's)."""
    packed = searches.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct(*_SEARCH))).alias("searches"),  # of one block, so few
        F.min(F.when(F.col("norm") > 0, F.col("low") / F.col("norm")).otherwise(F.when(F.col("low") > 0, F.lit(float("inf"))).otherwise(0.0))).alias("least"),
    )
    asked = cut(blocks.join(packed, F.col("place") == F.col("block")).drop("block"), "asked")
    meets = asked.select("place", "least", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_lanes - 1)))).alias("lane")).join(lanes.filter(which), "lane")
    meets = meets.filter(F.col("lane_top") * SLACK >= F.col("least")).select("place", "lane", F.floor(F.col("place") / GROUP_BLOCKS).alias("grp"))
    meets = cut(meets, "meetings")  # a row for a lane and a block, no vectors
    rows = asked.drop("least").join(meets, "place").withColumn("kind", F.lit(1)).select(*_WORK)
    served = buckets.join(meets.select("lane", "grp").distinct(), "lane").withColumns({"kind": F.lit(0), "searches": F.lit(None).cast(dict(packed.dtypes)["searches"])}).select(*_WORK)
    keys = ["lane", "grp"]
    work = served.union(rows).repartition(*keys).sortWithinPartitions(*keys, "kind", "place")
    with batches_of(blocks.sparkSession, 4):
        return cut(work.mapInArrow(_searcher(k, own_label), "block long, who long, slot long, vec_id long, score long"), "found")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and
    each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels that
    score from ``low`` to ``high`` per cent of the positive."""
    return only(lambda: _mined(vectors, is_anchor, label, positives, negatives, low, high, id_col, vector_col), "hard-negatives")


def _mined(vectors: DataFrame, is_anchor: Column, label: Column, positives: int, negatives: int, low: int, high: int, id_col: str, vector_col: str) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), is_anchor.alias("anchor"), quantised(F.col(vector_col)).alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    buckets, n_buckets = _packed(rows, BUCKET_BYTES, "buckets")
    blocks, n_blocks = _packed(rows.filter("anchor"), BLOCK_BYTES, "blocks")
    groups = max(1, -(-n_blocks // GROUP_BLOCKS))
    a_lane = max(1, min(LANE_BUCKETS, n_buckets * groups // (2 * spark.sparkContext.defaultParallelism)))
    buckets = buckets.withColumn("lane", F.floor(F.col("place") / a_lane).cast("int"))
    n_lanes = -(-n_buckets // a_lane)
    lanes = buckets.groupBy("lane", "width").agg(F.max(F.array_max("norms")).alias("lane_top"))
    first = lanes.groupBy("width").agg(F.min("lane").alias("first"))  # the longest vectors of each length
    lanes = lanes.join(first, "width").groupBy("lane").agg(F.max("lane_top").alias("lane_top"), F.max(F.col("lane") == F.col("first")).alias("longest"))
    lanes = cut(lanes, "lanes")

    anchors = blocks.select(F.col("place").alias("block"), F.posexplode(F.arrays_zip("ids", "norms")).alias("who", "x"))
    anchors = cut(anchors.select("block", F.col("who").cast("long").alias("who"), F.col("x.ids").alias("anchor_id"), F.col("x.norms").alias("norm")), "anchors")
    norms = anchors.drop("anchor_id")
    nothing = {"slot": F.lit(0).cast("long"), "low": F.lit(LEAST), "high": F.lit(MOST)}
    start = _found(blocks, buckets, lanes, n_lanes, norms.withColumns(nothing), positives, True, F.col("longest"))
    by = Window.partitionBy("block", "who").orderBy(F.desc("score"), "vec_id")
    kth = start.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") == positives).select("block", "who", F.col("score").alias("low"))
    later = norms.join(kth, ["block", "who"], "left").withColumns({"slot": F.lit(0).cast("long"), "low": F.coalesce("low", F.lit(LEAST)), "high": F.lit(MOST)})
    rest = _found(blocks, buckets, lanes, n_lanes, later, positives, True, ~F.col("longest"))
    chosen = start.union(rest).withColumn("slot", F.row_number().over(by).cast("long")).filter(F.col("slot") <= positives)
    chosen = cut(chosen.select("block", "who", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    whole, over = F.expr("positive_score div 100"), F.col("positive_score") % 100  # so that no product leaves the range of a long
    windows = chosen.filter("positive_score >= 0").select(
        "block", "who", "slot", (whole * low + F.ceil(over * low / 100)).alias("low"), (whole * high + F.floor(over * high / 100)).alias("high")
    ).filter("low <= high")
    found = _found(blocks, buckets, lanes, n_lanes, windows.join(norms, ["block", "who"]), negatives, False, F.lit(True))
    by = Window.partitionBy("block", "who", "slot").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    out = found.join(chosen, ["block", "who", "slot"]).join(anchors.drop("norm"), ["block", "who"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
