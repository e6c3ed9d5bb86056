"""Exact top-k inner product search with KD-trees per shard.

Vectors are packed where they are read into shards of a bounded number of rows, dealt to lanes of a
bounded number of shards; queries, a stated subset, into blocks.  A block meets a lane in one task: its
queries come first, once, then the lane's shards, one at a time.  A shard becomes a KD-tree by median
splits of the widest dimension, with the tight bounding box of each leaf.  For a query, the largest
inner product that a box allows bounds its leaf; leaves are visited best first until the bound falls
below the query's k-th score, which is carried on from shard to shard of a lane.  Lanes are merged by a
window over k rows per query and lane.

Vectors are of whole numbers and scored in double precision, which is exact up to 2**53.  Components
or scores beyond the range of a long are taken as its limits.

Edge cases: vectors that are null, empty or hold null or non-finite numbers take no part; rows
without id neither; only vectors of equal length are compared; rows that share the query's id are
its own; ties go to the smaller id; repeated candidate rows are separate candidates; fewer than k
candidates give as many rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF_ROWS = 256
#: Shards that a task goes through for a block, at every number of rows.
LANE_SHARDS = 32


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component as double; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: ids and vectors of up to ``SHARD_ROWS`` rows of one length."""
    held: dict[int, list] = {}

    def emit(width: int) -> pa.RecordBatch:
        ids, vectors = zip(*held.pop(width))
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array(vectors, "<f8").tobytes()])], names=["width", "ids", "vectors"]
        )

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(len(v), []).append((i, v))
            if len(held[len(v)]) == SHARD_ROWS:
                yield emit(len(v))
    for width in list(held):
        yield emit(width)


def kd_leaves(vectors: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows of each leaf of a KD-tree: the widest dimension of a node is split at its median."""
    open_nodes, leaves = [np.arange(len(vectors))], []
    while open_nodes:
        node = open_nodes.pop()
        spread = np.ptp(vectors[node], axis=0)
        if len(node) <= rows or not spread.any():
            leaves += [node[a : a + rows] for a in range(0, len(node), rows)]
            continue
        half = len(node) // 2
        order = np.argpartition(vectors[node, spread.argmax()], half)
        open_nodes += [node[order[:half]], node[order[half:]]]
    return leaves


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[who] @ vectors.T
        row, col = np.nonzero((scores >= self.score[who, -1:]) & (ids[None, :] != self.ids[who, None]))
        if not len(row):
            return
        touched = np.unique(row)
        old = self.found[who[touched]]
        q = np.concatenate([row, np.repeat(touched, self.k)])
        s = np.concatenate([scores[row, col], self.score[who[touched]].ravel()])
        i = np.concatenate([ids[col], old.ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        take = first[:, None] + np.arange(self.k)
        self.score[who[touched]], self.found[who[touched]] = s[take], i[take]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        leaves = kd_leaves(vectors)
        low = np.array([vectors[x].min(0) for x in leaves])
        high = np.array([vectors[x].max(0) for x in leaves])
        bound = np.maximum(self.queries, 0) @ high.T + np.minimum(self.queries, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(self.ids))
        for turn in range(len(leaves)):
            leaf = order[live, turn]
            going = bound[live, leaf] >= self.score[live, -1]
            live, leaf = live[going], leaf[going]
            for x in np.unique(leaf):
                self.offer(live[leaf == x], ids[leaves[x]], vectors[leaves[x]])


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None

        def emit() -> pa.RecordBatch:
            q, place = np.nonzero(best.score > -np.inf)
            score = np.clip(best.score[q, place], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, place]), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                width, key = row["width"], (row["width"], row["block"], row["lane"])
                if row["queries"] is not None:  # before the shards of its block and lane
                    if best:
                        yield emit()
                    at, best = key, Best(np.array([r["vec_id"] for r in row["queries"]]), np.array([r["v"] for r in row["queries"]]), k)
                elif key == at:
                    best.search(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, width))
        if best:
            yield emit()

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query"), quantised(F.col(vector_col)).alias("v")
    ).filter(F.col("v").isNotNull())
    queries = rows.filter("is_query").select("vec_id", "v")
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("is_query"))).first()
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-n_rows // (SHARD_ROWS * LANE_SHARDS)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = queries.distinct().groupBy(F.size("v").alias("width"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    asked = packed.select("width", "block", every(lanes).alias("lane"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vectors"), "queries")
    shards = rows.select("vec_id", "v").mapInArrow(_pack, "width int, ids binary, vectors binary")
    shards = shards.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    shards = shards.select("width", every(blocks).alias("block"), "lane", "ids", "vectors", F.lit(None).cast(asked.schema["queries"].dataType).alias("queries"))
    keys = ["width", "block", "lane"]
    work = asked.union(shards).repartition(*keys).sortWithinPartitions(*keys, F.col("queries").isNull())
    found = work.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
