"""Token ids on disk: documents in ascending order of their ids, compressed by Re-Pair per shard.

Documents are dealt into ranges of their id and sorted there; a task encodes its range and closes a
shard at the first document after which it holds ``SHARD_IDS`` ids, so a document lies in one shard.
The ids of a shard become grammars (see ``grammar``) of at most ``SEGMENT_IDS`` ids each, however long
a document is.  A store is two Parquet tables, which any file system that Spark reads can hold:

* ``shards``: ``part`` (its range), ``at`` (ids of the range before it), ``n_ids``, the documents'
  ``doc_ids`` and ``sizes``, and ``grammars``, the bytes of ``Grammar.tobytes``, in order;
* ``parts``: ``part, first`` (ids of all ranges before it), a row for each range.

So an id's place in the whole order is ``first + at`` and its place in the shard; ``ranges`` reads any
stretches of ids from the shards that hold them, by the lengths of the rules' expansions.

Edge cases: a null or empty text becomes the end id alone; rows without id come first; rows that share
an id are ordered by a hash of their text, equal rows are interchangeable; an empty table gives an
empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .grammar import Grammar
from .packing import END_ID, Encoder, _encoders
from .scratch import batches_of, small
from .words import give_back

SHARD_IDS = 1 << 19
SEGMENT_IDS = 1 << 20
SHARDS = "part int, at long, n_ids long, doc_ids array<long>, sizes array<long>, grammars array<binary>"


def _encoded(tokenizer_path: str, ranks_path: str | None, end_id: int, shard_ids: int):
    """Shards of the documents of a range, which come in order."""

    def shard(part: int, at: int, docs: list, held: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(held)
        cuts = np.array_split(ids, -(-len(ids) // SEGMENT_IDS))
        columns = [[part], [at], [len(ids)], [docs], [[len(x) for x in held]], [[Grammar.of(x).tobytes() for x in cuts]]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SHARDS.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (tokenizer_path, ranks_path)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))
        part, at, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                held.append(np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype(np.uint32))
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard(part, at, docs, held)
                    at, docs, held, size = at + size, [], [], 0
        if held:
            yield shard(part, at, docs, held)
        give_back()

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, ranks_path: str | None = None, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS,
) -> None:
    """Writes the store of ``docs`` at ``path``; each document's ids are followed by ``end_id``.

    Only one sum for each range goes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())  # equal rows are spread, too
    order = ["doc_id", "tie", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with batches_of(spark):
        shards = rows.mapInArrow(_encoded(tokenizer_path, ranks_path, end_id, shard_ids), SHARDS)
        shards.write.option("compression", "zstd").parquet(f"{path}/shards")
    sums = spark.read.schema(SHARDS).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sums):
        starts.append((part, total))
        total += n
    made = small(spark, starts or [(-1, 0)], "part int, first long")
    made.write.parquet(f"{path}/parts")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store, with ``start``, the ids before each in the whole order."""
    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")  # a row for each range
    table = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    return table.join(F.broadcast(parts), "part").withColumn("start", F.col("first") + F.col("at"))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document (``ids`` little-endian unsigned 32-bit), or
    ``ids_crc32`` instead of ``ids`` unless ``keep_ids``."""
    digest = bytes if keep_ids else zlib.crc32
    kind = pa.binary() if keep_ids else pa.int64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, doc_ids, sizes, grammars = (batch.column(c)[k].as_py() for c in range(4))
                ids = np.concatenate([Grammar.frombytes(g).ids() for g in grammars]).astype("<u4")
                ends = np.cumsum(sizes)
                made = [digest(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), sizes)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes, pa.int64()), pa.array(made, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
        give_back()

    with_ids = "ids binary" if keep_ids else "ids long"
    out = _shards(spark, path).select("start", "doc_ids", "sizes", "grammars").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {with_ids}")
    return out if keep_ids else out.withColumnRenamed("ids", "ids_crc32")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame, page: int = SHARD_IDS) -> DataFrame:
    """``key, ids``: for each row ``key, start, length`` of ``wanted`` the ids of that stretch of the
    whole order (what lies beyond its end is left out), little-endian unsigned 32-bit.

    Stretches meet shards by equal pages of ``page`` places, and of a shard only the symbols that
    cover a stretch are expanded.
    """
    pages = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / page), F.floor((F.expr(b) - 1) / page)))
    asked = wanted.filter("length > 0").select("key", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    asked = asked.withColumn("page", pages("a", "b"))
    shards = _shards(spark, path).select("start", "n_ids", "grammars").withColumn("page", pages("start", "start + n_ids"))
    here = F.greatest(F.floor(F.greatest("a", "start") / page), F.lit(0)) == F.col("page")  # of several common pages the first
    met = asked.join(shards, "page").filter("a < start + n_ids and b > start").filter(here)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, b, start, grammars = (batch.column(c)[k].as_py() for c in range(1, 5))
                parts, at = [], start
                for g in map(Grammar.frombytes, grammars):
                    ends = np.cumsum(g.sizes(g.sequence))
                    n = int(ends[-1])
                    low, high = max(a, at), min(b, at + n)
                    if low < high:
                        parts.append(g.slice(low - at, high - low, ends).astype("<u4").tobytes())
                    at += n
                out.append((max(a, start), b"".join(parts)))
            columns = [batch.column(0), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "ids"])

    kind = dict(met.dtypes)["key"]
    parts = met.select("key", "a", "b", "start", "grammars").mapInArrow(decode, f"key {kind}, at long, ids binary")
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda x, p: F.concat(x, p["ids"]))
    out = wanted.select("key").join(joined.select(F.col("key").alias("k"), whole.alias("ids")), F.col("key") == F.col("k"), "left")
    return out.select("key", F.coalesce("ids", F.lit(b"").cast("binary")).alias("ids"))
