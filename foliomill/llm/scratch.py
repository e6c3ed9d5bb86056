"""Tables that cut lineage, and exact ranks without a single-task sort.

Everything is written below ``spark.checkpoint.dir`` (shared by driver and executors); only
where that is unset in local mode, as in tests, a folder under the warehouse is used.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/foliomill-{spark.sparkContext.applicationId}"


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(path: str) -> None:
    """Deletes a scratch table that no later step reads."""
    _remove(path)
    if path in _written:
        _written.remove(path)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            forget(path)
        except Exception:  # the JVM may be gone; the folder carries the application's id
            return


def folder(spark: SparkSession, name: str) -> str:
    """A new path for scratch tables, deleted at the end or as ``only`` says."""
    _written.append(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def put(df: DataFrame, name: str) -> str:
    """Writes ``df`` as a scratch table and returns its path."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that has been written and is read again."""
    return df.sparkSession.read.schema(df.schema).parquet(put(df, name))


#: Rows, and about how many bytes, that reach Python at once where memory is bounded by ``batches_of``.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is planned and run inside sends at most so many rows and about ``size`` bytes to Python
    at once; a longer text is a batch of its own."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def only(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` describes, written; the tables that it wrote on the way are deleted."""
    before = set(_written)
    df = build()
    path = put(df, name)
    for other in [x for x in _written if x not in before and x != path]:
        forget(other)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver, of plain numbers and texts, as a table that no Python worker makes."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = f"array<struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def cut_counting(df: DataFrame, name: str, which: Column) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows for which ``which`` holds, counted while they are written
    (a task that is run again may count again, so only whether there are any is sure)."""
    seen = Observation()
    table = cut(df.observe(seen, F.count_if(which).alias("n")), name)
    return table, seen.get["n"]


def ordered(df: DataFrame, order: list[Column], place: str, name: str, distinct: list[str] | None = None) -> DataFrame:
    """``df`` as a table with ``place``: numbers, not without gaps, in the total order ``order``.

    Rows are dealt into key ranges and sorted there, so no task sees more than its range.  Of rows
    that agree in the columns ``distinct``, which must be those of ``order``, one is kept.
    """
    split = df.repartitionByRange(*order)
    if distinct:
        split = split.dropDuplicates(distinct)
    return cut(split.sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), name)


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, ... in the total order ``order``.

    Only the row counts of the ranges of ``ordered``, one number each, go to the driver.
    """
    return numbered(ordered(df, order, "__at", name), "__at", rank)


def numbered(table: DataFrame, at: str, rank: str) -> DataFrame:
    """``table`` with ``rank``, 0, 1, 2, ... in the order of ``at``, a ``monotonically_increasing_id``
    that has been written and is left out."""
    spark = table.sparkSession
    shift = F.shiftright(at, 33)
    counts = table.groupBy(shift.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        starts.append((part, total))
        total += n
    first = small(spark, starts or [(-1, 0)], "__part long, __first long")
    return (
        table.join(F.broadcast(first), shift == F.col("__part"))
        .withColumn(rank, F.col("__first") + F.col(at).bitwiseAND((1 << 33) - 1))
        .drop(at, "__part", "__first")
    )
