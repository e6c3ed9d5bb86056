"""Cached JSON results; a file that is missing or corrupt counts as absent."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_json_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.withColumn("_bad", F.col("_corrupt").isNotNull()).filter("not _bad").drop("_bad", "_corrupt")


def append_json_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


class AnswerCache:
    """Results by key below ``path``, kept as they are made.

    A Parquet table in ``buckets`` buckets by key, which joins and groups use as it lies: what is new is
    shuffled to it, never the cache.  A task's rows are in place as soon as the task ends (version 2 of
    the file output committer), so a job that is killed loses what its running tasks had, no more; rows
    dealt by ``tasks`` reach one bucket a task.  A key may be written again: the latest row counts, and
    a file that is corrupt counts as absent.

    ``schema`` names the columns beside the key, which may be nested; it and ``buckets`` stay the same
    for a path.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "cache_key", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, f"{path.rstrip('/')}/by-{buckets}", key, buckets
        self.columns = StructType.fromDDL(schema).names
        self.name = f"foliomill_cache_{hashlib.md5(self.path.encode()).hexdigest()}"
        place = self.path.replace("'", "\\'")
        spark.sql(f"""create table if not exists {self.name} ({key} string, made timestamp, {schema}) using parquet
            options ('mapreduce.fileoutputcommitter.algorithm.version' '2', 'ignoreCorruptFiles' 'true', 'compression' 'zstd')
            clustered by ({key}) into {buckets} buckets location '{place}'""")

    def read(self) -> DataFrame:
        """The latest row of every key: ``key`` and the columns of the schema."""
        self.spark.catalog.refreshTable(self.name)
        latest = self.spark.table(self.name).groupBy(self.key).agg(F.max_by(F.struct(*self.columns), "made").alias("latest"))
        return latest.select(self.key, "latest.*")

    def lacking(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` one for each key that the cache lacks."""
        self.spark.catalog.refreshTable(self.name)
        known = self.spark.table(self.name).select(self.key)
        return rows.join(known, self.key, "left_anti").dropDuplicates([self.key])

    def tasks(self, rows: int, each: int = 16) -> int:
        """Partitions for so many rows, about ``each`` in one: a multiple of the buckets, so that rows dealt
        by the key lie in one bucket.  Every task reports to the driver, so few rows in one are for slow services."""
        return self.buckets * max(1, -(-rows // (self.buckets * each)))

    def add(self, rows: DataFrame) -> None:
        """Appends rows; what Spark runs last for them is what a killed job loses least of."""
        rows.select(self.key, F.current_timestamp().alias("made"), *self.columns).write.insertInto(self.name)
