"""Continuous rebuilds: new files are enriched once, keyed by their content.

This goes beyond a batch rebuild: a file stream with a checkpoint takes the place of looking up
which results exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import pending


def enrich_stream(
    spark: SparkSession, source: str, schema: str, cache: str, checkpoint: str, keyed: Callable[[DataFrame], DataFrame], compute: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Reads what is new below ``source`` and appends what ``cache`` lacks to it.

    ``keyed`` adds ``cache_key``; ``compute`` maps pending rows to cache rows."""

    def batch(rows: DataFrame, _: int) -> None:
        fresh = keyed(rows)
        try:
            known = spark.read.parquet(cache)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "cache_key string")
        compute(pending(fresh, known)).write.mode("append").parquet(cache)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
