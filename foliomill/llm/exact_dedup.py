"""Exact deduplication against a persistent digest index.

The index is a catalog table bucketed and sorted by digest.  A batch is reduced to one row per
digest before any shuffle (partial aggregation), then anti-joined with the index by sort-merge,
which alone decides what is new; ids that stay are looked up for the other digests only.  What is
new is appended bucket for bucket, so the index itself is never shuffled.
DataFrame functions only.

Edge cases: a null text counts as empty; empty and very long texts are ordinary values; repeated
``doc_id`` are separate rows of the same group; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lowered, every other character kept."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the document that stays for it.

    ``buckets`` is fixed when the table is made (default: the session's shuffle partitions);
    choose it so that a bucket of all digests expected (about 50 bytes each) suits one task.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._append(small(spark, [], "digest binary, keep_id long"))
        else:
            rows = spark.sql(f"describe formatted {table}").filter("col_name = 'Num Buckets'").collect()
            self.buckets = int(rows[0]["data_type"])

    def _append(self, df: DataFrame) -> None:
        (
            df.write.format("parquet").mode("append").bucketBy(self.buckets, "digest")
            .sortBy("digest").saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns ``digest, doc_id, keep_id, group_size, kept`` for each of its rows.

        A digest that the index has keeps the earlier document, so none of the batch stays but that
        document itself, if it comes again: a batch may be added again after a crash.  A new digest
        keeps the batch's largest id.  ``group_size`` counts the batch's rows.  Texts are read once;
        the join of rows with their groups is between two plain shuffles, whose hot digests Spark splits.
        """
        rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
        groups = rows.groupBy("digest").agg(
            F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("group_size")
        )
        groups = cut(groups, "digest-groups")
        fresh = self.unseen(groups).withColumn("known_id", F.lit(None).cast("long")).withColumn("fresh", F.lit(True))
        old = groups.hint("merge").join(self.rows().withColumnRenamed("keep_id", "known_id").hint("merge"), "digest")
        known = cut(fresh.unionByName(old.withColumn("fresh", F.lit(False))), "digests-judged")
        added = known.filter("fresh").repartition(self.buckets, "digest")  # a bucket a task
        self._append(added.select("digest", F.col("last_id").alias("keep_id")))
        return (
            rows.join(known, "digest")
            .withColumn("keep_id", F.when(F.col("fresh"), F.col("last_id")).otherwise(F.col("known_id")))
            .withColumn("kept", F.coalesce(F.when(F.col("fresh"), F.col("doc_id").eqNullSafe(F.col("last_id"))).otherwise(F.col("doc_id") == F.col("known_id")), F.lit(False)))
            .select("digest", "doc_id", "keep_id", "group_size", "kept")
        )
