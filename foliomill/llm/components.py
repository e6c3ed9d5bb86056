"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node reached) for every node of ``links`` (``u``, ``v``).

    Each step takes the least neighbour of every node (partial aggregation, then a join whose hot
    nodes Spark splits) and moves links towards it; the number of steps is logarithmic.  It is over
    when every node has one link, to a node that has none itself.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if several.isEmpty() and edges.select(F.col("v").alias("x")).join(edges.select(F.col("u").alias("x")), "x", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
