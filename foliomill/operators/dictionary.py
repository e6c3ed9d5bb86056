"""Ranked retrieval for tables of queries, from a dictionary of terms and postings in blocks.

An index on disk is four tables:

* ``terms``: ``term, df, top, head, key``: in how many documents a term occurs, its largest frequency, the
  block that holds it, and under ``key`` the term's first two, three and four characters, a row each;
* ``blocks``: ``term, no, top, entries``: up to ``BLOCK`` postings ``doc, tf`` of a term, those with the
  largest frequencies in one block, the next ones in another; ``top`` is a block's largest frequency.
  Sorted by term within parts, of which only those that hold a wanted block are read;
* ``docs``, and ``about``: the number of documents.

A query token meets the dictionary by an equi-join on as many of its first characters as a key has, so
that no plan compares every token with every term.  Scores are those of ``search``: tf-idf over exact
and, at half weight, prefix matches.

Blocks are left out by what they can add.  The scores that the first blocks of a query's heaviest terms
give already are lower bounds; the k-th largest is a floor under the query's k-th score.  A document
whose posting lies in a block scores at most that block's top in its term plus the largest frequencies
of all other terms of the query, each times its weight; where that is below the floor, none of the
block's documents is among the first k, and the block is not joined.  Every document that may be keeps
all its blocks, so its score is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import constants as K

BLOCK = 128
PARTS = 64
KEYS = (2, 3, 4)
#: Terms of a query, the heaviest, whose first blocks give the floor.
HEADS = 8
#: Scores are rounded to six places before they are ranked: a floor is lowered by more than that moves them.
MARGIN = 2e-6


def part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def in_order(postings: DataFrame) -> DataFrame:
    """Postings dealt into ranges by term and falling frequency, so that a frequent term is spread over tasks."""
    order = [F.col("term"), F.desc("tf"), F.col("doc")]
    return postings.repartitionByRange(*order).sortWithinPartitions(*order)


def posting_blocks(postings: DataFrame, lying: bool = False) -> DataFrame:
    """``part, term, no, top, entries`` of ``postings`` (``term, doc, tf``), put ``in_order`` first unless they
    are read as they were written so (``lying``).

    They are numbered where they are; a block is a run of numbers.  Any numbers do: a run that is broken
    where a file is cut makes two blocks.
    """
    lying = (postings if lying else in_order(postings)).select("term", "doc", "tf")
    lying = lying.withColumn("no", F.monotonically_increasing_id()).withColumn("no", F.expr(f"no div {BLOCK}"))
    entry = F.struct((-F.col("tf")).alias("less"), "doc", "tf")
    runs = lying.groupBy("term", "no").agg(F.max("tf").alias("top"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return runs.select(part(F.col("term")).alias("part"), "term", "no", "top", F.transform("entries", lambda e: F.struct(e["doc"].alias("doc"), e["tf"].alias("tf"))).alias("entries"))


def dictionary(blocks: DataFrame) -> DataFrame:
    """``term, df, top, head, key`` of ``blocks``."""
    found = blocks.groupBy("term").agg(
        F.sum(F.size("entries")).alias("df"), F.max("top").alias("top"), F.min_by("no", F.struct(-F.col("top"), "no")).alias("head")
    )
    lengths = F.sequence(F.lit(KEYS[0]), F.least(F.length("term"), F.lit(KEYS[-1])))
    return found.filter(F.length("term") >= KEYS[0]).select("*", F.explode(F.transform(lengths, lambda k: F.substring(F.col("term"), F.lit(1), k))).alias("key"))


def query_weights(queries: DataFrame, terms: DataFrame, n_docs: int | Column) -> DataFrame:
    """``query_id, term, weight, top, head``: the terms that match tokens of each query (``query_id,
    query``), with all that a frequency of one is worth; a token that is repeated counts again."""
    found = F.filter(F.regexp_extract_all(F.lower("query"), F.lit(K.INDEX_TOKEN), F.lit(0)), lambda t: F.length(t) > 1)
    tokens = queries.select("query_id", F.explode(found).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    tokens = tokens.withColumn("key", F.substring("token", 1, KEYS[-1]))
    met = tokens.join(terms, "key").filter(F.col("term").startswith(F.col("token")))
    worth = F.sum(F.col("times") * F.when(F.col("term") == F.col("token"), 1.0).otherwise(0.5))
    met = met.groupBy("query_id", "term").agg(worth.alias("matched"), F.first("df").alias("df"), F.first("top").alias("top"), F.first("head").alias("head"))
    total = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    return met.select("query_id", "term", (F.col("matched") * F.log(1 + total / F.col("df"))).alias("weight"), "top", "head")


def _scores(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, doc, score`` over the blocks of ``wanted`` (``query_id, part, term, no, weight``)."""
    hits = blocks.select("part", "term", "no", "entries").join(wanted, ["part", "term", "no"])
    hits = hits.select("query_id", "weight", F.inline("entries"))
    return hits.groupBy("query_id", "doc").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))


def wanted_blocks(weights: DataFrame, blocks: DataFrame, top: int, skip: bool = True) -> DataFrame:
    """``query_id, part, term, no, weight``: the blocks that may hold one of a query's first ``top``
    documents, or all with its terms unless ``skip``.  ``weights`` are read more than once."""
    places = blocks.select("part", "term", "no", F.col("top").alias("block_top"))
    every = weights.withColumn("part", part(F.col("term"))).join(places, ["part", "term"])
    if not skip:
        return every.select("query_id", "part", "term", "no", "weight")
    heaviest = Window.partitionBy("query_id").orderBy(F.desc(F.col("weight") * F.col("top")), "term")
    heads = weights.withColumn("nth", F.row_number().over(heaviest)).filter(F.col("nth") <= HEADS)
    first = _scores(heads.select("query_id", part(F.col("term")).alias("part"), "term", F.col("head").alias("no"), "weight"), blocks)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floors = first.withColumn("nth", nth).filter(F.col("nth") == top).select("query_id", (F.col("score") - MARGIN).alias("floor"))
    most = weights.groupBy("query_id").agg(F.sum(F.col("weight") * F.col("top")).alias("most")).join(floors, "query_id", "left")
    bound = F.col("most") - F.col("weight") * (F.col("top") - F.col("block_top"))
    return every.join(most, "query_id").filter(F.col("floor").isNull() | (bound >= F.col("floor"))).select("query_id", "part", "term", "no", "weight")


def search_table(spark: SparkSession, path: str, queries: DataFrame, top: int = 40, skip: bool = True, keep: str | None = None) -> DataFrame:
    """``query_id, rank, doc, score``: the first ``top`` documents of each row of ``queries`` (``query_id,
    query``) in the index at ``path`` (``sinks.write_index``), by score, then by document.  ``keep`` is a
    folder for the queries' weights (default: one of this session's)."""
    from .. import sinks

    read = lambda name: spark.read.parquet(f"{path}/{name}")
    n = read("about").first()["n_docs"]
    kept = keep or sinks.temporary(spark, "query-weights")
    sinks.write_table(query_weights(queries, read("terms"), n), kept)
    weights, blocks = spark.read.parquet(kept), read("blocks")
    scored = _scores(wanted_blocks(weights, blocks, top, skip), blocks).withColumn("score", F.round("score", 6))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= top).select("query_id", "rank", "doc", "score")
