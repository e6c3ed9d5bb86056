"""Mixing sources to target weights.

Words are summed per source, water-filling turns weights into targets under a repetition cap, and
each document is emitted ``floor(rate)`` times plus one Bernoulli copy with probability equal to the
fraction.  A document's coin is a hash of its id and a seed, so a rerun draws the same copies.  With
few documents independent coins may land far from the target; so the cut below which a coin draws a
copy is not the fraction itself but, per source, the place in the order of the coins where the words
drawn come nearest to the target.  For a random coin that is the fraction on average, and the words
taken miss the target by one document at most (or by documents whose coins agree in 24 bits).

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and rate 0; repeated rows share a coin and so are drawn together; rows
without id share one coin; an empty table gives an empty result; columns other than the id, text and
source are carried untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import cut, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: White space as those words see it: a word starts where one of these (or the start) precedes it.
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Weights repeat ``cycle`` over the sources in code point order, null last.  Targets share the
    total in proportion to weight; a source stops at ``cap`` times its size and the excess is
    shared again among the others until none is above.  Each round is one aggregate over the
    sources; only its few sums go to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = ranked(sizes, order, "position", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("position") % len(cycle) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = (F.col("weight") * F.lit(level) > F.col("most")) | (F.col("source_size") == 0)
        n, held, open_weight = rows.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - held) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.col("most"))
    return rows.select("source", "source_size", target.alias("target"))


def coin(doc_id: Column, seed: int) -> Column:
    """52 bits of a hash that other engines have, too."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


#: A cut has two steps: COARSE ranges of coins, then as many ranges within one of them.
COARSE = 12
_FINE = 52 - 2 * COARSE


def source_plan(sized: DataFrame, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """``source, source_size, target, base, cut`` from ``source, size, coin``: a document is taken
    ``base`` times and once more if the first 24 bits of its coin are below ``cut``.

    Two histograms of coins, aggregated before they are shuffled, find the cut; a source has at most
    2**12 rows in each, whatever the number of its documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(totals, cycle, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    t = t.withColumn("base", F.floor(rate).cast("long")).withColumn("want", F.col("target") - F.col("base") * F.col("source_size"))
    t = cut(t, "targets")  # written, so that Spark knows its size
    open_ = t.filter("want > 0").select(F.col("source").alias("s"), "want")
    same = F.col("source").eqNullSafe(F.col("s"))
    upto = Window.partitionBy("s").orderBy("at")
    coarse = sized.groupBy("source", F.shiftright("coin", 52 - COARSE).alias("at")).agg(F.sum("size").alias("n"))
    coarse = coarse.join(open_, same).withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    coarse = cut(coarse.filter("begin < want and want <= end").select("s", "want", F.col("at").alias("c"), "begin"), "coarse-cuts")
    fine = sized.join(coarse.select("s", "c"), same & (F.shiftright("coin", 52 - COARSE) == F.col("c")))
    fine = fine.groupBy("s", F.shiftright("coin", _FINE).alias("at")).agg(F.sum("size").alias("n"))
    first = coarse.select("s", F.shiftleft("c", COARSE).alias("cut"), "begin", "want")
    ends = fine.join(coarse.select(F.col("s").alias("of"), "begin", "want"), F.col("s").eqNullSafe(F.col("of")))
    ends = ends.select("s", (F.col("at") + 1).alias("cut"), (F.col("begin") + F.sum("n").over(upto)).alias("begin"), "want")
    nearest = first.union(ends).groupBy("s").agg(F.min(F.struct(F.abs(F.col("begin") - F.col("want")).alias("off"), "cut")).alias("best"))
    nearest = nearest.select("s", F.col("best.cut").alias("cut"))
    return cut(t.join(nearest, same, "left").select("source", "source_size", "target", "base", F.coalesce("cut", F.lit(0)).alias("cut")), "source-plan")


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), coin(F.col(id_col), seed).alias("coin")
    )


def _copies(coins: Column) -> Column:
    return F.col("base") + F.when(F.shiftright(coins, _FINE) < F.col("cut"), 1).otherwise(0)


def rates(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, copies``."""
    sized = cut(_sized(docs, seed, id_col, text_col, source_col), "sizes")
    t = source_plan(sized.select("source", "size", "coin"), cycle, cap).withColumnRenamed("source", "__source")
    return sized.join(t, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "source", "size", "source_size", "target", _copies(F.col("coin")).cast("long").alias("copies")
    )


def mix(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the input's columns.

    Texts meet only the table of sources, one written row each, which Spark broadcasts when that
    table is small and else sorts and merges, splitting hot sources.
    """
    sized = cut(_sized(docs, seed, id_col, text_col, source_col).select("source", "size", "coin"), "sizes")
    t = source_plan(sized, cycle, cap).select(F.struct(F.col("source"), F.col("base"), F.col("cut")).alias("__plan"))
    copies = F.col("__plan.base") + F.when(F.shiftright(coin(F.col(id_col), seed), _FINE) < F.col("__plan.cut"), 1).otherwise(0)
    return (
        docs.join(t, F.col(source_col).eqNullSafe(F.col("__plan.source")))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*docs.columns)
    )
