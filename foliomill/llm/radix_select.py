"""The k rows of each group with the largest values, by radix select.

Values are dealt into digits of ``DIGIT_BITS`` bits from the highest on.  A round counts, for every
group that is still open, the rows that agree with what is known of its k-th value by their next digit;
the histogram, at most ``2**DIGIT_BITS`` rows a group and added up before it is shuffled, tells the
digit of the k-th value.  A group is closed as soon as all rows of a digit are wanted.  What is left are
groups whose k-th value more rows share than are wanted; of these the ones with the least names, by
UTF-8 bytes, are found in the same way, two bytes at a time: a round first skips the bytes that all
names in question share.  No group of rows is ever gathered or sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from .scratch import cut

DIGIT_BITS = 15
VALUE_BITS = 60


@F.udf(IntegerType())
def _shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix; for one row of each open group and round."""
    n = min(len(a), len(b))
    low = 0
    while low < n:  # the common prefix has at least ``low`` bytes and at most ``n``
        half = (low + n + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            n = half - 1
    return low


def _narrowed(histogram: DataFrame, groups: list[str], order: Column) -> DataFrame:
    """For each group the digit at which ``need`` rows are reached, in ``order``; ``fewer``, the rows
    before it; ``here``, the rows with it.  Where a group has fewer rows than it needs, its last digit."""
    by = Window.partitionBy(*groups).orderBy(order)
    upto = histogram.withColumn("upto", F.sum("n").over(by)).withColumn("last", F.lead("n").over(by).isNull())
    first = upto.filter("upto - n < need and (upto >= need or last)")
    return first.select(*groups, "digit", (F.col("upto") - F.col("n")).alias("fewer"), F.col("n").alias("here"))


def _same(groups: list[str], other: DataFrame) -> tuple[DataFrame, Column]:
    """``other`` with its groups renamed, and the condition that groups agree; nulls are a group."""
    renamed = other.withColumnsRenamed({g: f"__{g}" for g in groups})
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return renamed, condition


def top_rows(rows: DataFrame, groups: list[str], value: str, name: str, k: int) -> DataFrame:
    """The rows of ``rows`` among the ``k`` first of their group, by ``value`` descending, then
    ``name`` by bytes; ``value`` is a long from 0 to 2**60 - 1, and a name occurs once in a group."""
    rows = cut(rows, "radix-rows")
    item = F.col(name).cast("binary")
    state = rows.select(*groups).distinct().withColumns({"known": F.lit(0).cast("long"), "need": F.lit(k).cast("long"), "open": F.lit(True)})
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        state = cut(state, "radix-state")
        going, same = _same(groups, state.filter("open").drop("open"))
        digit = F.shiftright(F.col(value), shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        met = rows.join(going, same & (F.shiftright(F.col(value), shift + DIGIT_BITS) == F.col("known")))
        histogram = met.groupBy(*groups, "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        found, same = _same(groups, _narrowed(histogram, groups, F.desc("digit")))
        state = state.join(found, same, "left").select(
            *groups, F.when(F.col("open"), F.shiftleft("known", DIGIT_BITS) + F.col("digit")).otherwise(F.shiftleft("known", DIGIT_BITS)).alias("known"),
            F.when(F.col("open"), F.col("need") - F.col("fewer")).otherwise(F.col("need")).alias("need"),
            (F.col("open") & (F.col("here") > F.col("need") - F.col("fewer"))).alias("open"),
        )
    # ``known`` is now the least value that is taken; open groups have more rows of it than they need.
    state = cut(state.withColumns({"prefix": F.lit(b"").cast("binary"), "whole": F.lit(False)}), "radix-state")
    limits, same = _same(groups, state.drop("need", "prefix", "whole"))
    tied = rows.join(limits.filter("open"), same & (F.col(value) == F.col("known"))).select(*groups, item.alias("item"))
    tied = cut(tied, "radix-ties")
    bounds = state.filter("open").select(*groups, "need", "prefix", "whole", "open")
    while not bounds.filter("open").isEmpty():
        going, same = _same(groups, bounds.filter("open").drop("open", "whole"))
        inside = F.substring("item", F.lit(1), F.length("prefix")) == F.col("prefix")
        met = cut(tied.join(going, same & inside).select(*groups, "item", "need"), "radix-met")
        ends = met.groupBy(*groups).agg(F.min("item").alias("a"), F.max("item").alias("b"))
        ends = ends.select(*groups, F.substring("a", F.lit(1), _shared_bytes("a", "b")).alias("prefix"))
        ends, same = _same(groups, ends)
        at = F.substring("item", F.length("prefix") + 1, F.lit(2))
        histogram = met.join(ends, same).groupBy(*groups, "need", "prefix", at.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        found = _narrowed(histogram, groups, F.asc("digit"))
        before, same = _same(groups, histogram.select(*groups, "need", "prefix").distinct())
        left = F.col("need") - F.col("fewer")
        fresh = found.join(before, same).select(
            *groups, left.alias("need"), F.concat("prefix", "digit").alias("prefix"), (F.length("digit") < 2).alias("whole"), (F.col("here") > left).alias("open")
        )
        bounds = cut(bounds.filter("not open").unionByName(fresh), "radix-bounds")
    last, same_last = _same(groups, bounds.select(*groups, F.col("prefix").alias("bound"), F.col("whole").alias("exact")))
    limits, same = _same(groups, state.select(*groups, "known"))
    taken = rows.join(limits, same & (F.col(value) >= F.col("known"))).select(*rows.columns, "known").join(last, same_last, "left")
    starts = ~F.col("exact") & (F.substring(item, F.lit(1), F.length("bound")) == F.col("bound"))
    within = F.col("bound").isNull() | (item <= F.col("bound")) | starts
    return taken.filter((F.col(value) > F.col("known")) | within).select(*rows.columns)
