"""Full-text index and ranked retrieval."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import snippet, tokens

WEIGHTS = (("title", 3), ("summary", 2), ("text", 1))


def postings(docs: DataFrame, key: str = "doc", weights: tuple[tuple[str, int], ...] = WEIGHTS, prefixes: list[str] | None = None) -> DataFrame:
    """``term, doc, tf``: weighted term frequencies, of terms with one of ``prefixes`` if given.  One
    pass over the rows: the fields' tokens are sifted and concatenated with their weights before they
    are exploded."""
    def with_weight(column: str, weight: int) -> Column:
        found = tokens(F.coalesce(F.col(column), F.lit("")))
        if prefixes is not None:
            found = F.filter(found, lambda t: reduce(or_, [t.startswith(p) for p in sorted(set(prefixes))], F.lit(False)))
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    weighed = F.concat(*[with_weight(c, w) for c, w in weights])
    rows = docs.select(F.col(key).alias("doc"), F.explode(weighed).alias("x")).select("doc", "x.term", "x.w")
    return rows.groupBy("term", "doc").agg(F.sum("w").cast("long").alias("tf"))


def index_docs(sections: DataFrame) -> DataFrame:
    """The documents side of the index: ``i, t, u, b, p, s``."""
    from .structure import page_label

    shown = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.col("text"))
    return sections.select(
        F.col("ord").alias("i"), F.col("title").alias("t"), F.concat(F.lit("sections/"), "id", F.lit(".html")).alias("u"),
        F.coalesce("breadcrumb", F.lit("")).alias("b"), page_label(F.col("start_page"), F.col("end_page")).alias("p"), snippet(shown).alias("s"),
    )


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9_]+", query.lower()) if len(t) > 1]


def search(index: DataFrame, n_docs: int | Column, query: str, top: int = 40) -> DataFrame:
    """``doc, score``: tf-idf over exact and, at half weight, prefix matches; repeated query terms
    count again.  Terms are literals, so they reach the index scan as prefix filters."""
    terms = query_terms(query)
    hit = lambda t: F.col("term").startswith(t)
    some = None
    for t in set(terms):
        some = hit(t) if some is None else some | hit(t)
    rows = index.filter(some if some is not None else F.lit(False))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = sum((F.when(F.col("term") == t, 1.0).when(hit(t), 0.5).otherwise(0.0) for t in terms), F.lit(0.0))
    total = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    idf = F.log(1 + total / F.col("df"))
    scored = rows.join(df, "term").groupBy("doc").agg(F.sum(F.col("tf") * weight * idf).alias("raw"))
    return scored.select("doc", F.round("raw", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(top)


def search_index(spark: SparkSession, path: str, query: str, top: int = 40) -> DataFrame:
    """``search`` over an index that ``sinks.write_index`` has written, sorted by term: only row groups
    that may hold a query's prefixes are read."""
    return search(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs").count(), query, top)
