"""Quick jump, page search, page lists, stars, notes, glossary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import glossary_keys, strip


def palette(sections: DataFrame, registers: DataFrame) -> DataFrame:
    """Entries ``ord, t, u, k, s``: sections, registers, fixed pages, in this order.

    ``sections``: ord, label, url; ``registers``: ord, name, url, section."""
    spark = sections.sparkSession
    pages = spark.createDataFrame([(k, t, u) for k, (t, u) in enumerate(K.PALETTE_PAGES)], "ord long, t string, u string")
    parts = [
        sections.select(F.col("ord").cast("long"), F.col("label").alias("t"), F.col("url").alias("u"), F.lit("section").alias("k"), F.lit(0).alias("part")),
        registers.select(F.col("ord").cast("long"), F.col("name").alias("t"), F.col("url").alias("u"), F.lit("register").alias("k"), F.col("section").alias("s"), F.lit(1).alias("part")),
        pages.withColumn("k", F.lit("page")).withColumn("part", F.lit(2)),
    ]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("part", "ord", "t", "u", "k", "s")


def jump(entries: DataFrame, query: str, top: int = 30) -> DataFrame:
    """The best entries for a query; without one, the first."""
    q = query.strip().lower()
    if not q:
        return entries.withColumn("score", F.lit(0.0)).orderBy("part", "ord").limit(top)
    t = F.lower("t")
    other = F.lower(F.concat("k", F.lit(" "), F.coalesce("s", F.lit(""))))
    for token in q.split():
        entries = entries.filter(t.contains(token) | other.contains(token))
    base = F.when(t == q, 100).when(t.startswith(q), 50).when(t.contains(q), 20).otherwise(0)
    kind = F.when(F.col("k") == "register", 8).when(F.col("k") == "page", 4).otherwise(0)
    score = F.round(base + kind - F.length("t") * F.lit(0.05), 6)
    return entries.withColumn("score", score).filter("score >= 0").orderBy(F.desc("score"), "part", "ord").limit(top)


def page_search(manifest: DataFrame, query: str, top: int = 40) -> DataFrame:
    """Pages that hold every token, in page order, with a snippet around the first token (whose
    place is that in section title and text together).  A page without a section has an empty title."""
    found = re.findall("[a-z0-9_]+", query.strip().lower())
    manifest = manifest.withColumn("sec", F.coalesce("sec", F.lit("")))
    text = F.coalesce("t", F.lit(""))
    hay = F.lower(F.concat("sec", F.lit(" "), text))
    if not found:
        return manifest.filter(F.lit(False)).withColumn("snippet", F.lit(""))
    for token in found:
        manifest = manifest.filter(hay.contains(token))
    at = F.greatest(F.instr(hay, F.lit(found[0])) - 1 - 30, F.lit(0))
    cut = F.substring(F.regexp_replace(text, r"(?U)\s+", " "), at + 1, F.lit(110))
    return manifest.withColumn("snippet", cut).orderBy("n").limit(top)


def page_list(spec: Column) -> Column:
    """Pages of a list like '1, 3, 5-8' in input order, each once; what is no page is ignored."""
    parts = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), strip)
    rng = r"^(\d+)\s*[-–]\s*(\d+)$"

    def pages(p: Column) -> Column:
        a, b = (F.regexp_extract(p, rng, k).try_cast("int") for k in (1, 2))
        one = p.try_cast("int")
        many = F.when(a.isNotNull() & b.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b)))
        return F.when(p.rlike(rng), many).when(p.rlike(r"^\d+$") & one.isNotNull(), F.array(one))

    return F.array_distinct(F.filter(F.flatten(F.filter(F.transform(parts, pages), lambda x: x.isNotNull())), lambda n: n >= 1))


def listed_pages(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """``requests`` (key, spec) with their pages; those that are not there stay, without a row."""
    wanted = requests.select("key", F.posexplode(page_list(F.col("spec"))).alias("pos", "n"))
    return wanted.join(manifest, "n", "left")


def starred(stars: Column, add: Column, remove: Column) -> Column:
    """Sorted unique pages after adding and removing."""
    return F.array_sort(F.array_except(F.array_union(F.coalesce(stars, F.array().cast("array<int>")), add), remove))


def toggled(stars: Column, page: Column) -> Column:
    return F.when(F.array_contains(stars, page), starred(stars, F.array().cast("array<int>"), F.array(page))).otherwise(
        starred(stars, F.array(page), F.array().cast("array<int>"))
    )


def notes(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Notes with text, and their section's title, or its id where the section is gone."""
    titles = sections.select(F.col("id").alias("section"), F.col("title").alias("__title"), "url")
    kept = rows.filter(strip(F.col("note")) != "").join(titles, "section", "left")
    return kept.withColumn("title", F.coalesce("__title", "section")).drop("__title")


def glossary(spark) -> DataFrame:
    return spark.createDataFrame(list(K.GLOSSARY.items()), "term string, definition string")


def present_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, definition`` of the glossary terms in each text.  The glossary is a fixed list of
    51 rows, so it is broadcast."""
    found = df.select(key, F.explode(F.array_distinct(glossary_keys(F.col(text)))).alias("term"))
    return found.join(F.broadcast(glossary(df.sparkSession)), "term").select(key, "term", "definition")
