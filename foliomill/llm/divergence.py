"""Audit of sources: how the words of a language's sources differ, in whole numbers.

Terms are counted where texts are read, added up by language, source and term, and kept where at least
``LEAST_DOCUMENTS`` documents of the language hold them.  With smoothing every group gives every kept
term a share ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, so most of a group's shares are one
number, its baseline.  The divergence of two sources, a sum over all kept terms, is therefore taken
sparsely: V times the value of the two baselines, corrected for the terms that one of them has (a sum
over its different counts) and for those that both have (an equi-join of their counts by term).  The terms
that stand out most in a source are ranked by radix select (see ``radix_select``).

All arithmetic is in longs: ``10**9 * x / y`` is divided in three steps of a thousand, and shares are at
most 10**9 + 1, so that their squares fit.

Edge cases: null texts, languages and sources are empty strings; a language without kept terms gives its
pairs the value 0 and no terms; a text of any length is taken in slices; repeated rows are documents of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .radix_select import top_rows
from .scratch import cut, only
from .words import give_back

LEAST_DOCUMENTS = 3
SCALE_STEPS = 3  # of a thousand: shares are parts of 10**9
TOP_TERMS = 200
#: Different terms that a task holds before it passes their counts on, and bytes of a text split at once.
HELD_TERMS, SLICE = 200_000, 1 << 20
#: Letters of a term, A-Z lower-cased; all else becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in slices that end between terms."""
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].translate(_LETTERS)
        while end < len(text) and part[-1:] != b" ":
            more = text[end : end + SLICE].translate(_LETTERS)
            cut_at = more.find(b" ")
            part += more[: cut_at + 1] if cut_at >= 0 else more
            end += cut_at + 1 if cut_at >= 0 else len(more)
        yield part.split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of the documents of a task, a group's own row with term ''."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            counts[b""] += 1
            before, own = len(counts), set()
            for terms in _terms(text.as_py() or b""):
                counts.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(counts) - before
            if size > HELD_TERMS:
                yield passed()
                held.clear()
                size = 0
    yield passed()
    held.clear()
    give_back()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, and under
    the term '' a row for each group that occurs."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """SQL of ``1 + floor(10**9 * (count + 1) / total)``, by long division."""
    quotient, rest = f"({count} + 1) div ({total})", f"({count} + 1) % ({total})"
    for _ in range(SCALE_STEPS):
        quotient, rest = f"({quotient}) * 1000 + (({rest}) * 1000) div ({total})", f"(({rest}) * 1000) % ({total})"
    return f"1 + {quotient}"


def value(p: str, q: str) -> str:
    """SQL of ``floor((p - q)**2 / q)``."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the divergence of each source from each other one of its language."""
    side = lambda names: groups.selectExpr("lang as l", *names)
    both = groups.join(side(["source as other", "base as other_base"]), (F.col("lang") == F.col("l")) & (F.col("source") != F.col("other")))
    start = both.selectExpr("lang", "source", "other", f"terms * ({value('base', 'other_base')}) as v")
    different = kept.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))  # shares, with how many terms have them
    different = cut(different, "shares").join(groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "base"), F.expr("lang = gl and source = gs"))
    met = different.join(side(["source as other", "base as other_base"]), (F.col("lang") == F.col("l")) & (F.col("source") != F.col("other")))
    mine = met.selectExpr("lang", "source", "other", f"m * ({value('p', 'other_base')} - {value('base', 'other_base')}) as v")
    theirs = met.selectExpr("lang", "other as source", "source as other", f"m * ({value('other_base', 'p')} - {value('other_base', 'base')}) as v")
    # Terms that both have, counted twice above; each pair of sources once, in both directions.
    a = kept.select("lang", "term", "source", "p", "base")
    b = kept.selectExpr("lang as l", "term as t", "source as other", "p as q", "base as other_base")
    shared = a.join(b, F.expr("lang = l and term = t and source < other"))
    twice = lambda p, q, p0, q0: f"{value(p, q)} - {value(p, q0)} - {value(p0, q)} + {value(p0, q0)}"
    shared = shared.groupBy("lang", "source", "other").agg(
        F.expr(f"sum({twice('p', 'q', 'base', 'other_base')})").alias("v"), F.expr(f"sum({twice('q', 'p', 'other_base', 'base')})").alias("w")
    )
    shared = cut(shared, "shared-terms")
    back = shared.selectExpr("lang", "other as source", "source as other", "w as v")
    every = start.union(mine).union(theirs).union(shared.select("lang", "source", "other", "v")).union(back)
    return every.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("v").alias("value"))


def divergence(docs: DataFrame, top: int = TOP_TERMS, least_documents: int = LEAST_DOCUMENTS, **columns: str) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair``, the divergence of a source from each other
    one of its language; part ``term``, the ``top`` terms that a source has more of than its language."""
    counts = cut(term_counts(docs, **columns), "term-counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    terms = cut(terms.filter(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    langs = cut(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("words")), "languages")
    own = cut(counts.drop("docs").join(terms, ["lang", "term"]), "kept-counts")
    sizes = own.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("size"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left")
    groups = groups.join(sizes, F.expr("lang = l and source = s"), "left").selectExpr("lang", "source", "coalesce(size, 0) as size", "coalesce(terms, 0) as terms", "coalesce(words, 0) as words")
    groups = groups.withColumn("base", F.expr(f"case when terms > 0 then {share('0L', 'size + terms')} else 1 end"))
    groups = cut(groups, "groups")  # a row for each source of a language
    shares = own.join(groups.selectExpr("lang as l", "source as s", "size", "terms", "words", "base"), F.expr("lang = l and source = s"))
    shares = shares.selectExpr("lang", "source", "term", f"{share('n', 'size + terms')} as p", f"{share('all', 'words + terms')} as q", "base")
    shares = cut(shares, "shares-of-terms")
    pairs = _pairs(groups, shares.drop("q")).withColumn("part", F.lit("pair"))
    above = shares.filter("p > q").selectExpr("lang", "source", "term as item", f"{value('p', 'q')} as value")
    best = top_rows(above, ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))
    rows = pairs.unionByName(best)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")


def source_divergence(docs: DataFrame, **options) -> DataFrame:
    """``divergence``, written; the tables on the way are deleted."""
    return only(lambda: divergence(docs, **options), "divergence")
