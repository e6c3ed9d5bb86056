"""Cross references in texts become links: found with their places, resolved by joins, spliced.

References are marked in the escaped text, which is then split at its marks.  The references of all
texts, each one once, meet section numbers and page owners by equi-joins; what they lead to comes back to
a text as an array in the order of its references.  So a row carries its own references only, whatever
the number of sections and pages of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.html import anchor, block_html
from ..functions.text import bound, escape, paragraphs
from .structure import page_owners, section_pages

#: Letters that every reference holds, in any case; texts without them are not searched for references.
_LETTERS = "[SsſCcPp](?:[Ee][Cc][Tt]|[Hh][Aa][Pp]|[Aa][Gg][Ee])"
#: Between paragraphs, which hold no blank line; no reference reaches across it.
_BREAK = "\n\n\x01"


def may_refer(text: Column) -> Column:
    """Whether a text can hold a reference: one quick search instead of two."""
    return text.rlike(_LETTERS)


def marked(plain: Column) -> Column:
    """Escaped text, in which no ``<`` is left, with ``<s1.2<see Section 1.2<`` for a section reference and
    ``<p3<page 3<`` for a page reference: split at ``<``, each is three parts, what comes after included.

    Escapes neither make nor hide references.  A page reference right behind a section's number, with
    which it would be one word, is found as the mark parts them; ``spliced`` looks whether a link does."""
    sections = F.regexp_replace(plain, K.SECTION_REF, "<s$1<$0<")
    return F.when(may_refer(plain), F.regexp_replace(sections, K.PAGE_REF, "<p$1<$0<")).otherwise(plain)


def references(marks: Column) -> Column:
    """The references of a ``marked`` text in order: ``s`` or ``p`` and a number."""
    return F.regexp_extract_all(marks, F.lit("<([sp][^<]*+)<[^<]*+<"), F.lit(1))


def spliced(marks: Column, targets: Column, root: str = "") -> Column:
    """HTML of a ``marked`` text with links to ``targets``, escaped section ids or nulls by reference; null
    ``targets`` of a text without references."""
    def whole(parts: Column) -> Column:
        def piece(target: Column, i: Column) -> Column:
            label = F.get(parts, 3 * i + 2)
            tight = (i > 0) & (F.get(parts, 3 * i) == "") & F.get(parts, 3 * i + 1).startswith("p")
            to = F.when(~tight | F.get(targets, i - 1).isNotNull(), target)
            return F.concat(F.coalesce(anchor(to, label, root), label), F.get(parts, 3 * i + 3))

        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(targets, piece), ""))

    return F.when(targets.isNull(), marks).otherwise(bound(F.split(marks, "<"), whole))


def resolved(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc, kind, ref, target`` of the different references ``doc, kind, ref`` that lead somewhere: a
    section number or its longest known prefix of whole parts, a page's deepest section."""
    numbers = sections.filter("number <> ''").groupBy("doc", F.lit("section").alias("kind"), F.col("number").alias("place")).agg(F.min_by("id", "ord").alias("target"))
    pages = page_owners(sections).select("doc", F.lit("page").alias("kind"), (F.col("page") + 1).cast("string").alias("place"), F.col("id").alias("target"))
    parts = F.split("ref", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    places = F.when(F.col("kind") == "section", prefixes).otherwise(F.array(F.col("ref").try_cast("long").cast("string")))
    tries = refs.select("doc", "kind", "ref").distinct().select("doc", "kind", "ref", F.posexplode(places).alias("k", "place"))
    met = tries.join(numbers.unionByName(pages), ["doc", "kind", "place"])
    return met.groupBy("doc", "kind", "ref").agg(F.max_by("target", "k").alias("target"))


def _with_marks(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``__marked``, once for all that is made of it, and its references ``__refs``."""
    rows = rows.withColumn("__plain", escape(text)).withColumn("__marked", marked(F.col("__plain"))).drop("__plain")
    return rows.withColumn("__refs", references(F.col("__marked")))


def _refs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``doc, keys, __at, mark``: the references ``__refs`` as rows."""
    # outer: else the plan looks for references before it explodes them, and texts are searched twice
    return rows.select(*dict.fromkeys(["doc", *keys]), F.posexplode_outer("__refs").alias("__at", "mark")).filter("__at is not null")


def _leading(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc, mark, target``: as ``resolved``, by mark and with escaped ids."""
    kind = F.when(F.col("mark").startswith("s"), "section").otherwise("page")
    found = resolved(refs.select("doc", "mark").distinct().select("doc", kind.alias("kind"), F.expr("substr(mark, 2)").alias("ref")), sections)
    return found.select("doc", F.concat(F.left("kind", F.lit(1)), "ref").alias("mark"), escape(F.col("target")).alias("target"))


def _targets(refs: DataFrame, leading: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, __targets`` of the rows with references: what each of them leads to, in order."""
    met = refs.join(leading, ["doc", "mark"], "left")
    targets = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "target"))).alias("__t"))
    return targets.select(*keys, F.col("__t.target").alias("__targets"))


def linked(rows: DataFrame, sections: DataFrame, keys: list[str], text: str = "text", out: str = "html", root: str = "") -> DataFrame:
    """``rows`` with ``out`` for ``text``: escaped and with links.  ``doc`` is not null; a null text stays null.
    ``keys`` need not tell rows apart any more: they are numbered.

    Texts are marked once and written, and so is what references lead to, as few differ: where that is
    small, references need not be dealt by document and number to meet it."""
    from .. import sinks

    path = sinks.temporary(rows.sparkSession, "links")

    def written(df: DataFrame, name: str, by: str) -> DataFrame:
        df.write.option("compression", by).parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    made = _with_marks(rows, F.col(text))
    others = [c for c in rows.columns if c not in (text, out)]
    texts = written(made.select(*others, "__marked", "__refs", F.monotonically_increasing_id().alias("__row")), "texts", "zstd")
    refs = _refs(texts, ["__row"])
    targets = _targets(refs, written(_leading(refs, sections), "targets", "none"), ["__row"])  # plain: its size tells whether it is small
    html = spliced(F.col("__marked"), F.col("__targets"), root)
    return texts.drop("__refs").join(targets, "__row", "left").select(*others, html.alias(out))


def bodies(sections: DataFrame, root: str = "") -> DataFrame:
    """``doc, id, html``: the paragraphs of raw section text.

    A section stays one row, its paragraphs one text with breaks, and rows meet by ``doc, ord``, by which
    ``attach_text`` has left them: no text is shuffled here."""
    keys, text = ["doc", "ord"], F.array_join(paragraphs(F.col("text")), _BREAK)
    rows = sections.select(*keys, "id", "text")
    refs = _refs(_with_marks(rows.filter(may_refer(F.col("text"))), text), keys)
    targets = _targets(refs, _leading(refs, sections), keys)
    html = _with_marks(rows, text).drop("__refs").join(targets, keys, "left").select("doc", "id", spliced(F.col("__marked"), F.col("__targets"), root).alias("html"))
    shown = F.replace(F.replace("html", F.lit("\n"), F.lit("<br>")), F.lit(_BREAK.replace("\n", "<br>")), F.lit("</p>\n<p>"))
    return html.select("doc", "id", F.when(F.col("html") != "", F.concat(F.lit("<p>"), shown, F.lit("</p>"))).otherwise(K.EMPTY_BODY).alias("html"))


def block_bodies(sections: DataFrame, blocks: DataFrame, root: str = "") -> DataFrame:
    """``doc, id, html`` of the sections that have ``blocks`` (``doc, page, at, kind, text, level, items,
    image_rel, summary``) which show something, in order."""
    order = [F.col(c) for c in ("page", "at", "kind", "text", "level", "items", "image_rel", "summary")]
    own = section_pages(sections, ["id"]).join(blocks, ["doc", "page"])
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("doc", "id").orderBy(*order)))  # a section's blocks
    texts = F.concat(F.array(F.when(F.col("kind").isin("heading", "para"), F.col("text"))), F.when(F.col("kind") == "list", F.col("items")).otherwise(F.array()))
    rows = own.select("doc", "id", "n", F.posexplode(texts).alias("i", "text"))
    html = linked(rows, sections, ["doc", "id", "n", "i"], root=root)
    html = html.groupBy("doc", "id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "html"))).alias("t"))
    html = html.select("doc", "id", "n", F.transform("t", lambda t: t["html"]).alias("t"))
    made = own.join(html, ["doc", "id", "n"]).select(
        "doc", "id", "n", block_html(F.struct(*order), F.get("t", F.lit(0)), F.slice("t", 2, F.size("t")), root).alias("html")
    )
    whole = made.filter("html <> ''").groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("n", "html"))).alias("b"))
    return whole.select("doc", "id", F.array_join(F.transform("b", lambda b: b["html"]), "\n").alias("html"))
