"""Rendering of blocks and cross references to HTML, as column expressions.

``numbers`` maps section numbers to section ids and ``pages`` 0-based pages to section ids; where there
are many, ``operators.links`` resolves references by joins instead."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import bound, escape, lines, paragraphs, strip


def number_target(numbers: Column, number: Column) -> Column:
    """Section of a number, or of its longest known prefix of whole parts."""
    parts = F.split(number, r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return F.get(F.filter(F.transform(prefixes, lambda p: F.try_element_at(numbers, p)), lambda x: x.isNotNull()), F.lit(0))


def link(target: Column, label: Column, root: str = "") -> Column:
    """A link to a section; null without one."""
    return anchor(escape(target), label, root)


def anchor(target: Column, label: Column, root: str = "") -> Column:
    """A link to a section whose id is escaped; null without one."""
    return F.concat(F.lit(f'<a class="xref" href="{root}sections/'), target, F.lit('.html">'), label, F.lit("</a>"))


def found_in(text: Column, pattern: str) -> tuple[Column, Column]:
    """What precedes the first match of a pattern in a text, and an array of its matches: ``label``, ``ref``
    (group 1) and what comes ``after``.  The text is searched once for each of these, not once for each match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = lambda gaps: F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    piece = lambda label, after: F.struct(label.alias("label"), F.regexp_extract(label, pattern, 1).alias("ref"), after.alias("after"))
    return F.get(F.split(text, pattern, 2), F.lit(0)), F.zip_with(whole, bound(F.split(text, pattern, -1), rest), piece)


def _substitute(text: Column, pattern: str, target, root: str) -> Column:
    head, found = found_in(text, pattern)
    piece = lambda x: F.concat(F.coalesce(link(target(x["ref"]), x["label"], root), x["label"]), x["after"])
    return F.concat(head, F.array_join(F.transform(found, piece), ""))


def linkify(text: Column, numbers: Column, pages: Column, root: str = "") -> Column:
    """Escaped text whose section and page references are links; page references second."""
    out = _substitute(escape(text), K.SECTION_REF, lambda n: number_target(numbers, n), root)
    return _substitute(out, K.PAGE_REF, lambda n: F.try_element_at(pages, n.try_cast("int") - 1), root)


def bold(html: Column) -> Column:
    return F.replace(F.replace(html, F.lit(K.BOLD_START), F.lit("<strong>")), F.lit(K.BOLD_END), F.lit("</strong>"))


def inline(text: Column, numbers: Column, pages: Column, root: str = "") -> Column:
    return bold(linkify(text, numbers, pages, root))


def codefold(text: Column, summary: Column, kind: str) -> Column:
    """Collapsed monospace block that shows one line; empty for blank text."""
    body = strip(F.coalesce(text, F.lit("")))
    first = F.coalesce(F.get(F.filter(lines(body), lambda x: strip(x) != ""), F.lit(0)), F.lit(""))
    peek = strip(F.coalesce(summary, F.lit("")))
    peek = strip(F.regexp_replace(F.when(peek == "", first).otherwise(peek), r"(?U)\s+", " "))
    short = F.concat(F.regexp_replace(F.substring(peek, 1, 90), r"(?U)\s+\z", ""), F.lit("…"))
    peek = F.when(F.length(peek) > 90, short).otherwise(peek)
    label = "Table text" if kind == "table" else "Figure text"
    made = F.concat(
        F.lit(f'<details class="codefold codefold-{kind}"><summary><span class="cf-label">{label}</span> <code>'),
        escape(peek), F.lit("</code></summary><pre><code>"), escape(body), F.lit("</code></pre></details>"),
    )
    return F.when(body == "", "").otherwise(made)


def block_html(b: Column, text: Column, items: Column, root: str = "") -> Column:
    """HTML of a block ``kind, text, level, image_rel, summary, page``, with its text and items as linked."""
    tag = F.when(b["level"] == 2, "h4").when(b["level"] == 4, "h6").otherwise("h5")
    text = bold(text)
    items = F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), bold(i), F.lit("</li>"))), "")
    page = (b["page"] + 1).cast("string")
    image = F.coalesce(b["image_rel"], F.lit(""))
    picture = F.concat(F.lit(f'<figure class="dsfig"><img loading="lazy" src="{root}'), escape(image), F.lit('" alt="Figure from page '), page, F.lit('"></figure>'))
    fold = codefold(b["text"], F.lit("Text in figure"), "fig")
    named = F.concat(F.lit("image of page "), page)
    note = F.when(image != "", F.concat(F.lit(f'<a href="{root}'), escape(image), F.lit('" target="_blank" rel="noopener">'), named, F.lit("</a>"))).otherwise(named)
    return (
        F.when(b["kind"] == "heading", F.concat(F.lit("<"), tag, F.lit(' class="fmt-h">'), text, F.lit("</"), tag, F.lit(">")))
        .when(b["kind"] == "list", F.concat(F.lit('<ul class="fmt-list">'), items, F.lit("</ul>")))
        .when(b["kind"] == "figure", F.when(fold == "", picture).otherwise(F.concat(picture, F.lit("\n"), fold)))
        .when(b["kind"] == "codefold", codefold(b["text"], b["summary"], "table"))
        .when(b["kind"] == "table_note", F.concat(F.lit('<p class="tablenote">Detected table — see '), note, F.lit(".</p>")))
        .when(strip(text) != "", F.concat(F.lit("<p>"), text, F.lit("</p>")))
        .otherwise("")
    )


def render_blocks(blocks: Column, numbers: Column, pages: Column, root: str = "") -> Column:
    """HTML of an array of ``kind, text, level, items, image_rel, summary, page``."""
    linked = lambda text: linkify(text, numbers, pages, root)
    one = lambda b: block_html(b, linked(b["text"]), F.transform(b["items"], linked), root)
    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x != ""), "\n")


def render_body(text: Column, numbers: Column, pages: Column, root: str = "") -> Column:
    """Paragraphs of raw section text."""
    made = F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), F.replace(linkify(p, numbers, pages, root), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(strip(text) == "", K.EMPTY_BODY).otherwise(F.array_join(made, "\n"))


def badge(backend: Column, model: Column) -> Column:
    """Where an enrichment came from, as shown to readers."""
    return F.when(backend == "none", "heuristic").when(backend == "ollama", "local LLM").otherwise(
        F.coalesce(F.nullif(model, F.lit("")), backend)
    )
