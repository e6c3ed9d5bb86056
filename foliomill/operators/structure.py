"""From an outline and pages to a tree of sections.

``outline``: doc, ord, level, title, page (0-based).  ``pages``: doc, page, text.  Windows are per
document, whose outline has thousands of entries at most; documents are independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import slug, strip

NUMBER = r"^([0-9.]*[0-9])\.*(?=\s|$)"


def outline_rows(raw: DataFrame) -> DataFrame:
    """Outline as read from a file (1-based pages, -1 for none) in normal form; blank titles go."""
    title = strip(F.regexp_replace("title", r"(?U)\s+", " "))
    return raw.withColumn("title", title).withColumn("page", F.greatest(F.col("page") - 1, F.lit(0))).filter(F.col("title") != "")


def parse_number(title: Column) -> Column:
    return F.regexp_extract(strip(title), NUMBER, 1)


def short_title(title: Column, number: Column) -> Column:
    t = strip(title)
    rest = F.regexp_extract(F.substring(t, F.length(number) + 1, F.length(t)), r"(?U)^\.?(?:\s+|$)(.*)", 1)
    return F.when((number == "") | ~t.startswith(number), t).otherwise(F.coalesce(F.nullif(rest, F.lit("")), t))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("p.%d", start + 1)).otherwise(F.format_string("pp.%d-%d", start + 1, end + 1))


def unique_ids(df: DataFrame, slug_col: str = "slug") -> DataFrame:
    """``id``: the slug, from its second use on with a counter."""
    nth = F.row_number().over(Window.partitionBy("doc", slug_col).orderBy("ord")) - 1
    return df.withColumn("id", F.when(nth == 0, F.col(slug_col)).otherwise(F.concat(F.col(slug_col), F.lit("-"), nth.cast("string"))))


def fallback_sections(page_counts: DataFrame, group: int = 4) -> DataFrame:
    """Sections of ``group`` pages each, for documents without a usable outline."""
    starts = page_counts.filter("n_pages > 0").withColumn("start_page", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(group))))
    out = starts.withColumn("end_page", F.least(F.col("start_page") + group - 1, F.col("n_pages") - 1))
    out = out.withColumn("title", F.format_string("Pages %d-%d", F.col("start_page") + 1, F.col("end_page") + 1))
    out = unique_ids(out.withColumn("ord", (F.col("start_page") / group).cast("int")).withColumn("slug", slug("title")))
    return out.select("doc", "ord", "id", "title", F.lit(1).alias("level"), "start_page", "end_page", F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("number"))


def _fold(pages: list, levels: list, ids: list) -> tuple[list, list]:
    """Of one document's entries the parent and the page of the next entry that starts no earlier."""
    parents, following, open_, ahead = [], [None] * len(pages), [], []
    for level, name in zip(levels, ids):
        level = math.nan if level is None else level  # no entry is above or below it
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parents.append(open_[-1][1] if open_ else None)
        open_.append((level, name))
    for k in range(len(pages) - 1, -1, -1):  # pages ahead, each before a larger one
        while ahead and ahead[-1] < pages[k]:
            ahead.pop()
        following[k] = ahead[-1] if ahead else None
        ahead.append(pages[k])
    return parents, following


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by document and place, with parent and next page: many documents a batch, as a
    data frame for each costs far more than its fold.  The last document of a batch waits for the next."""
    def folded(held: pa.Table, docs: list) -> Iterator[pa.RecordBatch]:
        pages, levels, ids = (held[c].to_pylist() for c in ("page", "level", "id"))
        parents, following, a = [], [], 0
        for _, same in groupby(docs):
            b = a + sum(1 for _ in same)
            for out, more in zip((parents, following), _fold(pages[a:b], levels[a:b], ids[a:b])):
                out += more
            a = b
        held = held.append_column("parent_id", pa.array(parents, pa.string())).append_column("next_page", pa.array(following, pa.int32()))
        yield from held.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        docs = batch["doc"].to_pylist()
        if not docs:
            continue
        last = docs.index(docs[-1])  # sorted: where the batch's last document begins
        if held and held[-1]["doc"][-1].as_py() != docs[0] or last:
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            yield from folded(whole, whole["doc"].to_pylist())
            held = []
        held.append(batch.slice(last))
    if held:
        whole = pa.Table.from_batches(held)
        yield from folded(whole, whole["doc"].to_pylist())


def build_sections(outline: DataFrame, page_counts: DataFrame, max_pages: int = 0) -> DataFrame:
    """``doc, ord, id, title, level, start_page, end_page, parent_id, number``.

    A section ends before the next entry that starts on a later page, whatever its level, and on its
    own page if the next entry starts there too.  Its parent is the nearest earlier entry of a lower
    level.  Both are found in one fold with a stack, linear in a document's outline.  Documents
    without entries in range get page groups instead.
    """
    counts = page_counts.select("doc", F.least("n_pages", F.lit(max_pages)).alias("n_pages") if max_pages else F.col("n_pages"))
    items = outline.select("doc", "ord", "level", "title", "page").join(counts, "doc").filter(F.col("page") < F.col("n_pages"))
    items = unique_ids(items.withColumn("slug", slug("title"))).drop("slug")
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes)
    sorted_ = items.repartition("doc").sortWithinPartitions("doc", F.asc_nulls_last("ord"))
    items = sorted_.mapInArrow(_trees, f"{schema}, parent_id string, next_page int")
    nxt = F.col("next_page")
    end = F.when(nxt.isNull(), F.col("n_pages") - 1).when(nxt == F.col("page"), nxt).otherwise(nxt - 1)
    built = items.select(
        "doc", "ord", "id", "title", "level", F.col("page").alias("start_page"), F.greatest(end, F.col("page")).alias("end_page"),
        "parent_id", parse_number(F.col("title")).alias("number"),
    )
    covered = outline.select("doc", "page").join(counts, "doc").filter(F.col("page") < F.col("n_pages")).select("doc").distinct()
    return built.unionByName(fallback_sections(counts.join(covered, "doc", "left_anti")))


def section_pages(sections: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per section and page it spans: a range join as an equi-join on pages."""
    return sections.select("doc", *(keep or ["ord", "id", "level"]), F.explode(F.sequence("start_page", "end_page")).alias("page"))


def attach_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``sections`` with the text of their pages, in order, joined by newlines."""
    spans = section_pages(sections, ["ord"]).join(pages.select("doc", "page", "text"), ["doc", "page"])
    texts = spans.groupBy("doc", "ord").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    texts = texts.select("doc", "ord", strip(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("text"))
    return sections.join(texts, ["doc", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_owners(sections: DataFrame) -> DataFrame:
    """``doc, page, id``: the deepest section on each page, the first in the outline of equals."""
    best = F.max_by(F.struct("id", "ord"), F.struct(F.col("level"), -F.col("ord")))
    return section_pages(sections).groupBy("doc", "page").agg(best.alias("b")).select("doc", "page", "b.id", "b.ord")


def children(sections: DataFrame) -> DataFrame:
    """``doc, id, children`` in order, of sections that have some."""
    rows = sections.filter("parent_id is not null").groupBy("doc", F.col("parent_id").alias("id"))
    found = rows.agg(F.array_sort(F.collect_list(F.struct("ord", F.col("id").alias("child")))).alias("c"))
    return found.select("doc", "id", F.transform("c", lambda x: x["child"]).alias("children"))


def _crumbs(frame: pd.DataFrame) -> pd.DataFrame:
    paths: dict[str, tuple[str, int]] = {}
    out = []
    for name, parent, title in frame.sort_values("ord")[["id", "parent_id", "title"]].itertuples(index=False):
        path, depth = paths.get(parent, ("", 0))
        paths[name] = (f"{path} › {title}" if depth else title, depth + 1)
        out.append((name, *paths[name]))
    return pd.DataFrame(out, columns=["id", "breadcrumb", "depth"]).assign(doc=frame["doc"].iloc[0])[["doc", "id", "breadcrumb", "depth"]]


def breadcrumbs(sections: DataFrame) -> DataFrame:
    """``doc, id, breadcrumb, depth``: titles from the root down, by one pass over each document's
    sections in order, in which parents come before their children."""
    kind = dict(sections.dtypes)["doc"]
    return sections.select("doc", "ord", "id", "parent_id", "title").groupBy("doc").applyInPandas(_crumbs, f"doc {kind}, id string, breadcrumb string, depth int")


def info(title: str, n_pages: int, outline: DataFrame, limit: int = 60) -> list[str]:
    """What a document holds, line by line: title, pages, and the first ``limit`` outline entries
    (``outline_rows`` of one document)."""
    n = outline.count()
    rows = outline.orderBy("ord").limit(limit).collect()
    out = [f"Title:    {title}", f"Pages:    {n_pages}", f"Outline:  {n} entries"]
    out += [f"  {'  ' * (r['level'] - 1)}{r['title']}  (p.{r['page'] + 1})" for r in rows]
    return out + [f"  … {n - limit} more (use --limit)"] * (n > limit)


def neighbours(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("ord")
    return sections.withColumn("prev_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def link_targets(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with the section that owns their destination page."""
    owners = page_owners(sections).select("doc", F.col("page").alias("dest_page"), F.col("id").alias("target_section"))
    return links.join(owners, ["doc", "dest_page"], "left")


def lookup_maps(sections: DataFrame) -> DataFrame:
    """Per document ``numbers`` (section number to id, first wins) and ``pages`` (page to id)."""
    first = sections.filter("number <> ''").groupBy("doc", "number").agg(F.min_by("id", "ord").alias("id"))
    numbers = first.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("number", "id"))).alias("numbers"))
    pages = page_owners(sections).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("int"), "id"))).alias("pages"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return pages.join(numbers, "doc", "left").withColumn("numbers", F.coalesce("numbers", empty))


def xrefs(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """References of ``texts`` (doc, src, text) to sections: ``doc, src, kind, pos, ref, target``.

    A number without section falls back to its longest prefix that has one.  Different references are
    looked up once each (``links.resolved``); those without target keep a null.
    """
    from .. import constants as K
    from .links import resolved

    def found(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), r.alias("ref")))

    both = F.concat(found(K.SECTION_REF, "section"), found(K.PAGE_REF, "page"))
    refs = texts.select("doc", "src", F.explode_outer(both).alias("x")).select("doc", "src", "x.*").filter("kind is not null")
    return refs.join(resolved(refs, sections), ["doc", "kind", "ref"], "left").select("doc", "src", "kind", "pos", "ref", "target")
