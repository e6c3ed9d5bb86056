"""A whole build: from outline, pages and spans to the tables of a searchable wiki."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import sinks
from ..functions import registers as R
from ..operators import enrich as E, links as L, search as S, structure as T
from ..operators.calls import Policy
from ..operators.incremental import cache_key
from ..operators.layout import page_blocks, table_note_images
from ..operators.vectors import embed, section_chunks
from ..sources.cache import AnswerCache


#: Sections of a task: those of which a model is asked, each slow and lost where a task is, and those made here.
ASKED_IN_ONE, MADE_IN_ONE = 16, 16384


@dataclass(frozen=True)
class Settings:
    """Options of a build; ``tier`` gives the presets."""

    tier: str = "small"
    backend: str = "none"
    model: str | None = None
    dpi: int = 120
    semantic: bool = False
    chunk_chars: int = 1200
    max_pages: int = 0
    page_text_chars: int = 2500
    resume: bool = True
    calls: Policy = Policy()

    @classmethod
    def of(cls, tier: str, **overrides) -> Settings:
        presets = {"small": {}, "medium": {"backend": "ollama", "dpi": 150, "semantic": True}, "large": {"backend": "anthropic", "dpi": 200, "semantic": True}}
        unknown = set(overrides) - {f.name for f in fields(cls)}
        if tier not in presets or unknown:
            raise ValueError(f"unknown tier or options: {tier} {sorted(unknown)}")
        return replace(cls(tier=tier, **presets[tier]), **{k: v for k, v in overrides.items() if v is not None})


def page_manifest(pages: DataFrame, sections: DataFrame, images: DataFrame | None = None, chars: int = 2500) -> DataFrame:
    """``doc, n, img, sec, num, url, t`` of every page."""
    owners = T.page_owners(sections).select("doc", "page", "ord").join(
        sections.select("doc", "ord", T.short_title(F.col("title"), F.col("number")).alias("sec"), F.col("number").alias("num"), F.concat(F.lit("sections/"), "id", F.lit(".html")).alias("url")),
        ["doc", "ord"],
    ).drop("ord")
    out = pages.join(owners, ["doc", "page"], "left")
    shown = F.lit("")
    if images is not None:
        out = out.join(images.select("doc", "page", "image"), ["doc", "page"], "left")
        shown = F.coalesce(F.concat(F.lit("images/"), F.nullif("image", F.lit(""))), F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("doc", (F.col("page") + 1).alias("n"), shown.alias("img"), blank("sec"), blank("num"), blank("url"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("t"))


def register_map(sections: DataFrame, enrichments: DataFrame, svd: DataFrame | None = None) -> DataFrame:
    """Register groups: those of an SVD file if it has any, else what the sections show."""
    if svd is not None and not svd.isEmpty():
        from ..functions.text import slug

        return svd.select(F.lit("device").alias("doc"), slug("title").alias("id"), "title", F.lit("").alias("number"), F.lit("").alias("url"), "registers", F.lit("svd").alias("register_source"))
    rows = sections.join(enrichments, "section_id").filter("size(registers) > 0")
    return rows.select(
        "doc", F.col("id"), T.short_title(F.col("title"), F.col("number")).alias("title"), "number",
        F.concat(F.lit("sections/"), "id", F.lit(".html")).alias("url"), "registers", F.lit("heuristic").alias("register_source"),
    )


def site_stats(sections: DataFrame, enrichments: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``doc, sections, top_sections, registers, code, pages``."""
    rows = sections.join(enrichments, "section_id", "left")
    size = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))).cast("long")
    out = rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("sections"), F.sum((F.col("level") == 1).cast("long")).alias("top_sections"),
        size("registers").alias("registers"), size("code_examples").alias("code"),
    )
    return out.join(page_counts.select("doc", F.col("n_pages").cast("long").alias("pages")), "doc")


def exports(groups: DataFrame, device: str | Column, source: str | Column, by: str | None = None) -> DataFrame:
    """``c_header, svd``: one row for all groups, in order of their id, or one for each device of the
    column ``by``, which ``device`` and ``source`` may use.  Registers are written one by one; a row holds
    the texts only (2 GB at most, as any value: ``export_pieces`` has no such bound)."""
    keys, of = [by] * bool(by), [x if isinstance(x, Column) else F.lit(x) for x in (device, source)]
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = groups.withColumn("group", F.monotonically_increasing_id()).select(*keys, "group", "id", "title", F.posexplode_outer("registers").alias("at", "r")).repartition(parts)
    c, svd = F.array_join(R.header_lines(F.col("r")), "\n"), R.svd_register_xml(F.col("r"))
    made = one.select(*keys, "group", "id", "title", "at", *[F.when(F.col("r").isNotNull(), x).alias(n) for n, x in (("c", c), ("x", svd))])
    lines = made.groupBy(*keys, "group").agg(F.first("id").alias("id"), F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("at", "c", "x"))).alias("m"))
    joined = lambda n: F.array_join(F.transform("m", lambda e: e[n]), "\n")
    texts = lines.select(
        *keys, "id", "title", F.concat_ws("\n", R.header_title(F.col("title")), F.nullif(joined("c"), F.lit(""))).alias("c"), F.exists("m", lambda e: e["c"].isNotNull()).alias("some"),
        F.when(F.exists("m", lambda e: e["x"].isNotNull()), F.concat_ws("\n", R.peripheral_head(F.col("title")), joined("x"), F.lit(R.PERIPHERAL_TAIL))).alias("x"),
    )
    packed = (texts.groupBy(by) if by else texts).agg(F.array_sort(F.collect_list(F.struct("id", "title", "c", "x"))).alias("g"), F.max("some").alias("some"), F.count("x").alias("shown"))
    whole = lambda n: F.array_join(F.transform("g", lambda e: e[n]), "\n")
    (head, tail), (top, end) = R.header_frame(*of), R.svd_frame(*of)
    header = F.concat(F.array_join(head, "\n"), F.lit("\n"), whole("c"), F.lit("\n"), F.array_join(tail, "\n"), F.lit("\n"))
    document = F.concat(top, F.lit("\n"), whole("x"), F.lit("\n"), end, F.lit("\n"))
    return packed.select(*keys, F.when(F.col("some"), header).otherwise("").alias("c_header"), F.when(F.col("shown") > 0, document).alias("svd"))


def export_pieces(groups: DataFrame, kind: str, device: str | Column, source: str | Column, by: str = "doc") -> DataFrame:
    """``by, place, text``: C headers (``kind`` "c") or CMSIS-SVD documents ("svd") of the devices of column
    ``by``, in pieces: a device's file is its texts in order of ``place``, each with a newline at the end.

    One piece for each register, so that no row holds a device's; a device without registers (with an
    address, in SVD) has none.  ``sinks.write_exports`` makes files of them.
    """
    of = [x if isinstance(x, Column) else F.lit(x) for x in (device, source)]
    element = R.header_lines if kind == "c" else R.svd_register_xml
    place = lambda part, at: F.struct(F.lit(part).alias("part"), *([F.col("id"), F.col("title")] if part == 1 else [F.lit("").alias("id"), F.lit("").alias("title")]), F.lit(at).alias("at") if isinstance(at, int) else at.alias("at"))
    rows = groups.select(by, "id", "title", of[0].alias("device"), of[1].alias("source"), "registers")
    made = rows.select(by, "id", "title", F.posexplode("registers").alias("at", "r")).withColumn("x", element(F.col("r"))).filter("x is not null")
    body = made.select(by, place(1, F.col("at") + 1).alias("place"), (F.array_join("x", "\n") if kind == "c" else F.col("x")).alias("text"))
    some = F.size("registers") > 0 if kind == "c" else F.exists("registers", lambda r: element(r).isNotNull())
    named = rows.withColumn("some", some)
    devices = named.groupBy(by).agg(F.max("some").alias("some"), F.min("device").alias("device"), F.min("source").alias("source")).filter("some")
    head, tail = (R.header_frame if kind == "c" else R.svd_frame)(F.col("device"), F.col("source"))
    if kind == "c":
        head, tail = F.array_join(head, "\n"), F.array_join(tail, "\n")
        frames = [named.join(devices.select(by), by, "left_semi").select(by, place(1, 0).alias("place"), R.header_title(F.col("title")).alias("text"))]
    else:
        shown = named.filter("some")
        frames = [
            shown.select(by, place(1, 0).alias("place"), R.peripheral_head(F.col("title")).alias("text")),
            shown.select(by, place(1, 1 << 30).alias("place"), F.lit(R.PERIPHERAL_TAIL).alias("text")),
        ]
    frames += [devices.select(by, place(0, 0).alias("place"), head.alias("text")), devices.select(by, place(2, 0).alias("place"), tail.alias("text"))]
    for frame in frames:
        body = body.unionByName(frame)
    return body


def rendered_sections(sections: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``doc, id, html``: blocks where there are some, else the raw text as paragraphs."""
    raw = L.bodies(sections)
    if blocks is None:
        return raw
    own = L.block_bodies(sections, blocks).select("doc", "id", F.col("html").alias("own"))
    return raw.join(own, ["doc", "id"], "left").select("doc", "id", F.coalesce("own", "html").alias("html"))


def answer_cache(spark: SparkSession, path: str, buckets: int = 32) -> AnswerCache:
    """The cache of a build's enrichments below ``path``."""
    return AnswerCache(spark, path, E.ENRICHMENT, buckets=buckets)


def enriched(sections: DataFrame, settings: Settings, cache: AnswerCache) -> DataFrame:
    """Enrichments of ``sections`` (``section_id, title, text``) by way of ``cache``, keyed by backend,
    model, title and text: only what it lacks is made, once a key, and added as it is made; all of it
    where ``settings`` say not to resume."""
    spark = sections.sparkSession
    backend = E.get_backend(settings.backend)
    if not E.available(backend):
        warnings.warn(f"the backend {backend} can't be reached: sections that the cache lacks keep their heuristic enrichment", stacklevel=3)
    key = cache_key(F.lit(backend), F.lit(settings.model), F.col("title"), F.col("text"))
    keyed = sections.select("section_id", "title", "text", key.alias("cache_key"))
    lacking = cache.lacking(keyed) if settings.resume else keyed.dropDuplicates(["cache_key"])
    path = sinks.temporary(spark, "lacking")
    sinks.write_table(lacking.select("cache_key", "title", "text"), path)
    lacking = spark.read.schema("cache_key string, title string, text string").parquet(path)
    if n := lacking.count():
        each = MADE_IN_ONE if backend == "none" else ASKED_IN_ONE
        cache.add(E.enrich(lacking, backend, settings.model, "cache_key", settings.calls, cache.tasks(n, each)))
    return keyed.select("section_id", "cache_key").join(cache.read(), "cache_key").drop("cache_key")


def build(
    outline: DataFrame, pages: DataFrame, spans: DataFrame | None = None, images: DataFrame | None = None, settings: Settings = Settings(),
    svd: DataFrame | None = None, embedder: Callable | None = None, figures: DataFrame | None = None, cache: AnswerCache | None = None,
) -> dict[str, DataFrame]:
    """All tables of a build by name; nothing runs before they are written or read, but that ``svd``
    (register groups, see ``sources.svd``) is looked at for rows, and that sections are enriched at once
    where a ``cache`` (see ``answer_cache``) is given or a model is asked; the latter without a cache
    keeps its answers for the session.  ``semantic`` settings add
    ``chunks``, and with an ``embedder`` (the factory of ``vectors.embed``) their ``vectors``.
    ``figures`` (``layout.figure_blocks``) lie among the blocks of pages that are no tables."""
    if settings.max_pages:
        pages = pages.filter(F.col("page") < settings.max_pages)
    counts = pages.groupBy("doc").agg((F.max("page") + 1).cast("int").alias("n_pages"))
    sections = T.attach_text(T.build_sections(outline, counts, settings.max_pages), pages)
    sections = sections.withColumn("section_id", F.concat_ws("/", "doc", "id"))
    if cache is None and E.get_backend(settings.backend) != "none":
        cache = answer_cache(pages.sparkSession, sinks.temporary(pages.sparkSession, "answers"))
    named = sections.select("section_id", "title", "text")
    enrichments = E.enrich(named) if cache is None else enriched(named, settings, cache)
    crumbs = T.breadcrumbs(sections)
    searched = sections.join(crumbs, ["doc", "id"], "left").join(enrichments.select("section_id", "summary"), "section_id", "left")
    out = {
        "sections": sections, "enrichments": enrichments, "children": T.children(sections), "breadcrumbs": crumbs,
        "postings": S.postings(searched, "section_id"), "search_docs": S.index_docs(searched),
        "page_manifest": page_manifest(pages, sections, images, settings.page_text_chars),
        "xrefs": T.xrefs(sections.select("doc", F.col("id").alias("src"), "text"), sections),
        "stats": site_stats(sections, enrichments, counts), "register_map": register_map(sections, enrichments, svd),
    }
    device = F.regexp_extract("doc", r"([^/]*?)(?:\.[^./]*)?/*$", 1)
    for kind in ("c", "svd"):
        out[f"export_{kind}"] = export_pieces(out["register_map"], kind, device, F.col("doc"))
    if settings.semantic:
        out["chunks"] = section_chunks(sections, "section_id", limit=settings.chunk_chars)
        if embedder is not None:
            out["vectors"] = embed(out["chunks"], embedder)
    blocks = None
    if spans is not None:
        blocks = page_blocks(spans, pages)
        none = pages.select("doc", "page", F.lit(None).cast("string").alias("image")).limit(0)
        blocks = table_note_images(blocks, images if images is not None else none)
        if figures is not None:
            tables = blocks.filter("kind = 'table_note'").select("doc", "page").distinct()
            blocks = blocks.unionByName(figures.join(tables, ["doc", "page"], "left_anti"))
        out["blocks"] = blocks
    out["sections_html"] = rendered_sections(sections, blocks)
    return out
