"""PDF files as tables; decoding needs the optional ``fitz`` library.

``read_pdf`` reads any path that Spark lists: files come as ``binaryFile`` rows and are decoded where
they arrive.  For files that every executor can open there is also a Python data source, which decodes
only the pages that a query's filters on documents and pages leave (``source_reader`` turns that on):

    source_reader(spark).option("table", "pages").load("/docs/*.pdf").filter("page < 10")

Spark keeps with a load what was last taken over from filters, so load again for other filters.

Tables: ``docs`` (doc, title, n_pages; the title is the file's own or else its stem), ``pages`` (doc,
page, width, height, text), ``outline`` (doc, ord, level, title, page), ``links`` (doc, src_page,
dest_page, left, top, right, bottom, text), ``spans`` (see ``operators.layout``) and ``figures``
(embedded images: doc, page, number, ext, width, height, top, bottom, image, text that lies over
them).  A page that cannot be laid out gives no spans or figures.  A file of more than
``SPLIT_BYTES`` is read by several tasks, each of which decodes its share of the pages; ``max_pages``
stops the scan early.

Page images and crops are rendered from rows that name them, so that only what is missing is made.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

TABLES = {
    "docs": "doc string, title string, n_pages int",
    "figures": "doc string, page int, number int, ext string, width int, height int, top double, bottom double, image binary, text string",
    "pages": "doc string, page int, width double, height double, text string",
    "outline": "doc string, ord int, level int, title string, page int",
    "links": "doc string, src_page int, dest_page int, left double, top double, right double, bottom double, text string",
    "spans": (
        "doc string, page int, block_no int, line_no int, span_no int, block_type int, text string, size double, flags int, "
        "font string, top double, bottom double, left double"
    ),
}


#: Bytes of a file that one task decodes; page tables only, the others take a glance.
SPLIT_BYTES = 64 << 20
#: Pages that are rendered from one copy of a file.
RENDERED_AT_ONCE = 32
PAGE = {"pages": "page", "links": "src_page", "spans": "page", "figures": "page"}


class Decoder:
    """The rows of one table of an open file: of the share ``part`` of ``parts`` of its pages, those from
    ``low`` up to and not including ``high``, and of ``limit`` pages at most."""

    def __init__(self, table: str, limit: int = 0, low: int = 0, high: int | None = None):
        self.table, self.limit, self.low, self.high = table, limit, low, high

    def wanted(self, n: int, part: int = 0, parts: int = 1) -> range:
        n = min(n, self.limit) if self.limit else n
        first, last = n * part // parts, n * (part + 1) // parts
        return range(max(first, self.low), last if self.high is None else min(last, self.high))

    def rows(self, doc: str, pdf, part: int = 0, parts: int = 1) -> Iterator[tuple]:
        if self.table == "outline":
            for k, (level, title, page) in enumerate(pdf.get_toc(simple=True)):
                yield doc, k, level, title, page
        elif self.table == "docs":
            yield doc, ((pdf.metadata or {}).get("title") or "").strip() or PurePath(doc).stem, len(pdf)
        else:
            for n in self.wanted(len(pdf), part, parts):
                yield from getattr(self, self.table)(doc, n, pdf[n])

    def pages(self, doc: str, n: int, page) -> Iterator[tuple]:
        yield doc, n, float(page.rect.width), float(page.rect.height), page.get_text("text")

    def links(self, doc: str, n: int, page) -> Iterator[tuple]:
        for link in page.get_links():
            if link.get("kind") == 1 and link.get("page", -1) >= 0:
                r = link["from"]
                yield doc, n, link["page"], *map(float, (r.x0, r.y0, r.x1, r.y1)), page.get_textbox(r).strip()

    def spans(self, doc: str, n: int, page) -> Iterator[tuple]:
        try:
            blocks = page.get_text("dict")["blocks"]
        except Exception:  # a broken page has no layout
            return
        for b, block in enumerate(blocks):
            left, top, _, bottom = map(float, block["bbox"])
            for i, line in enumerate(block.get("lines", [])):
                for s, span in enumerate(line["spans"]):
                    yield doc, n, b, i, s, block["type"], span["text"], float(span["size"]), span["flags"], span["font"], top, bottom, left


    def figures(self, doc: str, n: int, page) -> Iterator[tuple]:
        import fitz

        try:
            blocks = page.get_text("dict")["blocks"]
        except Exception:
            return
        for block in blocks:
            if block["type"] == 1:
                box = block["bbox"]
                over = page.get_textbox(fitz.Rect(box)).strip()
                yield doc, n, block.get("number", 0), block.get("ext", "png"), block.get("width", 0), block.get("height", 0), float(box[1]), float(box[3]), block.get("image"), over


class File(InputPartition):
    def __init__(self, path: str, part: int = 0, parts: int = 1):
        self.path, self.part, self.parts = path, part, parts


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.decoder = Decoder(options.get("table", "pages"), int(options.get("max_pages", 0)))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.paths = sorted(glob.glob(options["path"]))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        parts = lambda p: max(1, -(-os.path.getsize(p) // self.split)) if self.decoder.table in PAGE else 1
        return [File(p, k, n) for p in self.paths for n in [parts(p)] for k in range(n)]

    def read(self, partition: File) -> Iterator[tuple]:
        import fitz  # optional

        with fitz.open(partition.path) as pdf:
            yield from self.decoder.rows(partition.path, pdf, partition.part, partition.parts)


class PushingReader(PdfReader):
    """Takes over filters on documents and pages: files are left out where the query is planned, pages
    are not decoded."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if not (self._document(f) if name == "doc" else name is not None and name == PAGE.get(self.decoder.table) and self._page(f)):
                yield f

    def _document(self, f: Filter) -> bool:
        test = {EqualTo: lambda p: p == f.value, In: lambda p: p in f.value, StringStartsWith: lambda p: p.startswith(f.value)}.get(type(f))
        if test:
            self.paths = [p for p in self.paths if test(p)]
        return test is not None

    def _page(self, f: Filter) -> bool:
        low, high = {
            LessThan: lambda: (0, f.value), LessThanOrEqual: lambda: (0, f.value + 1), GreaterThan: lambda: (f.value + 1, None),
            GreaterThanOrEqual: lambda: (f.value, None), EqualTo: lambda: (f.value, f.value + 1),
        }.get(type(f), lambda: (None, None))()
        if low is None:
            return False
        d = self.decoder
        d.low, d.high = max(d.low, low), high if d.high is None else d.high if high is None else min(d.high, high)
        return True


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_pdf"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "pages")]

    def reader(self, schema) -> PdfReader:
        return (PushingReader if str(self.options.get("pushdown", "")).lower() == "true" else PdfReader)(self.options)


def source_reader(spark: SparkSession) -> DataFrameReader:
    """A reader of the data source that takes filters over; switches them on for the session."""
    spark.dataSource.register(PdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folio_pdf").option("pushdown", "true")


def files(spark: SparkSession, path: str) -> DataFrame:
    """``doc, length, content`` of files, on any file system that Spark reads."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("doc"), "length", "content")


def read_pdf(spark: SparkSession, path: str, table: str = "pages", max_pages: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A table of the files at ``path``, wherever Spark can read them.

    Small files are decoded in the task that reads them; of a large one every share of its pages gets a
    copy of the file."""
    decoder = Decoder(table, max_pages)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz  # optional

        for frame in frames:
            for doc, content, part, parts in frame[["doc", "content", "part", "parts"]].itertuples(index=False):
                with fitz.open(stream=content, filetype="pdf") as pdf:
                    rows = list(decoder.rows(doc, pdf, part, parts))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TABLES[table].split(", ")])

    found = files(spark, path)
    parts = F.greatest(F.ceil(F.col("length") / split_bytes), F.lit(1)).cast("int") if table in PAGE else F.lit(1)
    found = found.withColumn("parts", parts)
    small = found.filter("parts = 1").withColumn("part", F.lit(0)).select("doc", "content", "part", "parts")
    out = small.mapInPandas(decode, TABLES[table])
    shares = found.agg(F.sum(F.when(F.col("parts") > 1, F.col("parts")))).first()[0]  # of a listing, no content
    if shares:
        large = found.filter("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        large = large.select("doc", "content", "part", "parts").repartition(shares, "doc", "part")
        out = out.union(large.mapInPandas(decode, TABLES[table]))
    return out


def wanted_images(pages: DataFrame, ext: str = "png") -> DataFrame:
    """``doc, page, image``: the name of every page's image."""
    return pages.select("doc", "page", F.format_string(f"page-%04d.{ext}", F.col("page") + 1).alias("image"))


def _drawn(wanted: DataFrame, columns: str, matrix: float, clip=None, path: str | None = None) -> DataFrame:
    """``wanted`` (``columns``, of which doc and page come first) with ``bytes`` and ``samples`` of what each
    row shows.  With ``path`` files are read by Spark, a copy for every ``RENDERED_AT_ONCE`` pages or so;
    without, executors open ``doc`` themselves."""
    names = [c.split()[0] for c in columns.split(", ")]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for frame in frames:
            for doc, rows in frame.groupby("doc", sort=False):
                with fitz.open(doc) if path is None else fitz.open(stream=rows["content"].iloc[0], filetype="pdf") as pdf:
                    items = rows.to_dict("records") if path is None else [r for group in rows["rows"] for r in group]
                    for row in items:
                        page = pdf[row["page"]]
                        pix = page.get_pixmap(matrix=fitz.Matrix(matrix, matrix), alpha=False, **({"clip": clip(page, row)} if clip else {}))
                        yield pd.DataFrame([[*(row[n] for n in names), pix.tobytes("png"), bytes(pix.samples) if clip else None]], columns=[*names, "bytes", "samples"])

    rows = wanted.select(*names)
    if path is not None:
        share = F.floor(F.col("page") / RENDERED_AT_ONCE)
        groups = rows.groupBy("doc", share.alias("share")).agg(F.collect_list(F.struct(*names)).alias("rows"))
        rows = groups.join(files(wanted.sparkSession, path).select("doc", "content"), "doc").select("doc", "rows", "content").repartition("doc", "rows")
    return rows.mapInPandas(draw, f"{columns}, bytes binary, samples binary")


def render_pages(wanted: DataFrame, dpi: int = 120, path: str | None = None) -> DataFrame:
    """``doc, page, image, bytes`` of the pages of ``wanted`` (see ``wanted_images``), whose files Spark
    reads from ``path`` if given."""
    return _drawn(wanted, "doc string, page int, image string", dpi / 72, None, path).drop("samples")


def crop_gaps(gaps: DataFrame, dpi: int = 110, least_range: int = 22, path: str | None = None) -> DataFrame:
    """Drawings in vertical gaps (``layout.vertical_gaps``): ``doc, page, image_rel, top, bytes``; gaps
    whose sampled pixels hardly differ are blank and go."""
    from ..operators.layout import pixel_range

    def clip(page, row):
        import fitz

        return fitz.Rect(page.rect.x0 + 36, row["gap_top"] + 2, page.rect.x1 - 36, row["gap_bottom"] - 2)

    rows = gaps.select("doc", "page", F.col("gap_top").cast("double"), F.col("gap_bottom").cast("double"))
    made = _drawn(rows, "doc string, page int, gap_top double, gap_bottom double", dpi / 72, clip, path)
    name = F.format_string("figures/fig-p%04d-gap%d.png", F.col("page") + 1, F.col("gap_top").cast("long"))
    kept = made.filter(pixel_range(F.col("samples")) >= least_range)
    return kept.select("doc", "page", name.alias("image_rel"), ((F.col("gap_top") + F.col("gap_bottom")) / 2).alias("top"), "bytes")
