"""From text spans to typed blocks.

``spans``: doc, page, block_no, line_no, span_no, block_type (0 text, 1 image), text, size, flags,
font, top, bottom, left (of the block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from .. import constants as K
from ..functions.text import classify, is_data_like, is_table_block, reflow, strip, strip_bold, word_total

PAGE = ["doc", "page"]
BLOCK = [*PAGE, "block_no"]


def is_bold(flags: Column, font: Column) -> Column:
    name = F.lower(F.coalesce(font, F.lit("")))
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(16) != 0) | name.rlike("bold|black|heavy|semibold")


def body_sizes(spans: DataFrame) -> DataFrame:
    """``doc, page, body``: the size of most characters, the first seen of equals."""
    place = F.struct("block_no", "line_no", "span_no")
    counts = spans.filter("block_type = 0").groupBy(*PAGE, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(place).alias("at"))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "at"))
    return counts.withColumn("nth", nth).filter("nth = 1").select(*PAGE, F.col("size").alias("body"))


def text_blocks(spans: DataFrame) -> DataFrame:
    """Reflowed blocks: ``text, max_size, bold_frac, lines, top, bottom, left``; blank ones go."""
    s = spans.filter("block_type = 0 and text <> ''").withColumn("bold", is_bold(F.col("flags"), F.col("font")))
    marked = F.when(F.col("bold"), F.concat(F.lit(K.BOLD_START), "text", F.lit(K.BOLD_END))).otherwise(F.col("text"))
    lines = s.groupBy(*BLOCK, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("span_no", marked.alias("t")))).alias("parts"),
        F.max("size").alias("max_size"), F.sum(F.length("text")).alias("n"), F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("b"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"),
    ).withColumn("line", F.array_join(F.transform("parts", lambda p: p["t"]), ""))
    blocks = lines.groupBy(*BLOCK).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"), F.max("max_size").alias("max_size"),
        (F.sum("b") / F.sum("n")).alias("bold_frac"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"),
    ).withColumn("lines", F.transform("ls", lambda x: x["line"])).drop("ls")
    return blocks.withColumn("text", reflow(F.col("lines"))).filter(strip(strip_bold(F.col("text"))) != "")


def table_pages(blocks: DataFrame) -> DataFrame:
    """Pages of at least ten texts that are mostly short cells: ``doc, page``."""
    t = strip(strip_bold(F.col("text")))
    rows = blocks.select(*PAGE, t.alias("t")).filter("t <> ''").groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.length("t") <= 8).cast("int")).alias("short"), F.sum(word_total(F.col("t"))).alias("words")
    )
    return rows.filter("n >= 10 and short / n >= 0.7 and words < 3 * n").select(*PAGE)


def merge_short(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of three or more short paragraphs become one folded block; ``blocks`` has kind, text,
    level, items, summary and the order column."""
    w = Window.partitionBy(*keys).orderBy(order)
    flag = (F.col("kind") == "para") & is_data_like(F.col("text"))
    island = F.sum(F.when(F.col("__cell"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("__cell", flag).withColumn("__island", island)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__island", "__cell")))
    runs = rows.filter("__cell and __n >= 3").groupBy(*keys, "__island").agg(
        F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), strip_bold(F.col("text")).alias("t")))).alias("c")
    )
    cells = F.transform(F.filter("c", lambda x: x["t"] != ""), lambda x: x["t"])
    folded = runs.select(
        *keys, order, F.lit("codefold").alias("kind"), F.array_join(cells, "\n").alias("text"), F.lit(0).alias("level"),
        F.array().cast("array<string>").alias("items"), F.array_join(cells, " ").alias("summary"),
    )
    return rows.filter("not (__cell and __n >= 3)").select(*folded.columns).unionByName(folded)


def page_blocks(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of every page in reading order: ``doc, page, top, kind, text, level, items, summary``."""
    raw = text_blocks(spans).join(body_sizes(spans), PAGE, "left").withColumn("body", F.coalesce("body", F.lit(K.BODY_SIZE)))
    cells = F.filter(F.transform("lines", lambda x: strip(strip_bold(x))), lambda x: x != "")
    made = classify(F.col("text"), F.col("max_size"), F.col("body"), F.col("bold_frac"))
    grid = F.struct(
        F.lit("codefold").alias("kind"), F.array_join(cells, "\n").alias("text"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("items")
    )
    typed = raw.withColumn("b", F.when(is_table_block(F.col("lines")), grid).otherwise(made))
    summary = F.when(is_table_block(F.col("lines")), F.array_join(cells, " ")).otherwise("")
    typed = typed.select(*BLOCK, "top", summary.alias("summary"), "b.*", F.col("text").alias("__text"))
    tables = table_pages(raw)
    plain = typed.join(tables, PAGE, "left_anti").withColumn("at", F.struct("top", "block_no"))
    merged = merge_short(plain.select(*PAGE, "at", "kind", "text", "level", "items", "summary"), PAGE, "at")
    whole = tables.join(pages.select(*PAGE, "text"), PAGE)
    none = F.array().cast("array<string>")
    note = lambda kind, text, n: whole.select(*PAGE, F.struct(F.lit(float(n)).alias("top"), F.lit(n).alias("block_no")).alias("at"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(0).alias("level"), none.alias("items"), F.lit("").alias("summary"))
    notes = note("table_note", F.lit(""), 0).unionByName(note("codefold", strip(F.col("text")), 1).filter("text <> ''"))
    return merged.unionByName(notes)


def single_column(blocks: DataFrame, within: float = 120) -> DataFrame:
    """Per page whether all text starts at about the same place."""
    return blocks.groupBy(*PAGE).agg(((F.count(F.lit(1)) < 2) | (F.max("left") - F.min("left") < within)).alias("single_column"))


def vertical_gaps(blocks: DataFrame, page_sizes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Gaps between consecutive blocks that may hold a drawing: ``doc, page, gap_top, gap_bottom``.

    ``page_sizes``: doc, page, width, height; ``images``: doc, page, top, bottom of placed images.
    """
    w = Window.partitionBy(*PAGE).orderBy("top", "block_no")
    gaps = blocks.withColumn("gap_bottom", F.lead("top").over(w)).withColumnRenamed("bottom", "gap_top").filter("gap_bottom is not null")
    gaps = gaps.join(page_sizes, PAGE).filter("gap_bottom - gap_top >= greatest(64.0, height * 0.12)").filter("width - 72 >= 60 and gap_bottom - gap_top - 4 >= 50")
    gaps = gaps.select(*PAGE, "gap_top", "gap_bottom")
    if images is not None:
        taken = images.select(*PAGE, F.col("top").alias("i0"), F.col("bottom").alias("i1"))
        gaps = gaps.join(taken, [gaps.doc == taken.doc, gaps.page == taken.page, gaps.gap_bottom > taken.i0, gaps.gap_top < taken.i1], "left_anti")
    return gaps


def large_images(images: DataFrame, least: int = 48) -> DataFrame:
    """Embedded images big enough to be figures, with the file name they are saved under."""
    name = F.format_string("figures/fig-p%04d-%d.%s", F.col("page") + 1, "number", F.coalesce("ext", F.lit("png")))
    return images.filter((F.col("width") >= least) & (F.col("height") >= least) & F.col("image").isNotNull()).withColumn("image_rel", name)


@F.pandas_udf(IntegerType())
def pixel_range(samples):
    """Range of sampled pixel values; a gap below 22 is blank."""
    return samples.map(lambda b: 0 if not b else max(b[:: max(1, len(b) // 4096)]) - min(b[:: max(1, len(b) // 4096)]))


def figure_blocks(images: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """Blocks of kind ``figure``, from embedded images (``large_images``; the text over them with
    them) and crops of gaps (``sources.pdf.crop_gaps``), to be laid among those of ``page_blocks``."""
    block = lambda at, text: (
        *PAGE, F.struct(F.col("top").cast("double").alias("top"), at.cast("int").alias("block_no")).alias("at"), F.lit("figure").alias("kind"), text.alias("text"),
        F.lit(0).alias("level"), F.array().cast("array<string>").alias("items"), F.lit("").alias("summary"), "image_rel",
    )
    out = images.select(*block(F.col("number"), F.coalesce("text", F.lit(""))))
    return out if crops is None else out.unionByName(crops.select(*block(F.lit(0), F.lit(""))))


def table_note_images(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks with the page image that a table note points to."""
    shown = images.select(*PAGE, F.concat(F.lit("images/"), "image").alias("__rel"))
    out = blocks.join(shown, PAGE, "left").withColumn("image_rel", F.when(F.col("kind") == "table_note", F.col("__rel")))
    return out.drop("__rel")
