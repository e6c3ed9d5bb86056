"""Where a build's tables go."""

from __future__ import annotations

import atexit
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .operators.dictionary import dictionary, in_order, posting_blocks
from .operators.incremental import missing_files
from .sources.pdf import render_pages


_temporary: list[str] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A folder for this session's use below ``spark.checkpoint.dir``, deleted at the end; in local mode below
    the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    _temporary.append(f"{base.rstrip('/')}/foliomill-library-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _temporary[-1]


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _temporary if spark is not None else ():
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone; the folder carries the application's id
            return


def write_table(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Overwrites a table; ``sort`` clusters it by a column that readers filter on."""
    out = df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df
    out.write.mode("overwrite").parquet(path)


def write_index(postings: DataFrame, docs: DataFrame, path: str) -> None:
    """Index as tables: ``postings`` sorted by term so that prefix filters skip row groups, ``docs``, and
    for tables of queries (see ``operators.dictionary``) ``terms``, ``blocks`` and ``about``."""
    spark = postings.sparkSession
    in_order(postings).write.mode("overwrite").parquet(f"{path}/postings")
    write_table(docs, f"{path}/docs")
    blocks = posting_blocks(spark.read.schema(postings.schema).parquet(f"{path}/postings"), lying=True)
    blocks = blocks.repartition("part").sortWithinPartitions("part", "term", "no")  # ranges would make the blocks twice, to sample them
    blocks.write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    kind = StructType([*(f for f in blocks.schema if f.name != "part"), StructField("part", IntegerType())])
    terms = dictionary(spark.read.schema(kind).parquet(f"{path}/blocks"))
    terms.repartitionByRange("key", "term").sortWithinPartitions("key", "term").write.mode("overwrite").parquet(f"{path}/terms")
    n = spark.read.schema(docs.schema).parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n_docs"))
    write_table(n, f"{path}/about")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_exports(pieces: DataFrame, path: str, by: str = "doc") -> None:
    """One text file for each device of ``pieces`` (``plans.build.export_pieces``), replacing earlier ones:
    a task sorts a device's pieces and writes them one after another."""
    rows = pieces.repartition(by).sortWithinPartitions(by, "place")
    rows.select(by, "text").write.mode("overwrite").partitionBy(by).text(path)


def write_pages(sections_html: DataFrame, path: str) -> None:
    """Rendered sections, replacing the earlier ones, stale ones too."""
    write_table(sections_html, path)


def write_vectors(vectors: DataFrame, docs: DataFrame, path: str, model: str, key: str = "section_id") -> int:
    """An embedding index: ``chunks`` (``key``, place, snippet, vector), ``docs`` and ``about`` (model,
    dimension, number of chunks).  Without chunks nothing is written; returns their number."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n:
        write_table(vectors.select(key, "pos", "snippet", "vec"), f"{path}/chunks")
        write_table(docs, f"{path}/docs")
        write_table(docs.sparkSession.range(1).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(n).alias("chunks")), f"{path}/about")
    return n


#: Parts of a table of page images.
IMAGE_PARTS = 64


def write_page_images(wanted: DataFrame, path: str, dpi: int = 120, resume: bool = True, source: str | None = None) -> None:
    """Renders what ``wanted`` (``sources.pdf.wanted_images``) names into a table of images at
    ``path``.  With ``resume`` pages whose image is there and not empty are left as they are.

    Images lie in ``IMAGE_PARTS`` parts by page; a part that holds empty images is written again
    without them, in place of the old one, so that no page has two rows.  ``source`` is where Spark finds
    the files; without it executors open them."""
    spark = wanted.sparkSession
    in_part = F.pmod(F.xxhash64("doc", "page"), F.lit(IMAGE_PARTS)).cast("int").alias("part")
    wanted = wanted.select("doc", "page", "image", in_part)
    rendered = lambda rows: render_pages(rows, dpi, source).select("*", in_part)
    if not resume:
        rendered(wanted).write.mode("overwrite").partitionBy("part").parquet(path)
        return
    try:
        there = spark.read.parquet(path).select("doc", "page", "image", "bytes", in_part)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rendered(wanted).write.mode("append").partitionBy("part").parquet(path)
        return
    size = F.coalesce(F.length("bytes"), F.lit(0)).alias("length")
    named = wanted.withColumn("path", F.concat_ws("#", "doc", "image"))
    missing = missing_files(named, there.select(F.concat_ws("#", "doc", "image").alias("path"), size)).drop("path")
    kept = temporary(spark, "missing-images")
    write_table(missing, kept)
    missing = spark.read.schema("doc string, page int, image string, part int").parquet(kept)
    broken = [r["part"] for r in there.filter(size == 0).select("part").distinct().collect()]  # at most IMAGE_PARTS numbers
    if broken:
        whole = there.filter(F.col("part").isin(broken) & (size > 0)).unionByName(rendered(missing.filter(F.col("part").isin(broken))))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    rendered(missing.filter(~F.col("part").isin(broken))).write.mode("append").partitionBy("part").parquet(path)
