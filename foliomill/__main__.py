"""``python -m foliomill info FILE``, ``build FILE... -o DIR`` and ``serve DIR``."""

from __future__ import annotations

import argparse
import functools
import http.server
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sinks
from .operators import enrich as E, layout as L, structure as T
from .operators.clients import local_available, local_client
from .plans.build import Settings, answer_cache, build
from .sources import pdf as P
from .sources.svd import read_svd


def tables(spark: SparkSession, path: str, max_pages: int = 0) -> dict[str, DataFrame]:
    """The tables of some PDF files."""
    return {name: P.read_pdf(spark, path, name, max_pages) for name in P.TABLES}


def info(spark: SparkSession, path: str, limit: int = 60) -> list[str]:
    pdf = tables(spark, path)
    doc = pdf["docs"].first()
    return T.info(doc["title"], doc["n_pages"], T.outline_rows(pdf["outline"]), limit)


def build_all(
    spark: SparkSession, path: str, out: str, settings: Settings, svd: str | None = None, images: bool = True, embedder: Callable | None = None,
) -> list[str]:
    """Builds and writes every table below ``out``, replacing earlier ones but page images and the cache
    of enrichments, which are completed (made anew where ``settings`` say not to resume); returns the
    tables' names.  Files are read once, into the tables of ``scan``."""
    pdf = {}
    for name, table in tables(spark, path, settings.max_pages).items():
        sinks.write_table(table, f"{out}/scan/{name}")
        pdf[name] = spark.read.schema(table.schema).parquet(f"{out}/scan/{name}")
    shown = None
    if images:
        shown = P.wanted_images(pdf["pages"])
        sinks.write_page_images(shown, f"{out}/images", settings.dpi, settings.resume, path)
    gaps = L.vertical_gaps(L.text_blocks(pdf["spans"]), pdf["pages"], pdf["figures"])
    single = L.single_column(L.text_blocks(pdf["spans"])).filter("single_column").select("doc", "page")
    crops = P.crop_gaps(gaps.join(single, ["doc", "page"], "left_semi"), path=path)
    sinks.write_table(crops, f"{out}/scan/crops")  # each gap is rendered once
    crops = spark.read.schema(crops.schema).parquet(f"{out}/scan/crops")
    large = L.large_images(pdf["figures"])
    sinks.write_table(large.select("doc", "page", "image_rel", F.col("image").alias("bytes")).unionByName(crops.drop("top")), f"{out}/figures")
    made = build(
        T.outline_rows(pdf["outline"]), pdf["pages"], pdf["spans"], shown, settings, read_svd(spark, svd) if svd else None, embedder,
        L.figure_blocks(large, crops), answer_cache(spark, f"{out}/cache/enrich"),
    )
    postings, docs = made.pop("postings"), made.pop("search_docs")
    sinks.write_index(postings, docs, f"{out}/index")
    for name, table in made.items():
        (sinks.write_exports if name.startswith("export_") else sinks.write_table)(table, f"{out}/{name}")
    return [*made, "index", "figures", *["images"] * images]


def sentence_model(name: str) -> Callable:
    """An embedding model of the optional ``sentence_transformers`` library, as ``vectors.embed`` takes it."""
    return __import__("sentence_transformers").SentenceTransformer(name).encode


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliomill")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("info", help="title, pages and outline of a file")
    command.add_argument("file")
    command.add_argument("--limit", type=int, default=60)
    command = commands.add_parser("build", help="the tables of a wiki from files (a pattern)")
    command.add_argument("files")
    command.add_argument("-o", "--out", required=True)
    command.add_argument("-c", "--compute", default="small", choices=["small", "medium", "large"])
    command.add_argument("--svd")
    command.add_argument("--no-images", action="store_true")
    command.add_argument("--no-resume", action="store_true", help="make enrichments and page images anew")
    command.add_argument("--semantic", action="store_true", default=None, help="chunks, and vectors with --embed-model")
    for name in ("backend", "model", "embed-model", "local-host"):
        command.add_argument(f"--{name}")
    for name in ("dpi", "max-pages"):
        command.add_argument(f"--{name}", type=int)
    command = commands.add_parser("serve", help="serve a folder on this machine")
    command.add_argument("folder")
    command.add_argument("-p", "--port", type=int, default=8000)
    a = parser.parse_args(arguments)
    if a.command == "serve":
        handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=a.folder)
        with http.server.ThreadingHTTPServer(("127.0.0.1", a.port), handler) as server:
            server.serve_forever()
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "info":
        print("\n".join(info(spark, a.file, a.limit)))
    else:
        settings = Settings.of(a.compute, backend=a.backend, model=a.model, dpi=a.dpi, max_pages=a.max_pages, semantic=a.semantic, resume=not a.no_resume)
        if a.local_host:
            E.BACKENDS["ollama"] = local_client(a.local_host)
            E.PROBES[E.BACKENDS["ollama"]] = functools.partial(local_available, a.local_host)
        embedder = functools.partial(sentence_model, a.embed_model) if a.embed_model else None
        print("\n".join(build_all(spark, a.files, a.out, settings, a.svd, not a.no_images, embedder)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
