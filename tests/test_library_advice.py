"""Findings of the review on the library: each of these failed before."""

import numpy as np

from foliomill.operators import retrieval as V
from foliomill.plans.build import Settings, build


def test_page_search_without_section(spark):
    m = spark.createDataFrame([(1, None, "the src1 page"), (2, "Part src1", "the other"), (3, None, None)], "n long, sec string, t string")
    assert [(r.n, r.sec, r.snippet) for r in V.page_search(m, "The src1").collect()] == [(1, "", "the src1 page"), (2, "Part src1", "the other")]


def test_build_makes_chunks_vectors_and_svd_groups(spark):
    o = spark.createDataFrame([("d", 0, 1, "1 Overview", 0)], "doc string, ord int, level int, title string, page int")
    p = spark.createDataFrame([("d", 0, "DDRB - Port B Register\nBit 7 - DDB7: x\nline")], "doc string, page int, text string")
    svd = spark.createDataFrame([("PORTB", [])], "title string, registers array<struct<name:string,description:string,address:string,fields:array<struct<bits:string,name:string,access:string,description:string>>>>")
    settings = Settings.of("medium", backend="none", chunk_chars=25)
    out = build(o, p, settings=settings, svd=svd, embedder=lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    assert [(r.title, r.register_source) for r in out["register_map"].collect()] == [("PORTB", "svd")]
    chunks = out["chunks"].collect()
    assert len(chunks) > 1 and {r.section_id for r in chunks} == {"d/1-overview"}
    assert {tuple(round(x, 3) for x in r.vec) for r in out["vectors"].collect()} == {(0.6, 0.8)} and out["vectors"].count() == len(chunks)
    small = build(o, p)
    assert "chunks" not in small and "vectors" not in small


def test_an_empty_image_is_replaced(spark, tmp_path, monkeypatch):
    """Its row goes, and no other image is rendered again."""
    from pyspark.sql import functions as F

    from foliomill import sinks

    path, calls = str(tmp_path / "images"), spark.sparkContext.accumulator(0)

    def drawn(frames):
        for f in frames:
            calls.add(len(f))
            yield f.assign(bytes=[b"" if p == 7 and not again.exists() else b"png" for p in f["page"]])

    again = tmp_path / "again"
    monkeypatch.setattr(sinks, "render_pages", lambda rows, dpi, source: rows.select("doc", "page", "image").mapInPandas(drawn, "doc string, page int, image string, bytes binary"))
    wanted = spark.range(200).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.concat(F.lit("page-"), "id").alias("image"))
    sinks.write_page_images(wanted.filter("page < 150"), path)
    assert calls.value == 150
    again.touch()
    sinks.write_page_images(wanted, path)
    rows = spark.read.parquet(path).select("page", "bytes").collect()
    assert sorted(r.page for r in rows) == list(range(200)) and {bytes(r.bytes) for r in rows} == {b"png"} and calls.value == 150 + 51
    sinks.write_page_images(wanted, path)
    assert spark.read.parquet(path).count() == 200 and calls.value == 201
