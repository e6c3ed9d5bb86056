"""PDF source with a stand-in decoder, images that are rendered once, clients of models, streams of answers."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliomill import sinks
from foliomill.functions.text import prompt
from foliomill.operators import clients, enrich as E, layout as L, structure as T
from foliomill.plans.build import build
from foliomill.sources import pdf as P

FAKES = str(Path(__file__).parent / "fakes")


def span(text, size=11.0, flags=0):
    return {"text": text, "size": size, "flags": flags, "font": "Sans"}


def block(top, *lines, **more):
    return {"type": 0, "bbox": [50, top, 500, top + 10], "lines": [{"spans": [span(t, **more)]} for t in lines]}


@pytest.fixture
def folder(tmp_path, monkeypatch, spark):
    monkeypatch.syspath_prepend(FAKES)
    monkeypatch.delitem(sys.modules, "fitz", raising=False)
    spark.sparkContext.addPyFile(f"{FAKES}/fitz.py")
    image = {"type": 1, "bbox": [60, 120, 200, 180], "number": 4, "ext": "jpeg", "width": 90, "height": 60, "image": "JPEG"}
    one = {
        "metadata": {"title": "  The Title "}, "toc": [[1, "1  Start", 1], [2, "1.1 More", 3], [1, " ", 2], [1, "Lost", -1]],
        "pages": [
            {"text": "first", "blocks": [block(20, "Heading", size=20.0), block(100, "A paragraph of text."), image, block(500, "And the last words.")], "links": [{"kind": 1, "page": 2, "from": [1, 2, 3, 4]}, {"kind": 2, "page": 1, "from": [0, 0, 1, 1]}, {"kind": 1, "page": -1, "from": [0, 0, 1, 1]}]},
            {"text": "second", "broken": True}, {"text": "third"},
        ],
    }
    (tmp_path / "one.pdf").write_text(json.dumps(one))
    (tmp_path / "two.pdf").write_text(json.dumps({"metadata": None, "pages": [{"text": "only"}]}))
    return tmp_path


def read(spark, folder, table, limit=0):
    reader = P.PdfReader({"path": f"{folder}/*.pdf", "table": table, "max_pages": str(limit)})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    return spark.createDataFrame([(Path(r[0]).name, *r[1:]) for r in rows], P.TABLES[table])


def test_pdf_tables(spark, folder):
    rows = lambda *a: [tuple(r) for r in read(spark, folder, *a).collect()]
    assert rows("docs") == [("one.pdf", "The Title", 3), ("two.pdf", "two", 1)]
    assert [(r[0], r[1], r[4]) for r in rows("pages")] == [("one.pdf", 0, "first"), ("one.pdf", 1, "second"), ("one.pdf", 2, "third"), ("two.pdf", 0, "only")]
    assert [r[1] for r in rows("pages", 2)] == [0, 1, 0] and rows("pages")[0][2:4] == (600.0, 800.0)
    assert rows("links") == [("one.pdf", 0, 2, 1.0, 2.0, 3.0, 4.0, "at 1")]
    assert {r[1] for r in rows("spans")} == {0} and len(rows("spans")) == 3  # the broken page has none
    assert rows("figures") == [("one.pdf", 0, 4, "jpeg", 90, 60, 120.0, 180.0, b"JPEG", "at 60")]
    outline = T.outline_rows(read(spark, folder, "outline"))
    assert [(r.ord, r.title, r.page) for r in outline.orderBy("ord").collect()] == [(0, "1 Start", 0), (1, "1.1 More", 2), (3, "Lost", 0)]
    assert T.info("The Title", 3, outline, 2) == ["Title:    The Title", "Pages:    3", "Outline:  3 entries", "  1 Start  (p.1)", "    1.1 More  (p.3)", "  … 1 more (use --limit)"]
    with pytest.raises(FileNotFoundError):
        P.PdfReader({"path": f"{folder}/*.none"})


def test_pdf_source(spark, folder):
    spark.dataSource.register(P.PdfSource)
    got = spark.read.format("folio_pdf").option("table", "docs").load(f"{folder}/*.pdf")
    assert got.columns == ["doc", "title", "n_pages"] and P.PdfSource({"table": "links"}).schema() == P.TABLES["links"]
    assert isinstance(P.PdfSource({"path": f"{folder}/*.pdf"}).reader(None), P.PdfReader)


def test_page_images_are_rendered_once(spark, folder):
    pages = spark.createDataFrame([(f"{folder}/one.pdf", 0), (f"{folder}/one.pdf", 2), (f"{folder}/two.pdf", 0)], "doc string, page int")
    wanted, path = P.wanted_images(pages), str(folder / "images")
    sinks.write_page_images(wanted.filter("page = 0"), path, dpi=144)
    shown = lambda: sorted((Path(r.doc).name, r.image, bytes(r.bytes).decode()) for r in spark.read.parquet(path).collect())
    assert shown() == [("one.pdf", "page-0001.png", "png:first@2.00"), ("two.pdf", "page-0001.png", "png:only@2.00")]
    sinks.write_page_images(wanted, path, dpi=72)
    assert [x[2] for x in shown()] == ["png:first@2.00", "png:third@1.00", "png:only@2.00"]
    sinks.write_page_images(wanted, path, dpi=72, resume=False)
    assert [x[2] for x in shown()] == ["png:first@1.00", "png:third@1.00", "png:only@1.00"]


def test_figures_lie_among_the_blocks(spark, folder):
    whole = lambda t: read(spark, folder, t).withColumn("doc", F.concat(F.lit(f"{folder}/"), "doc"))
    spans, pages, figures = whole("spans"), whole("pages"), whole("figures")
    blocks = L.text_blocks(spans)
    placed = figures.select("doc", "page", "top", "bottom")
    assert L.single_column(blocks).first().single_column
    gaps = L.vertical_gaps(blocks, pages, placed)
    assert gaps.count() == 0  # the image lies in the only large gap
    gaps = L.vertical_gaps(blocks, pages)
    crops = P.crop_gaps(gaps)
    assert [(r.page, r.image_rel, r.top) for r in crops.collect()] == [(0, "figures/fig-p0001-gap110.png", 305.0)]
    blank = spark.createDataFrame([(f"{folder}/one.pdf", 0, 420.0, 700.0)], "doc string, page int, gap_top double, gap_bottom double")
    assert P.crop_gaps(blank).count() == 0
    drawn = L.figure_blocks(L.large_images(figures), crops.drop("bytes"))
    out = build(T.outline_rows(whole("outline")), pages, spans, figures=drawn)
    mine = sorted((r.at.top, r.kind, r.text, r.image_rel) for r in out["blocks"].filter("page = 0").collect())
    assert [(m[1], m[3]) for m in mine] == [("heading", None), ("para", None), ("figure", "figures/fig-p0001-4.jpeg"), ("figure", "figures/fig-p0001-gap110.png"), ("para", None)]
    html = out["sections_html"].filter("id = '1-start'").first().html
    assert html.index("A paragraph") < html.index("fig-p0001-4.jpeg") < html.index("fig-p0001-gap110.png") < html.index("last words")


class Model(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        self.send_response(200 if self.path == "/api/tags" else 404)
        self.end_headers()

    def do_POST(self):
        wish = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, wish))
        self.send_response(500 if "fail" in wish["prompt"] else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"response": '{"summary": "told", "keywords": "a"}'}).encode())

    def log_message(self, *_):
        pass


def test_local_model(spark, monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert clients.local_available(host) and not clients.local_available(f"{host}none")
        monkeypatch.setitem(E.BACKENDS, "ollama", clients.local_client(host))
        rows = spark.createDataFrame([("s", "t", "Some text."), ("f", "t", "fail"), ("b", "t", "  ")], "section_id string, title string, text string")
        got = {r.section_id: r for r in E.enrich(rows, "ollama", "m1").collect()}
    finally:
        server.shutdown()
    assert (got["s"].summary, got["s"].backend) == ("told", "ollama") and got["f"].backend == got["b"].backend == "none"
    (path, wish), *rest = [x for x in Model.asked if "fail" not in x[1]["prompt"]]
    assert not rest and path == "/api/generate" and (wish["model"], wish["format"], wish["stream"]) == ("m1", "json", False)
    assert wish["prompt"] == spark.range(1).select(prompt(F.lit("t"), F.lit("Some text.")).alias("p")).first().p
    assert not clients.local_available("http://127.0.0.1:9") and E.available("none") and E.available("ollama")


def test_cloud_model():
    asked = []

    def create(**wish):
        asked.append(wish)
        return SimpleNamespace(content=[SimpleNamespace(type="other"), SimpleNamespace(type="text", text='{"summary": "x"}')])

    ask = clients.cloud_client(connect=lambda: SimpleNamespace(messages=SimpleNamespace(create=create)))(None)
    assert ask("t", "text") == '{"summary": "x"}' and ask("t", " ") is None and len(asked) == 1
    schema = asked[0]["output_config"]["format"]["schema"]
    assert schema["required"] == ["summary", "keywords", "registers", "code_examples"] and asked[0]["max_tokens"] == 4096
    assert schema["properties"]["registers"]["items"]["properties"]["fields"]["items"]["required"] == ["bits", "name", "access", "description"]
    assert not clients.cloud_available() and not E.available("claude")


def test_vectors_without_chunks(spark, tmp_path):
    none = spark.createDataFrame([], "section_id string, pos int, snippet string, vec array<float>")
    assert sinks.write_vectors(none, none, str(tmp_path / "v"), "m") == 0 and not (tmp_path / "v").exists()


def test_commands(spark, folder, capsys):
    from foliomill.__main__ import main

    assert main(["info", f"{folder}/one.pdf", "--limit", "1"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Title:    The Title", "Pages:    3", "Outline:  3 entries", "  1 Start  (p.1)", "  … 2 more (use --limit)"]
    assert main(["build", f"{folder}/one.pdf", "-o", f"{folder}/out", "--dpi", "72"]) == 0
    names = capsys.readouterr().out.split()
    assert {"sections", "sections_html", "index", "figures", "images", "stats", "page_manifest"} <= set(names)
    read = lambda name: spark.read.parquet(f"{folder}/out/{name}")
    assert {r.id for r in read("sections").collect()} == {"1-start", "1-1-more", "lost"}
    assert sorted(bytes(r.bytes) for r in read("images").collect()) == [b"png:first@1.00", b"png:second@1.00", b"png:third@1.00"]
    assert {r.img for r in read("page_manifest").collect()} == {f"images/page-000{k}.png" for k in (1, 2, 3)}
    assert {(r.image_rel, bytes(r.bytes)) for r in read("figures").collect()} == {("figures/fig-p0001-4.jpeg", b"JPEG")}
    with pytest.raises(SystemExit):
        main(["nothing"])


def long_file(folder, n=40):
    (folder / "seen").mkdir()
    raw = {"metadata": {"title": "Long"}, "toc": [[1, "One", 1]], "seen": str(folder / "seen"), "pages": [{"text": f"page {k}", "blocks": [block(20, f"text {k}")]} for k in range(n)]}
    (folder / "long.pdf").write_text(json.dumps(raw))
    return lambda: sorted(int(p.name.split("-")[0]) for p in (folder / "seen").iterdir())


def test_filters_reach_the_decoder(spark, folder):
    seen = long_file(folder)
    load = lambda: P.source_reader(spark).option("table", "pages").load(f"{folder}/*.pdf")
    assert sorted((r.page, r.text) for r in load().filter("page < 3 and doc = '" + f"{folder}/long.pdf'").collect()) == [(k, f"page {k}") for k in range(3)]
    assert seen() == [0, 1, 2]
    assert {r.text for r in load().filter("page >= 38").union(load().filter("page = 2")).collect()} == {"page 38", "page 39", "third", "page 2"}
    assert seen() == [0, 1, 2, 2, 38, 39]
    assert load().filter(F.col("doc").startswith(f"{folder}/o") & (F.col("text") != "first")).count() == 2 and load().filter("page > 5 and page <= 5").count() == 0 and len(seen()) == 6
    links = lambda: P.source_reader(spark).option("table", "links").load(f"{folder}/one.pdf")
    assert links().filter("src_page = 0 and dest_page = 2").count() == 1 and links().filter("src_page > 0").count() == 0


def test_a_long_file_spreads_over_tasks(spark, folder):
    seen = long_file(folder)
    size = (folder / "long.pdf").stat().st_size
    for df in (
        P.source_reader(spark).option("table", "spans").option("split_bytes", size // 4).load(f"{folder}/long.pdf"),
        P.read_pdf(spark, f"{folder}/long.pdf", "spans", split_bytes=size // 4),
    ):
        rows = df.withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.page for r in rows) == list(range(40)) and len({r.task for r in rows}) > 1
    assert seen() == sorted([*range(40)] * 2)
    assert P.read_pdf(spark, f"{folder}/long.pdf", "pages", 7, size // 4).count() == 7
    assert P.PdfReader({"path": f"{folder}/long.pdf", "table": "docs", "split_bytes": "10"}).partitions()[0].parts == 1


def test_files_on_any_file_system(spark, folder):
    """By a path that only Spark's readers can open."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pdfs.link./in", f"file://{folder}")
    where = "viewfs://pdfs/in/*.pdf"
    docs = {Path(r.doc).name: (r.title, r.n_pages) for r in P.read_pdf(spark, where, "docs").collect()}
    assert docs == {"one.pdf": ("The Title", 3), "two.pdf": ("two", 1)}
    for name in P.TABLES:
        mine = sorted(map(str, P.read_pdf(spark, where, name).drop("doc").collect()))
        assert mine == sorted(map(str, read(spark, folder, name).drop("doc").collect())), name
    wanted = P.wanted_images(P.read_pdf(spark, where, "pages"))
    sinks.write_page_images(wanted, str(folder / "images"), 72, source=where)
    shown = {(Path(r.doc).name, r.image, bytes(r.bytes)) for r in spark.read.parquet(str(folder / "images")).collect()}
    assert shown == {("one.pdf", f"page-000{k + 1}.png", b"png:%s@1.00" % t) for k, t in enumerate((b"first", b"second", b"third"))} | {("two.pdf", "page-0001.png", b"png:only@1.00")}
    gap = spark.createDataFrame([(f"viewfs://pdfs/in/one.pdf", 0, 110.0, 500.0)], "doc string, page int, gap_top double, gap_bottom double")
    assert P.crop_gaps(gap, path=where).first().bytes.startswith(b"png:first")
