"""Links by joins, against the column functions that look references up in maps."""

import random

import pytest
from pyspark.sql import functions as F

from foliomill import constants as K
from foliomill.functions import html as H
from foliomill.operators import links as L, structure as T
from foliomill.plans.build import rendered_sections


@pytest.fixture(scope="module")
def sections(spark):
    rows = []
    for doc, count in (("d", 12), ("e&\"", 5)):
        for k in range(count):
            number = ["1", "1.1", "1.1.2", "", "2", "3.10", "4", "4", "5", "6.1", "7", "8"][k]
            rows.append((doc, k, f"s-{k}<{doc}>", f"{number} Title {k}", 1 + k % 3, k * 2, k * 2 + 2, None, number))
    return spark.createDataFrame(rows, "doc string, ord int, id string, title string, level int, start_page int, end_page int, parent_id string, number string")


def sentences(n, seed=3):
    rng = random.Random(seed)
    refs = ["see Section 1.1", "Sections 1.1.9.4", "section\t9", "Chapter 2.", "SECTION 4", "Section 3.1", "section 6.1.", "chapters 0", "Section x", "page 3", "pages 12-14", "Page 0", "page  99999999999", "pages\n5"]
    other = ["the", "<b>", "&", "\"q\"", "it's", "", "subsection 1", "homepage 3", f"{K.BOLD_START}bold{K.BOLD_END}", "é", "\n\n", "\n", "Section 1page 3", "Section 77page 3", "Section 1.1pages 2 page 2", "1page 2"]
    return [rng.choice([" ", " ", ""]).join(rng.choice(refs + other) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_links_equal_those_of_maps(spark, sections):
    rows = spark.createDataFrame([(k, "d" if k % 3 else "e&\"", t) for k, t in enumerate(sentences(400))] + [(900, "d", None), (901, "none", "see Section 1, page 2 <")], "k int, doc string, text string")
    maps = T.lookup_maps(sections)
    want = {r.k: r.html for r in rows.join(maps, "doc", "left").select("k", H.linkify(F.col("text"), F.col("numbers"), F.col("pages"), "../").alias("html")).collect()}
    out = L.linked(rows, sections, ["doc", "k"], root="../")
    got = {r.k: r.html for r in out.collect()}
    assert got[901] == "see Section 1, page 2 &lt;" and got.pop(901) and want.pop(901, 1)
    assert got == want and sum("href" in (x or "") for x in got.values()) > 200
    assert "map<" not in str(out._jdf.queryExecution().analyzed().schema()) and "map_from_entries" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_right_behind_a_section(spark, sections):
    rows = spark.createDataFrame([(1, "d", "Section 1page 3"), (2, "d", "Section 77page 3")], "k int, doc string, text string")
    got = {r.k: r.html for r in L.linked(rows, sections, ["doc", "k"]).collect()}
    assert got[1].count("href") == 2 and got[2].count("href") == 0


def test_bodies_and_blocks_equal_those_of_maps(spark, sections):
    texts = sentences(17, 5)
    numbered = sections.withColumn("text", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("ord") + 1))
    numbered = numbered.withColumn("text", F.when(F.col("ord") == 4, " \n").otherwise(F.col("text")))
    maps = T.lookup_maps(numbered)
    plain = H.render_body(F.col("text"), F.col("numbers"), F.col("pages"))
    pairs = lambda df: {(r.doc, r.id): r.html for r in df.collect()}
    assert pairs(rendered_sections(numbered)) == pairs(numbered.join(maps, "doc").select("doc", "id", plain.alias("html")))
    kinds = ["heading", "para", "list", "figure", "codefold", "table_note"]
    more = sentences(200, 7)
    rows = [
        ("d" if k % 4 else "e&\"", k % 26, (float(k % 3), k), kinds[k % 6], more[k], 2 + k % 4, [more[k - 1], more[k - 2], "", None][: k % 5] if k % 6 == 2 else [], None if k % 5 else f"figures/<{k}>.png", None if k % 2 else "sum & mary")
        for k in range(200)
    ]
    rows += [rows[7], ("d", 3, (9.0, 9), "para", None, 3, [], None, None)]
    blocks = spark.createDataFrame(rows, "doc string, page int, at struct<top:double,n:int>, kind string, text string, level int, items array<string>, image_rel string, summary string")
    spans = T.section_pages(numbered, ["id"]).join(blocks, ["doc", "page"])
    own = spans.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("page", "at", "kind", "text", "level", "items", "image_rel", "summary"))).alias("blocks"))
    body = F.coalesce(F.nullif(H.render_blocks(F.col("blocks"), F.col("numbers"), F.col("pages")), F.lit("")), plain)
    want = pairs(numbered.join(maps, "doc").join(own, ["doc", "id"], "left").select("doc", "id", body.alias("html")))
    assert pairs(rendered_sections(numbered, blocks)) == want
