"""Findings of round 4: each of these failed before, but for what they say of results."""

import re

from pyspark.sql import functions as F

from foliomill.functions import html as H
from foliomill.operators import links as L, structure as T

SECTIONS = "doc string, ord int, id string, level int, start_page int, end_page int, number string"


def test_f1_a_text_is_made_and_searched_once(spark):
    """Texts were made and cut once for their references, once for the different ones, once to be spliced."""
    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"see Section {k % 3}.1 and page {k} of <{k}>"

    rows = spark.range(40).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("k"), F.udf(text, "string")("id").alias("text"))
    sections = spark.createDataFrame([("d", 0, "s-0&", 1, 0, 4, "1"), ("d", 1, "s-1", 1, 5, 9, "2.1")], SECTIONS)
    got = {r.k: r.html for r in L.linked(rows, sections, ["doc", "k"]).collect()}
    assert made.value == 40
    to = lambda label: f'<a class="xref" href="sections/s-0&amp;.html">{label}</a>'
    assert got[1] == to("see Section 1.1") + " and " + to("page 1") + " of &lt;1&gt;"
    assert {k: h.count("href") for k, h in got.items()} == {k: (k % 3 > 0) + (1 <= k <= 10) for k in range(40)}


def test_f1_a_gap_between_references_is_not_searched_on_its_own(spark):
    """Each gap was split by an expression that Java compiled anew, twice a reference."""
    sections = spark.createDataFrame([("d", 0, "s-0", 1, 0, 4, "1", "to Section 1.2, page 3")], f"{SECTIONS}, text string")
    out = L.bodies(sections)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(?iU)" in plan and not re.search(r"(split|lambda)[^,]*, \(\?iU\)", plan)
    assert out.first().html.count("href") == 2


def test_f1_marks_in_texts(spark):
    """What looks like a mark, an escape or a part of a reference in a text; results as by maps, as before."""
    texts = [
        "<s1<Section 1<", "<p3<page 3<", "<<<Section 2<1>page 3<", "&lt;s1&lt;Section 1", "$1 $0 \\1 Section 2.1$0", "Section 1page 3page 4", "page 3Section 1", "page 3 Section 1page 4",
        "Section 77page 3 page 3", "Section 2.1.1.1.page 1", "'Section 1'&\"page 3\"", "Section\n\n1", "see Section 1.2", "ſection 1 ſee Section 1", "Section ١ page ٣", "page 007 page 99999999999999999999",
        "Section 1́page 3", "́page 3", "épage 3", "\x00\x01\x02page 3\x03Section 1\x04", "", " ", "<", "page", "Section", "\U0001f600page 3\U0001f600", "Section 1<page 3", "Section 1&page 3", "Section &#49; page &#51;",
    ]
    sections = spark.createDataFrame([("d", 0, "<i>&'\"", 1, 0, 1, "1"), ("d", 1, "s-$1", 2, 2, 3, "2.1"), ("d", 2, "none", 2, 9, 9, "")], SECTIONS)
    rows = spark.createDataFrame([(k, "d", t) for k, t in enumerate(texts)] + [(900, "d", None)], "k int, doc string, text string")
    maps = T.lookup_maps(sections)
    want = {r.k: r.html for r in rows.join(maps, "doc", "left").select("k", H.linkify(F.col("text"), F.col("numbers"), F.col("pages"), "../").alias("html")).collect()}
    for limit in ("10m", "-1"):  # what references lead to is sent to all tasks, or dealt as they are
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            out = L.linked(rows, sections, ["doc", "k"], root="../")
            got = {r.k: r.html for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == want and sum("href" in (h or "") for h in got.values()) > 15
