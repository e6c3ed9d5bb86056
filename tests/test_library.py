"""The library's operators: values, and every query against its SQL."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from foliomill import constants as K
from foliomill.functions import html as H, registers as R, text as X
from foliomill.operators import enrich as E, layout as L, retrieval as V, structure as T
from foliomill.operators.vectors import section_chunks
from foliomill.plans import queries as Q
from foliomill.plans.build import Settings, build, exports, register_map
from foliomill.sources.svd import read_svd

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sql, name):
    df = Q.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in Q.SQL:
        found = sql.sql(Q.SQL[name])
        columns = found.columns
        assert sorted(columns) == sorted(df.columns)
        assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == Counter(tuple(map(plain, r)) for r in found.fetchall())
    assert rows or name in ("table_pages", "vertical_gaps", "cell_islands")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)


def test_text_values(spark):
    v = lambda c: value(spark, c)
    b0, b1 = K.BOLD_START, K.BOLD_END
    assert len(K.GLOSSARY) == 51 and len(set(K.KEYWORD_STOP)) >= 80 and ord(b0) == 0xE000 and ord(b1) == 0xE001
    assert v(X.reflow(lit(["Bit", "7", "6", "5", "4"]))) == "Bit 7 6 5 4"
    assert v(X.reflow(lit(["micro-", "controller runs", " ", "1-", "2"]))) == "microcontroller runs 1- 2"
    assert v(X.reflow(lit([f"{b0}a{b1}", f"{b0}b-{b1}", "c"]))) == f"{b0}a b-{b1} c"
    assert v(X.list_items(F.lit("• first item • second item • third"))) == ["first item", "second item", "third"]
    big = v(X.classify(F.lit("1 Overview"), F.lit(18.0), F.lit(11.0), F.lit(1.0)))
    assert (big.kind, big.level) == ("heading", 2)
    assert v(X.classify(F.lit("Note"), F.lit(11.0), F.lit(11.0), F.lit(1.0))).level == 4
    assert v(X.classify(F.lit("A sentence."), F.lit(30.0), F.lit(11.0), F.lit(1.0))).kind == "para"
    assert v(X.slug_any(F.lit("Ünïcode ﬁ²! -- x"))) == "unicode-fi2-x" and v(X.slug(F.lit("—"))) == "section"
    assert v(X.summary(F.lit("short\nThis line is long enough to count here. So is it? Yes!"))) == "This line is long enough to count here. So is it? Yes!"
    assert v(X.summary(F.lit("x" * 400 + ". Next one."))) == "x" * 400 + "." and v(X.summary(F.lit(""))) == ""
    assert v(X.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"] and v(X.lines(F.lit(""))) == []
    assert v(X.annotate(F.lit("PWM & pwm"))) == '<abbr class="gloss" title="Pulse-Width Modulation">PWM</abbr> &amp; pwm'
    assert v(X.highlight(F.lit("red mark"), ["red", "mark"])) == "<<mark>mark</mark>>red</<mark>mark</mark>> <mark>mark</mark>"
    assert v(X.chunks(F.lit("aaa\nbbb\nccc"), 7)) == ["aaa\nbbb", "ccc"] and v(X.chunks(F.lit("  "))) == []
    assert [v(X.human_size(F.lit(n))) for n in (5, 2048, 3 << 20, 5 << 40)] == ["5B", "2.0KB", "3.0MB", "5120.0GB"]


def test_registers_and_exports(spark):
    text = "10.3 DDRB – Port B Data Direction Register\n\nBit 7 – DDB7: last\nBits 3 : 0 - LOW\nnext line\nPINB - Input Register\nBit 1 - P1: x\n"
    found = value(spark, X.registers(F.lit(text)))
    assert [r.name for r in found] == ["DDRB", "PINB"]
    assert [(f.bits, f.name, f.description) for f in found[0].fields] == [("7", "DDB7", "last"), ("3:0", "LOW", "next line"), ("1", "P1", "x")]
    v = lambda c: value(spark, c)
    assert v(R.bits(F.lit("5–3"))).asDict() == {"lo": 3, "width": 3} and v(R.bits(F.lit("x"))) is None
    assert [v(R.address(F.lit(a))) for a in ("0x4f", "4fh", "64", "", "12h")] == ["0x4F", "0x4F", "0x40", None, "0x12"]
    assert v(R.ident(F.lit(" 9 a--b "))) == "_9_A_B" and v(R.ident(F.lit(None).cast("string"))) == "X"
    assert [v(R.svd_int(F.lit(s))) for s in ("0x10", "#101", "0b11", "010", "7", "z")] == [16, 5, 3, 0, 7, 0]
    group = spark.createDataFrame(
        [("g", "Ports", [("DDRB", "dir", "0x40", [("7:0", "DDB", "R/W", ""), ("?", "no", "", "")])])],
        "id string, title string, registers array<struct<name:string,description:string,address:string,fields:array<struct<bits:string,name:string,access:string,description:string>>>>",
    )
    out = exports(group, "attiny 85", "x.pdf").first()
    assert "#ifndef ATTINY_85_H" in out.c_header and "DDRB_DDB_Msk    (0xFFu << DDRB_DDB_Pos)" in out.c_header and "DDRB_NO" not in out.c_header
    assert "<addressOffset>0x40</addressOffset>" in out.svd and "<access>read-write</access>" in out.svd
    bare = group.withColumn("registers", F.transform("registers", lambda r: r.withField("address", F.lit(""))))
    row = exports(bare, "d", "s").first()
    assert row.svd is None and "_ADDR" not in row.c_header
    assert exports(group.limit(0), "d", "s").first().c_header == ""


def test_svd_file(spark, tmp_path):
    (tmp_path / "d.svd").write_text("""<device><peripherals><peripheral><name>PORTB</name><baseAddress>0x40000400</baseAddress><registers>
      <register><name>DDRB</name><addressOffset>0x4</addressOffset><fields><field><name>DDB</name><bitRange>[7:0]</bitRange><access>read-write</access></field></fields></register>
      <register><name>PINB</name><addressOffset>0x8</addressOffset><fields><field><name>PIN7</name><bitOffset>7</bitOffset><bitWidth>1</bitWidth><access>read-only</access></field></fields></register>
      </registers></peripheral><peripheral><name>NONE</name></peripheral></peripherals></device>""")
    groups = read_svd(spark, str(tmp_path / "d.svd"))
    (g,) = groups.collect()
    got = [(r.name, r.address, [(f.bits, f.name, f.access) for f in r.fields]) for r in g.registers]
    assert g.title == "PORTB" and got == [("DDRB", "0x40000404", [("7:0", "DDB", "R/W")]), ("PINB", "0x40000408", [("7", "PIN7", "R")])]
    assert register_map(None, None, groups).first().register_source == "svd"


def test_build(spark):
    outline = [(0, 1, "1 Overview", 0), (1, 1, "2 Pin Configuration", 1), (2, 2, "2.1 Electrical Characteristics", 2), (3, 1, "3 Timer/Counter", 3), (4, 1, "4 Instruction Set", 4)]
    texts = ["See Section 2 and section 3.9.1, page 4.", "DDRB - Port B Data Direction Register\nBit 7 - DDB7: x", "Table 2-1 here", "PWM\n\n#include <avr/io.h>\nint main(void) {\n  return 0;\n}\n", "Section 1"]
    o = spark.createDataFrame([("d", *r) for r in outline], "doc string, ord int, level int, title string, page int")
    p = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)] + [("e", k, "p") for k in range(6)], "doc string, page int, text string")
    out = build(o, p)
    sections = {r.id: r for r in out["sections"].filter("doc = 'd'").collect()}
    assert list(sections) and {"1-overview", "2-pin-configuration", "3-timer-counter"} <= set(sections)
    assert [(s.start_page, s.end_page) for s in sorted(sections.values(), key=lambda s: s.ord)] == [(k, k) for k in range(5)]
    assert sections["2-1-electrical-characteristics"].parent_id == "2-pin-configuration" and sections["4-instruction-set"].parent_id is None
    assert {r.id for r in out["sections"].filter("doc = 'e'").collect()} == {"pages-1-4", "pages-5-6"}
    html = {r.id: r.html for r in out["sections_html"].filter("doc = 'd'").collect()}
    assert html["1-overview"].count('href="sections/3-timer-counter.html"') == 2 and 'href="sections/2-pin-configuration.html"' in html["1-overview"]
    assert "href" not in html["2-1-electrical-characteristics"]
    enriched = {r.section_id: r for r in out["enrichments"].collect()}
    assert enriched["d/2-pin-configuration"].registers[0].fields[0].name == "DDB7" and "avr/io.h" in enriched["d/3-timer-counter"].code_examples[0].code
    assert out["stats"].filter("doc = 'd'").first().asDict() == {"doc": "d", "sections": 5, "top_sections": 4, "registers": 1, "code": 1, "pages": 5}
    assert out["breadcrumbs"].filter("id = '2-1-electrical-characteristics'").first().breadcrumb == "2 Pin Configuration › 2.1 Electrical Characteristics"
    with pytest.raises(ValueError):
        Settings.of("small", nonsense=1)
    assert Settings.of("medium", dpi=None).dpi == 150


def test_outlines_with_quirks(spark):
    rows = [(0, 1, "A 1", 5), (1, 1, "A", 2), (2, 1, "A", 2), (3, 3, "B", 9), (4, 2, "C", 20)]
    o = spark.createDataFrame([("d", *r) for r in rows], "doc string, ord int, level int, title string, page int")
    got = T.build_sections(o, spark.createDataFrame([("d", 10)], "doc string, n_pages int")).orderBy("ord").collect()
    assert [(s.id, s.start_page, s.end_page) for s in got] == [("a-1", 5, 8), ("a", 2, 2), ("a-1", 2, 8), ("b", 9, 9)]


def test_retrieval_values(spark):
    v = lambda c: value(spark, c)
    assert v(V.page_list(F.lit("1, 3, 8-5, x, 3, 0, 12"))) == [1, 3, 5, 6, 7, 8, 12] and v(V.page_list(F.lit(None).cast("string"))) == []
    assert v(V.toggled(lit([1, 2]), F.lit(2))) == [1] and v(V.toggled(lit([2]), F.lit(1))) == [1, 2]
    text = spark.createDataFrame([(1, "The ADC and PWM, plus more PWM and an I²C bus.")], "k int, t string")
    assert sorted(r.term for r in V.present_terms(text, "k", "t").collect()) == ["ADC", "I2C", "PWM"]
    cells = spark.createDataFrame([("p", 0, t) for t in ["a", "b", "c"] * 4] + [("q", 0, "One long sentence of prose.")], "doc string, page int, text string")
    assert [r.doc for r in L.table_pages(cells).collect()] == ["p"]
    assert value(spark, H.codefold(F.lit(" "), F.lit("x"), "table")) == ""


def test_backends(spark):
    rows = spark.createDataFrame([("s", "t", "DDRB - A Register\n")], "section_id string, title string, text string")
    assert E.enrich(rows, "ollama").first().backend == "none"  # not registered: the baseline
    E.BACKENDS["ollama"] = lambda model: lambda title, text: 'x {"summary": "new {", "keywords": "a, b"} y'
    try:
        got = E.enrich(rows, "ollama").first()
    finally:
        E.BACKENDS.clear()
    assert (got.summary, got.keywords, got.backend, got.registers[0].name) == ("new {", ["a", "b"], "ollama", "DDRB")
    with pytest.raises(ValueError):
        E.get_backend("openai")
    assert section_chunks(spark.createDataFrame([(1, "a\nb")], "section_ord int, text string")).first().snippet == "a b"


def test_stream(spark, tmp_path):
    from foliomill.operators.incremental import cache_key
    from foliomill.streaming.incremental import enrich_stream

    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    rows = [("t", "one"), ("t", "two")]
    spark.createDataFrame(rows, "title string, text string").write.parquet(source)
    key = lambda df: df.withColumn("cache_key", cache_key(F.lit("none"), F.lit(None).cast("string"), F.col("title"), F.col("text")))
    run = lambda: enrich_stream(spark, source, "title string, text string", cache, str(tmp_path / "check"), key, lambda df: df.select("cache_key", F.length("text").alias("n"))).awaitTermination()
    run()
    spark.createDataFrame([("t", "one"), ("t", "three")], "title string, text string").write.mode("append").parquet(source)
    run()
    assert sorted(r.n for r in spark.read.parquet(cache).collect()) == [3, 3, 5]


def test_exports_in_pieces(spark, tmp_path):
    """Files per device equal the documents of one row, and a written SVD file reads back."""
    from foliomill import sinks
    from foliomill.plans.build import export_pieces

    kind = "doc string, id string, title string, registers array<struct<name:string,description:string,address:string,fields:array<struct<bits:string,name:string,access:string,description:string>>>>"
    reg = lambda n, address, *fields: (n, f"about {n}", address, list(fields))
    rows = [
        ("one", "b", "Port B", [reg("DDRB", "0x24", ("7:0", "DDB", "R/W", "")), reg("PINB", "", ("1", "X", "", ""))]),
        ("one", "a", "Port <A>", [reg("DDRA", "0x20", ("3:2", "A&B", "R", ""), ("x", "NO", "", "")), reg("PORTA", "0x21")]),
        ("one", "c", "None", []), ("two", "a", "Bare", [reg("NOWHERE", None)]), ("three", "a", "Empty", []),
    ]
    groups = spark.createDataFrame(rows, kind)
    whole = {r.doc: r for r in exports(groups, F.col("doc"), "x.pdf", "doc").collect()}
    for name, column in (("c", "c_header"), ("svd", "svd")):
        path = str(tmp_path / name)
        pieces = export_pieces(groups, name, F.col("doc"), "x.pdf")
        assert "collect_list" not in pieces._jdf.queryExecution().optimizedPlan().toString()
        sinks.write_exports(pieces, path)
        got = {r.doc: r.value for r in spark.read.text(path, wholetext=True).collect()}
        assert got == {d: r[column] for d, r in whole.items() if r[column]} and len(got) == (2 if name == "c" else 1)
    (tmp_path / "one.svd").write_text(whole["one"].svd)
    back = {r.title: [(x.name, x.address, [(f.bits, f.name, f.access) for f in x.fields]) for x in r.registers] for r in read_svd(spark, str(tmp_path / "svd")).collect()}
    assert back == {"Port_A": [("DDRA", "0x20", [("3:2", "A_B", "R")]), ("PORTA", "0x21", [])], "Port_B": [("DDRB", "0x24", [("7:0", "DDB", "R/W")])]}
