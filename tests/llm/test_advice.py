"""Findings of the review: each of these failed before."""

import uuid
from collections import Counter

import corpus_pipeline
from foliomill.llm.exact_dedup import DigestIndex
from foliomill.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


def long_line_rows():
    long, short = words("w", 50), words("v", 49)
    texts = [f"a\n{long}\nb\n{short}\nc", f"d\n{long}\ne", long, f"f\n{short}\ng", short, f"{long}\n{long}", "x\ny\nz", "x\ny\nq", None, ""]
    return [(k, t) for k, t in enumerate(texts)]


def brute_long_lines(items, width, long_words):
    seen, out = set(), Counter()
    for i, t in sorted(items):
        if t is None:
            out[(i, None, 0)] += 1
            continue
        ls = t.split("\n")
        gone = set()
        for p in range(len(ls)):
            for n in (width, 1):
                run = tuple(ls[p : p + n])
                counts = len(run) == n and (any(x.split() for x in run) if n == width else len(run[0].split()) >= long_words)
                if counts and run in seen:
                    gone |= set(range(p, p + n))
                if counts:
                    seen.add(run)
        out[(i, "\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))] += 1
    return out


def test_long_single_lines(spark):
    rows = long_line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, dedup_lines(docs, long_words=50).select("doc_id", "text", "n_removed").collect()))
    assert got == brute_long_lines(rows, 2, 50)


def test_pipeline_deletes_long_single_lines(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in long_line_rows()], SCHEMA)
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out[1] == "d\ne" and 2 not in out and 5 not in out and out[4] == words("v", 49)


def test_near_duplicates_without_or_with_repeated_id(spark):
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    near = a + " tail"
    rows = [
        (1, a, "en", "t", None), (1, a, "en", "s", None), (1, a, "en", "s", None),  # one document, three rows
        (2, near, "en", "s", None), (2, c, "en", "s", None),  # one text goes with 1, the other stays
        (3, b, "en", "s", None), (4, b, "en", "s", None), (4, c, "en", "s", None),
        (None, a, "en", "s", None), (None, None, None, None, None),
        (5, "", "en", "s", None), (6, "", "en", "s", None), (6, "", "en", "s", None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a, "en", "s", None), (2, c, "en", "s", None), (3, b, "en", "s", None), rows[8], rows[9], rows[10], rows[11]]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_near_duplicates_of_one_id(spark):
    a = words("a", 60)
    docs = spark.createDataFrame([(7, a, "en", "s", None), (7, a + " tail", "en", "s", None)], SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1


def test_anti_join_decides_what_is_new(spark):
    """A digest that the index has stays known even where the document that stays has no id."""
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    schema = "doc_id long, text string"
    index.add(spark.createDataFrame([(None, "Seen"), (1, "other")], schema))
    got = {tuple(r) for r in index.add(spark.createDataFrame([(5, "seen"), (6, "Other"), (7, "new")], schema)).select("doc_id", "keep_id", "kept").collect()}
    assert got == {(5, None, False), (6, 1, False), (7, 7, True)}
    assert index.rows().count() == index.rows().select("digest").distinct().count() == 3
