"""Operators 2, 4, 5, 9, 10 and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm import packing
from foliomill.llm.components import components
from foliomill.llm.language_id import LanguageModel, held_out
from foliomill.llm.mixing import mix, rates
from foliomill.llm.packing import best_fit, pack, plan, reduce_instance, tokenize
from foliomill.llm.quality import gumbel_top_k, importance, select_quality
from foliomill.llm.scratch import ranked
from foliomill.llm.topk_search import kd_leaves, top_k

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 50).alias("k"), "id").repartition(7)
    got = {r.id: r.place for r in ranked(df, [F.desc("k"), F.col("id")], "place", "t").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i * 7 % 50), i)))}
    assert ranked(df.limit(0), [F.col("k")], "place", "t").count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 330)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {(r.node, r.component) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(x, find(x)) for x in root}


# --- 2 ------------------------------------------------------------------------------------------
def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [(k, " ".join(rng.choice(["sun", "moon", "sky", "tree"]) for _ in range(60))) for k in range(80)]
    bad = [(100 + k, " ".join("%x%d" % (rng.randrange(9), rng.randrange(9)) for _ in range(60))) for k in range(20)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(10)] + [(5, 1, None), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    chosen = {r.doc_id for r in select_quality(table, labels).collect()}
    assert len(chosen) == round(100 * 43 / 53) and sum(i < 100 for i in chosen) >= 78
    assert {r.doc_id for r in select_quality(table, labels).collect()} == chosen
    assert select_quality(empty, labels).count() == 0
    assert select_quality(docs, labels.limit(0)).count() == docs.filter("doc_id is not null").count()
    weights = importance(docs, docs.limit(0)).collect()
    assert len(weights) == docs.filter("doc_id is not null").count() and all(math.isfinite(r.log_weight) for r in weights)


def test_importance_is_the_log_ratio(spark):
    table = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.log_weight for r in importance(table, table.filter("doc_id = 1")).collect()}
    n = packing.np.float64(1 << 16)
    raw, target = n + 6, n + 5  # a b a, a-b, b-a, c with one pseudo-count per bucket
    each = lambda t, r: math.log((t + 1) / target) - math.log((r + 1) / raw)
    assert got[1] == pytest.approx(2 * each(2, 2) + each(1, 1) * 3) and got[2] == pytest.approx(each(0, 1)) and got[3] == 0


def test_gumbel_top_k_follows_weights(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3.0)).otherwise(0.0).alias("log_weight"))
    taken = gumbel_top_k(table, 200).collect()
    even = sum(r.doc_id % 2 == 0 for r in taken)
    assert len(taken) == 200 and 125 < even < 175  # three of four


# --- 4 ------------------------------------------------------------------------------------------
def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(700, 8)))]
    vectors += [(700 + i, [0.5] * 8) for i in range(40)] + [(800, [0.25] * 3), (850, [0.5] * 3), (900, None), (950, [1.0, None]), (951, [float("nan")] * 8), (952, [float("inf")] * 8), (953, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors] + [(None, [0.1] * 8, "x"), (3, vectors[3][1], "x")], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 50 == 0).collect())
    clean = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in [*vectors, vectors[3]] if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in clean:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in clean if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_kd_leaves():
    v = np.random.default_rng(0).normal(size=(1000, 5))
    leaves = kd_leaves(v, 50)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 50
    assert [len(x) for x in kd_leaves(np.zeros((120, 3)), 50)] == [50, 50, 20]


# --- 5 ------------------------------------------------------------------------------------------
def check_layout(pieces, capacity):
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, rows, empty):
    exact = Tokenizer.from_file(PATHS[0])
    special = docs.withColumn("text", F.when(F.col("doc_id") == 9, F.lit("a <|endoftext|> b ж")).otherwise(F.col("text")))
    out = pack(tokenize(special, *PATHS)).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = exact.encode("a <|endoftext|> b ж" if i == 9 else text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in out) == want
    total = sum(r["length"] for r in out)
    assert check_layout(out, 2048) <= -(-total // 2048) + 1
    assert pack(tokenize(empty, *PATHS)).count() == 0
    assert {"source", "runs"} <= set(tokenize(docs, *PATHS).columns)


def optimum(sizes, capacity):
    """Least number of bins, by exhaustion."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in {*bins}:
            if b + sizes[k] <= capacity:
                i = bins.index(b)
                place(k + 1, bins[:i] + [b + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(5, 14)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = reduce_instance(counts, capacity)
        assert all(sum(s) <= capacity for _, s in fixed)
        rest = [s for s in range(capacity + 1) for _ in range(counts[s])]
        assert Counter(sizes) == Counter(rest) + Counter(x for n, s in fixed for x in s * n)
        assert sum(n for n, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity)
        packed = best_fit(counts, capacity)
        assert Counter(x for n, s in packed for x in s * n) == Counter(rest) and all(sum(s) <= capacity for _, s in packed)


def test_plan_handles_huge_counts():
    slots = plan({1: 10**12, 700: 10**11 + 3, 1348: 10**11, 2048: 5, 1000: 7})
    used = Counter()
    for length, a, b, *_ in slots:
        used[length] += b - a
    assert used == {1: 10**12, 700: 10**11 + 3, 1348: 10**11, 2048: 5, 1000: 7}


# --- 9 ------------------------------------------------------------------------------------------
def test_language_id(spark, docs, empty):
    rng = random.Random(6)
    speech = {"en": ["the", "and", "thing", "with", "house"], "de": ["und", "der", "nicht", "straße", "haus"], "fr": ["le", "et", "être", "maison", "avec"]}
    table = [(k, " ".join(rng.choice(speech[lang]) for _ in range(rng.randint(3, 60))), lang) for k, lang in enumerate([*speech] * 100)]
    table += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the house " * 200_000, None), (1004, "the and", None)]
    frame = spark.createDataFrame([(*r, 1.5, "zz") for r in table], "doc_id long, text string, lang string, score double, lang_pred string")
    model = LanguageModel.fit(frame.filter(~held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in model.predict(frame).withColumn("held", held_out(F.col("doc_id"))).collect()}
    assert all(r.held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    tested = [r for r in out.values() if r.held and r.lang and r.doc_id < 1000]
    assert len(tested) > 30 and all(r.lang == r.lang_pred for r in tested) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"] and out[1000].score == 0
    assert (model.weights == 0).mean() > 0.9  # sparse
    nobody = LanguageModel.fit(empty)
    assert {r.lang_pred for r in nobody.predict(docs).collect()} == {"und"} and model.predict(empty).count() == 0


def test_scores_do_not_depend_on_slices(monkeypatch):
    from foliomill.llm import language_id as M

    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b"], rng.normal(size=(M.DIM, 2)).astype(np.float32), np.zeros(2, np.float32), 3.0)
    texts = ["hello world " * 40, "x", "äöü" * 30, None, "..."]
    whole = model.scores(texts)
    monkeypatch.setattr(M, "SLICE", 7)
    parts = model.scores(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])
    assert np.array_equal(M.counted(texts[0])[1].sum(), sum(len(texts[0]) - n + 1 for n in M.ORDERS))


# --- 10 -----------------------------------------------------------------------------------------
def brute_targets(sizes, cycle=(1, 2, 3), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = sum(weight[s] for s in rest)
        left = total - sum(fixed.values())
        over = [s for s in rest if share and left * weight[s] / share > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing_targets(docs, rows, empty):
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(dict(sizes))
    out = rates(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.copies <= 3
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    copies = Counter()
    for r in out:
        copies[r.doc_id] += r.copies
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert rates(empty).count() == 0 and mix(empty).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    data = [(k, "w " * rng.randint(1, 40), ["a", "b", "c", None][min(3, int(rng.random() ** 2 * 4))]) for k in range(6000)]
    out = rates(spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n"), F.max("copies").alias("most")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target and r.most <= 3
    again = {r.doc_id: r.copies for r in out.collect()}
    assert {r.doc_id: r.copies for r in out.repartition(9).collect()} == again
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.copies) for r in rates(blank).collect()] == [(0, 0.0, 0)] * 2


# --- pipeline -----------------------------------------------------------------------------------
def test_pipeline(spark, unique_docs, tmp_path):
    import corpus_pipeline as P
    from test_advice import brute_long_lines
    from test_dedup import WORD, brute_components

    unique_docs.drop("digest", "runs", "size", "n", "id", "tag", "n_removed").write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = [f for _, f in P.STAGES]
    spoken = stages[0](spark, table, str(tmp_path))
    assert spoken.columns == table.columns and spoken.filter("text is null").count() == 0
    kept = {r.doc_id: r.text for r in spoken.collect()}
    assert all(any(c.isalpha() for c in t) for t in kept.values())
    lines = stages[1](spark, spoken, str(tmp_path))
    want = {i: t for (i, t, gone) in brute_long_lines(list(kept.items()), 2, P.LONG_WORDS) if not gone or WORD.search(t)}
    got = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == table.columns and got == want
    near = stages[2](spark, lines, str(tmp_path))
    stay = {i for i, _, c in brute_components(list(got.items())) if i == c}
    assert {r.doc_id for r in near.collect()} == stay
    mixed = stages[3](spark, near, str(tmp_path))
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} <= stay
    out = P.run(spark, str(tmp_path)).collect()
    check_layout(out, 2048)
    assert {r["doc_id"] for r in out} == {r.doc_id for r in mixed.collect()}
