"""Methods of the operators against plain versions, and their SQL on the tables."""

import math
import os
import random
import uuid
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import WORD, brute_components, collected
from test_others import check_layout
from tokenizers import Tokenizer

from foliomill.llm import jaccard_join, line_dedup, packing, quality, queries as Q, topk_search
from foliomill.llm.exact_dedup import DigestIndex
from foliomill.llm.language_id import DIM, LanguageModel, counted
from foliomill.llm.mixing import rates
from foliomill.llm.packing import Encoder, pack, plan, reduce_instance

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@tables
@pytest.mark.parametrize("name", list(Q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    found = con.sql(Q.SQL[name])
    df = Q.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in found.columns) for r in df.collect()) == Counter(found.fetchall())


# --- 8: the suffix array ------------------------------------------------------------------------
def run_texts():
    """Documents with shared runs of 2 to 200 lines, inside one another, and near copies of a long one."""
    rng = random.Random(12)
    line = lambda: f"l{rng.randrange(10**9)}"
    long = [line() for _ in range(200)]
    common = ["a", "b", "", "", "c"]
    docs = [long]
    for k in (2, 3, 4, 5, 7, 8, 9, 16, 31, 64, 100, 199, 200):
        at = rng.randrange(201 - k)
        docs.append([line(), *long[at : at + k], line(), *rng.choices(common, k=rng.randrange(9))])
    docs += [[*long[:100], line(), *long[101:]], long[50:], [*long, *long], ["a"] * 37, ["a", "b"] * 11, [""] * 6, [line()], long[:1], ["a", "b", "a"]]
    docs += [rng.choices(common, k=rng.randrange(1, 12)) for _ in range(25)]
    return [(k, "\n".join(d)) for k, d in enumerate(docs)]


def brute_runs(items, least):
    """Longest run from each place that starts elsewhere, where not the rest of the one before."""
    texts = [(i, t.split("\n")) for i, t in items]
    starts = defaultdict(list)
    for k, (_, ls) in enumerate(texts):
        for p, x in enumerate(ls):
            starts[x].append((k, p))
    out = set()
    for k, (i, ls) in enumerate(texts):
        before = 0
        for p, x in enumerate(ls):
            most = 0
            for q, s in starts[x]:
                if (q, s) != (k, p):
                    n, other = 0, texts[q][1]
                    while p + n < len(ls) and s + n < len(other) and ls[p + n] == other[s + n]:
                        n += 1
                    most = max(most, n)
            if most >= least and most != before - 1:
                out.add((i, p, most))
            before = most
    return out


@pytest.mark.parametrize("least", [1, 2, 5])
def test_maximal_runs(spark, least):
    items = run_texts()
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = [(r.id, r.pos, r.lines) for r in line_dedup.maximal_runs(docs, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(items, least)


def test_intervals_cross_chunks(spark, monkeypatch):
    """Neighbours in different tasks: intervals of an array dealt in chunks of two."""
    monkeypatch.setattr(line_dedup, "CHUNK", 1)
    lcp = [0, 3, 2, 2, 1, 2, 0, 0, 5, 5, 5]
    array = spark.createDataFrame(list(enumerate(lcp)), "r long, lcp long")
    got = [r.interval for r in line_dedup.intervals(array, 2).orderBy("r").collect()]
    assert got == [0, 0, 0, 0, 4, 4, 6, 7, 7, 7, 7]


# --- 6 ------------------------------------------------------------------------------------------
def test_signatures_with_few_filled_segments(monkeypatch):
    """All grams of larger sets in few segments: only the bands' common keys bring them together."""
    monkeypatch.setattr(jaccard_join, "schemes", lambda size, threshold, f=jaccard_join.schemes: tuple((b, 3, 40) for b, _, _ in f(size, threshold)))
    rng, base, items = random.Random(5), [f"w{k}" for k in range(120)], []
    for k in range(24):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        items.append((k, " ".join(copy)))
    grams = jaccard_join.gram_sets([t.encode() for _, t in items])
    assert all(len(g) > 40 and s[0][1] < 0 for g in grams for s in [jaccard_join.signatures(g)[1]])
    made = [set(jaccard_join.signatures(g)[0].tolist()) for g in grams]
    for a in range(len(grams)):
        for b in range(a):
            both = len(np.intersect1d(grams[a], grams[b]))
            if 100 * both >= 80 * (len(grams[a]) + len(grams[b]) - both):
                assert made[a] & made[b]


def test_signatures_meet_for_every_link():
    """Random linked sets of every size share a signature, with or without enough filled segments."""
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 5, 8, 13, 30, 41, 60, 120, 400]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = int(rng.integers(0, size // 9 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(jaccard_join.signatures(a)[0].tolist()) & set(jaccard_join.signatures(b)[0].tolist())


# --- 4 ------------------------------------------------------------------------------------------
def test_top_k_over_many_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk_search, "LANE_SHARDS", 1)
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 16)
    rng = np.random.default_rng(4)
    vectors = {k: rng.integers(-3, 4, 4) for k in range(200)}
    table = spark.createDataFrame([(k, (v / 256).tolist()) for k, v in vectors.items()], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(table, F.col("vec_id") % 10 == 0).collect())
    want = []
    for q in range(0, 200, 10):
        best = sorted((-int(vectors[q] @ v), k) for k, v in vectors.items() if k != q)[:5]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert got == want


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 3), (3, 2)] and got[0].score > 2**62 and got[2].score == -(2**63)


# --- 7 ------------------------------------------------------------------------------------------
def test_a_batch_may_be_added_again(spark):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    batch = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    rows = lambda: sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in index.add(batch).collect())
    first = rows()
    assert [x for x in rows() if x[0]] == [x for x in first if x[0]] == [(1, 2, False), (2, 2, True), (3, 3, True)]
    assert index.rows().count() == 3


@tables
def test_exact_dedup_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert Q.QUERIES["op7_exact_dedup"](spark, DATA).count()
    assert {t.name for t in spark.catalog.listTables()} == before


# --- 10 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_is_near_its_targets(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    out = rates(spark.read.parquet(path)).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.max("copies").alias("most")
    )
    for r in out.collect():
        assert r.most <= 3 and abs(r.taken - r.target) <= max(0.02 * r.target, r.largest)


# --- 5 ------------------------------------------------------------------------------------------
def test_many_slots(spark, monkeypatch):
    """Pieces meet slots by ranges of ranks where the slots are too many to broadcast."""
    monkeypatch.setattr(packing, "FEW_SLOTS", 0)
    monkeypatch.setattr(packing, "RANGES", 3)
    rng = random.Random(2)
    rows = [(k, rng.choice([1, 2, 3, 5, 8, 9, 10, rng.randint(1, 10)])) for k in range(700)]
    out = pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(5), capacity=10).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter(rows)
    assert check_layout([r.asDict() for r in out], 10) <= -(-sum(n for _, n in rows) // 10) + 3


def test_reduction_of_huge_counts():
    """Triples are fixed many at a time."""
    counts = np.zeros(101, np.int64)
    counts[[40, 36, 24]] = [10**9, 10**9 + 5, 10**9 + 2]
    fixed = reduce_instance(counts.copy(), 100)
    rest = counts.copy()
    for n, sizes in fixed:
        for s in sizes:
            rest[s] -= n
    assert (rest >= 0).all() and all(sum(s) <= 100 for _, s in fixed) and len(fixed) < 1000
    slots = plan({40: 10**9, 36: 10**9 + 5, 24: 10**9 + 2}, 100)
    assert len(slots) < 3000


@tables
def test_both_tokenizer_libraries_agree(spark):
    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    encoder, exact = Encoder(*paths), Tokenizer.from_file(paths[0])
    sf = "sf0.01" if os.path.isdir("/root/testdata/sf0.01") else "sf0.001"
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect():
        assert encoder.ids(r.text or "").tolist() == exact.encode(r.text or "", add_special_tokens=False).ids


# --- 2 ------------------------------------------------------------------------------------------
@tables
def test_quality_draws(spark):
    """Weights by counting grams of words in a dictionary of buckets, and the draw by sorting."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    good = {i for i, q, t in marks if q == 1 and not t}

    def buckets(text):
        w = [quality.Words([x.encode()]).hashes() for x in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
        h = np.concatenate(w) if w else np.zeros(0, np.uint64)
        pairs = [quality.windows(h[k : k + 2], 2)[0] for k in range(len(h) - 1)]
        return [int(x % np.uint64(quality.BUCKETS)) for x in [*(quality.mixed(h) if len(h) else []), *pairs]]

    of = {i: buckets(t) for i, t in rows}
    raw, target = (Counter(b for i in ids for b in of[i]) for ids in (list(of), [i for i in of if i in good]))
    log = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + quality.BUCKETS))
    table = {b: log(target, b) - log(raw, b) for b in raw}
    weight = {i: sum(table[b] for b in bs) for i, bs in of.items()}
    unit = {r.doc_id: r.u for r in docs.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))).alias("u")).collect()}
    drawn = sorted(of, key=lambda i: (-(weight[i] - math.log(-math.log(unit[i]))), i))
    k = round(len(rows) * sum(q == 1 for _, q, _ in marks) / sum(q is not None for _, q, _ in marks))
    got = Q.QUERIES["op2_quality"](spark, DATA).collect()
    assert {r.doc_id for r in got} == set(drawn[:k]) and len(got) == k
    assert all(r.log_weight == pytest.approx(weight[r.doc_id]) for r in got)


# --- 9 ------------------------------------------------------------------------------------------
def test_ftrl_against_plain_steps(spark):
    """The weights after training, by a plain version of the proximal update, number by number."""
    rng = random.Random(8)
    speech = {"en": ["the", "and", "thing"], "de": ["und", "der", "nicht"]}
    rows = [(k, " ".join(rng.choice(speech[x]) for _ in range(5)), x) for k, x in enumerate(["en", "de"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alpha, beta, l1, l2 = 1.0, 0.01, 1e-3, 1e-3
    model = LanguageModel.fit(docs, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)

    from foliomill.llm.language_id import hash_order

    df = Counter(int(f) for _, t, _ in rows for f in counted(t)[0])
    idf = lambda f: math.log((1 + len(rows)) / (1 + df[f])) + 1
    ordered = sorted(rows, key=lambda r: hash_order(r[0]))
    z, n = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])

    def weight(f, c):
        if abs(z[f][c]) <= l1:
            return 0.0
        return -(z[f][c] - math.copysign(l1, z[f][c])) / ((beta + math.sqrt(n[f][c])) / alpha + l2)

    for _ in range(2):
        for place, (_, text, lang) in enumerate(ordered):
            if place % 5 == 0:
                continue
            at, count = counted(text)
            x = {int(f): idf(int(f)) * k / count.sum() for f, k in zip(at, count)} | {DIM: 1.0}
            s = [sum(weight(f, c) * v for f, v in x.items()) for c in (0, 1)]
            p = [math.exp(a - max(s)) for a in s]
            p = [a / sum(p) for a in p]
            for f, v in x.items():
                for c, w in enumerate([weight(f, 0), weight(f, 1)]):
                    g = (p[c] - (model.languages[c] == lang)) * v
                    sigma = (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / alpha
                    z[f][c] += g - sigma * w
                    n[f][c] += g * g
    assert model.languages == ["de", "en"]
    assert model.bias.tolist() == pytest.approx([weight(DIM, 0), weight(DIM, 1)], rel=1e-4, abs=1e-6)
    for f in df:
        assert model.weights[f].tolist() == pytest.approx([weight(f, c) * idf(f) for c in (0, 1)], rel=1e-4, abs=1e-6)
    assert not model.weights[[f for f in range(DIM) if f not in df]].any()


# --- the pipeline's stages ----------------------------------------------------------------------
def test_stages_with_clashing_columns_and_repeated_rows(spark, docs, rows, empty):
    import corpus_pipeline as P

    extra = docs.withColumn("n_lines", F.lit(7)).withColumn("starts", F.lit("s")).withColumn("source_size", F.lit(1))
    spoken = P.language_id(spark, extra, "")
    lines = P.line_dedup(spark, spoken, "")
    near = P.near_duplicates(spark, lines, "")
    mixed = P.mixing(spark, near, "")
    for df in (spoken, lines, near, mixed):
        assert df.columns == extra.columns
        assert {(r.n_lines, r.n_removed, r.starts) for r in df.select("n_lines", "n_removed", "starts").distinct().collect()} == {(7, "q", "s")}
    kept = [(r.doc_id, r.text) for r in near.collect()]
    assert len(kept) == len(set(kept))  # rows that share id and text count once
    stay = {i for i, _, c in brute_components([(i, t) for i, t in kept if i is not None]) if i == c}
    assert {i for i, _ in kept if i is not None} == stay
    assert collected(P.packing(spark, mixed, ""), "doc_id")
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_near_duplicates_by_either_join(spark, monkeypatch):
    import corpus_pipeline as P

    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(k, words(k % 7) + (" tail" if k % 2 else ""), "en", f"s{k % 3}", None) for k in range(40)] + [(3, words(3) + " tail", "de", "s9", 1), (None, words(0), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter(map(tuple, P.near_duplicates(spark, docs, "").collect()))
    assert sorted(r[0] for r in got if r[0] is not None) == list(range(7)) and sum(got.values()) == 8
    monkeypatch.setattr(P, "FEW_KEYS", -1)
    assert Counter(map(tuple, P.near_duplicates(spark, docs, "").collect())) == got
