"""Operators 11 to 13 against brute force."""

import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm.divergence import LEAST_DOCUMENTS, _terms, divergence, source_divergence
from foliomill.llm.grammar import Grammar
from foliomill.llm.hard_negatives import Block, Bucket, hard_negatives
from foliomill.llm.radix_select import top_rows
from foliomill.llm.scratch import folder
from foliomill.llm.token_store import read_ranges, read_tokens, write_tokens

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]


# --- 11 -----------------------------------------------------------------------------------------
def brute_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """``rows``: id, label, vector of whole numbers."""
    out = Counter()
    for a, label, v in rows:
        if a % anchors:
            continue
        scored = [(sum(int(x) * int(y) for x, y in zip(v, w)), i, own) for i, own, w in rows if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, own in scored if own == label)[:positives]
        for s, positive in best:
            window = sorted((-t, i) for t, i, own in scored if own != label and low * -s <= 100 * t <= high * -s)[:negatives]
            for rank, (t, i) in enumerate(window, 1):
                out[(a, positive, rank, i, -s, -t)] += 1
    return out


def vector_rows(n=700, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        width = 3 if k % 40 == 1 else 5
        v = (rng.normal(size=width) + 0.4) * math.exp(rng.normal())
        rows.append([k, k % 3 if k % 11 else None, [float(x) for x in v]])
    for k in range(60):  # ties
        rows[100 + k][2] = rows[100][2]
    rows[3][2], rows[6][2], rows[9][2], rows[12][2] = None, [1.0, None, 2.0, 3.0, 1.0], [float("nan")] * 5, []
    rows[15][2] = [float("inf"), 0.0, 0.0, 0.0, 0.0]
    rows += [[200, 1, [0.5, 1.0, 0.25, 0.1, 0.2]], [201, 1, rows[201][2]], [20, 1, [0.0] * 5], [None, 1, [1.0] * 5]]
    return rows


VECTORS = "vec_id long, label int, embedding array<double>, v string, norm int, place map<string, int>, who int"


def test_hard_negatives(spark):
    rows = vector_rows()
    docs = spark.createDataFrame([(*r, "x", 1, {"a": 1}, 2) for r in rows], VECTORS).repartition(3)
    whole = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    clean = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and whole(v)]
    for anchors in (10, 7):
        got = Counter(tuple(r) for r in hard_negatives(docs, F.col("vec_id") % anchors == 0, F.col("label")).collect())
        assert got == brute_negatives(clean, anchors) and len(got) > 200
    got = Counter(tuple(r) for r in hard_negatives(docs, F.col("vec_id") % 50 == 0, F.col("label"), 2, 40, 0, 100).collect())
    assert got == brute_negatives(clean, 50, 2, 40, 0, 100)
    assert hard_negatives(docs.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives(docs, F.lit(False), F.col("label")).count() == 0


def test_many_lanes(spark, monkeypatch):
    """Buckets of few rows, so that there are lanes that prune and positives of later lanes."""
    from foliomill.llm import hard_negatives as module

    monkeypatch.setattr(module, "BUCKET_BYTES", 20 * 8 * 5)
    monkeypatch.setattr(module, "BLOCK_BYTES", 8 * 8 * 5)
    rows = [r for r in vector_rows(900, 5) if r[0] is not None]
    docs = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], VECTORS)
    whole = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    clean = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and whole(v)]
    got = Counter(tuple(r) for r in hard_negatives(docs, F.col("vec_id") % 10 == 0, F.col("label")).collect())
    assert got == brute_negatives(clean, 10)


def test_buckets_are_pruned():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 8)) * np.exp(2 * rng.normal(size=(2000, 1)))
    norms = np.sqrt((v * v).sum(1))
    order = np.argsort(-norms)
    labels = rng.integers(0, 3, 2000)
    buckets = [Bucket(p, labels[p], norms[p], v[p]) for p in np.array_split(order, 40)]
    who = np.arange(50)
    block = Block(who, labels[:50], norms[:50], v[:50], (who, who * 0, np.full(50, -(1 << 63)), np.full(50, (1 << 63) - 1)))
    best = block.search(buckets, 5, True)
    scores = v[:50] @ v.T
    for k in range(50):
        own = [i for i in range(2000) if i != k and labels[i] == labels[k]]
        assert sorted(own, key=lambda i: (-scores[k, i], i))[:5] == best.found[k].tolist()
    assert block.visited < 50 * 40 / 2


# --- 12 -----------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3) | st.sampled_from([7, 2**31 - 1]), max_size=400), st.integers(1, 12), st.integers(0, 500), st.integers(-1, 80))
def test_grammar_round_trip(ids, times, start, size):
    ids = np.array(ids * times, np.uint32)
    g = Grammar.frombytes(Grammar.of(ids).tobytes())
    assert g.ids().tolist() == ids.tolist()
    assert g.slice(start, size).tolist() == ids[start : start + max(0, size)].tolist()
    assert g.lengths.tolist() == [len(g.expand(np.array([g.base + k], np.uint32))) for k in range(len(g.left))]


def test_grammar_compresses_and_says_what_is_broken():
    ids = np.tile(np.arange(40, dtype=np.uint32), 500)
    g = Grammar.of(ids)
    assert len(g.tobytes()) < len(ids.tobytes()) / 20 and len(g.left) >= 39
    pairs = Counter(zip(g.sequence.tolist(), g.sequence[1:].tolist()))
    assert not pairs or max(pairs.values()) < len(ids) / 50
    for raw in (b"", b"FMG1", g.tobytes()[:-4], b"x" * 40):
        with pytest.raises(ValueError):
            Grammar.frombytes(raw)
    g.left[5] = g.base + 5
    with pytest.raises(ValueError):
        g.ids()


def test_token_store(spark, docs, rows, empty):
    exact = Tokenizer.from_file(PATHS[0])
    path = folder(spark, "store")
    write_tokens(docs, path, *PATHS, shard_ids=2000)
    coded = [(r[0], exact.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert Counter((r.doc_id, np.frombuffer(r.ids, "<u4").tobytes()) for r in got) == Counter((i, np.array(x, "<u4").tobytes()) for i, x in coded)
    crc = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, path, keep_ids=False).collect())
    assert crc == Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got)
    assert spark.read.parquet(f"{path}/shards").count() > 5

    everything = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    rng = random.Random(3)
    wanted = [(k, rng.randrange(len(everything)), rng.choice([0, 1, 7, 900, 9000])) for k in range(60)] + [(99, len(everything) - 3, 50), (100, len(everything) + 5, 9), (101, 0, len(everything))]
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in read_ranges(spark, path, spark.createDataFrame(wanted, "key long, start long, length long"), page=3000).collect()}
    assert got == {k: everything[a : a + n].tolist() for k, a, n in wanted}

    nothing = folder(spark, "store")
    write_tokens(empty, nothing, *PATHS)
    assert read_tokens(spark, nothing).count() == 0


def test_long_documents_are_cut_into_grammars(spark, monkeypatch):
    from foliomill.llm import token_store

    monkeypatch.setattr(token_store, "SEGMENT_IDS", 300)
    text = " ".join(f"word{k % 37}" for k in range(2000))
    path = folder(spark, f"store-{uuid.uuid4().hex}")
    write_tokens(spark.createDataFrame([(2, text), (1, None), (3, "")], "doc_id long, text string"), path, *PATHS)
    want = Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in read_tokens(spark, path).collect()}
    assert got == {1: (0, [0]), 2: (1, [*want, 0]), 3: (len(want) + 2, [0])}
    part = read_ranges(spark, path, spark.createDataFrame([("x", 250, 700)], "key string, start long, length long")).first()
    assert np.frombuffer(part.ids, "<u4").tolist() == ([0, *want, 0, 0])[250:950]


# --- 13 -----------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, top):
    """``rows``: text, lang, source."""
    held, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        held[lang or ""].update(set(terms))
        groups[lang or ""][source or ""].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= LEAST_DOCUMENTS]
        count = {s: {t: c[t] for t in kept} for s, c in sources.items()}
        every = {t: sum(c[t] for c in count.values()) for t in kept}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in count.items()}, shares(every)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


def text_rows(n=260, seed=6):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("sun", "Moon", "é", "sKy", "你好", "x") for b in ("", "a", "b", "éé", "zz", "aa", "ab")]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", None, "ü", "rare"] if k % 30 else ["once"])
        bias = words if source != "s2" else words[10:30]
        rows.append((rng.choice(["!", " ", "\n", "_", "9"]).join(rng.choice(bias) for _ in range(rng.randrange(60))), lang, source))
    rows += [(None, "en", "s1"), ("", "de", "only"), ("one two", "it", "a"), ("one", "it", "b"), (None, None, None), ("\x00\x7f 123", "en", "void")]
    rows += [(" ".join(f"tie{k:03d}" for k in range(150)), "es", s) for s in ("a", "a", "a", "b")] + [("other words", "es", "b")] * 3
    return [*rows, rows[0], rows[0]]


DOCS = "text string, lang string, source string, doc_id long, term string, n string, docs map<string, int>, p int, q int, base int, value string, rank int"


@pytest.mark.parametrize("top", [200, 7, 1])
def test_divergence(spark, top):
    rows = text_rows()
    docs = spark.createDataFrame([(*r, k, "t", "n", {"a": 1}, 1, 2, 3, "v", 4) for k, r in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r) for r in source_divergence(docs, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence(docs).count() == 0
    one = spark.createDataFrame([("a b c", "en", "s")], "text string, lang string, source string")
    assert divergence(one).count() == 0


def test_terms_of_long_texts():
    text = ("Ab" * 900_000 + " x " + "é" * 700_000 + "1" + "word " * 300_000 + "end").encode()
    got = [t for part in _terms(text) for t in part]
    assert got == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]


def test_radix_select(spark):
    rng = random.Random(8)
    rows = []
    for g in range(6):
        for k in range([3, 40, 400, 400, 50, 2000][g]):
            value = [rng.randrange(1 << 60), 5, rng.randrange(4), rng.choice([0, (1 << 60) - 1]), (1 << 45) + rng.randrange(3), rng.randrange(1 << 20)][g]
            name = ("p" * rng.choice([0, 1, 2, 300])) + rng.choice(["", "é", "z", "\U0001f600"]) + str(k)
            rows.append((None if g == 0 else g, value, name, "kept"))
    table = spark.createDataFrame(rows, "g int, v long, name string, more string").repartition(5)
    for k in (1, 2, 37, 200, 5000):
        want = Counter()
        for g in {r[0] for r in rows}:
            want.update(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k])
        assert Counter(tuple(r) for r in top_rows(table, ["g"], "v", "name", k).collect()) == want, k
