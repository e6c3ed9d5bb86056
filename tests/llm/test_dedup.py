"""Operators 1, 3, 6, 7 and 8 against brute force."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import jaccard_join, suffix_dedup
from foliomill.llm.exact_dedup import DigestIndex
from foliomill.llm.jaccard_join import jaccard_components
from foliomill.llm.line_dedup import dedup_lines
from foliomill.llm.substring_dedup import dedup_substrings
from foliomill.llm.suffix_array import repeated_starts, suffix_array
from foliomill.llm.suffix_dedup import dedup_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).digest()


def collected(df, *columns):
    clean = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return Counter(tuple(clean(v) for v in r) for r in df.select(*columns).collect())


def pairs(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def brute_substring(items, width):
    first = {}
    for i, text in items:
        w = WORD.findall(text or "")
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, text in items:
        w = WORD.findall(text or "")
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), int(gone.sum()), sha(kept.encode()))] += 1
    return out


def test_substring_dedup(docs, rows, empty):
    columns = ["doc_id", "n_words", "n_removed", "digest"]
    assert collected(dedup_substrings(docs), *columns) == brute_substring(pairs(rows), 50)
    assert dedup_substrings(empty).count() == 0


def brute_bytes(items, width):
    raw = [(i, (t or "").encode()) for i, t in items]
    seen = Counter(b[p : p + width] for _, b in raw for p in range(len(b) - width + 1))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out[(i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    return out


BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "digest"]


@pytest.mark.parametrize("width,hot", [(400, 2000), (60, 1)])
def test_suffix_dedup(docs, rows, width, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert collected(dedup_suffixes(docs, width), *BYTES) == brute_bytes(pairs(rows), width)


@pytest.mark.parametrize("hot", [40, 2000])
def test_suffix_dedup_of_a_large_family(spark, hot, monkeypatch):
    """Thousands of near copies, all with one anchor: groups are divided until they fit a shard."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefghij ") for _ in range(40))
    letter = lambda: rng.choice("klmnopqrst")
    items = [(k, "".join(letter() for _ in range(k % 37)) + "xy" * (k % 5) + core + "".join(letter() for _ in range(k % 3)) + "z" * (20 + k % 23)) for k in range(2500)]
    items += [(3000 + k, items[k * 7][1]) for k in range(40)]
    got = collected(dedup_suffixes(spark.createDataFrame(items, "doc_id long, text string"), 60), *BYTES)
    assert got == brute_bytes(items, 60)


def test_suffix_dedup_empty(empty):
    assert dedup_suffixes(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = [*rng.integers(1, rng.integers(2, 5), rng.integers(1, 70)).tolist(), 0]
        assert suffix_array(np.array(t, np.uint16)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        parts = [bytes(rng.integers(97, 99, rng.integers(0, 20)).astype(np.uint8)) for _ in range(4)]
        seen = Counter(p[i : i + 3] for p in parts for i in range(len(p) - 2))
        want = [[i for i in range(len(p) - 2) if seen[p[i : i + 3]] > 1] for p in parts]
        assert [x.tolist() for x in repeated_starts(parts, 3)] == want


def brute_components(items, threshold=80):
    sets = []
    for _, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(items):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(items))


def test_jaccard_components(docs, rows, empty, threshold=80):
    got = collected(jaccard_components(docs, threshold), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(pairs(rows), threshold)
    assert jaccard_components(empty).count() == 0


def test_jaccard_chain_of_small_sets(spark):
    """Sets of few grams, where segments are often empty, and a chain whose ends are not linked."""
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(words[a : a + n]) for n in (5, 6, 9, 13, 29) for a in range(0, 6)]
    items = list(enumerate(texts))
    got = collected(jaccard_components(spark.createDataFrame(items, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(items)


def test_jaccard_family_near_the_threshold(spark, monkeypatch):
    """Many near copies of which few are linked: small blocks, and several rounds with few partners."""
    monkeypatch.setattr(jaccard_join, "MEETING", 5)
    monkeypatch.setattr(jaccard_join, "FIRST_PARTNERS", 1)
    rng, base = random.Random(3), [f"w{k}" for k in range(160)]
    items = []
    for k in range(70):
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        items.append((k, " ".join(copy)))
    got = collected(jaccard_components(spark.createDataFrame(items, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(items)
    assert 5 < len({c for _, _, c in got}) < 65


def test_exact_dedup(spark, docs, rows, empty):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    last = {t: max(i for i in g if i is not None) for t, g in groups.items()}
    want = Counter()
    for r in rows:
        t = (r[1] or "").translate(LOWER)
        want[(r[0], last[t], len(groups[t]), r[0] == last[t], sha(t.encode()))] += 1
    assert collected(index.add(docs), "doc_id", "keep_id", "group_size", "kept", "digest") == want
    assert index.rows().count() == len(groups)
    new = spark.createDataFrame([(1000, "brand new"), (1001, "Brand NEW"), (1002, None)], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in DigestIndex(spark, index.table).add(new).collect()}
    assert got == {(1000, 1001, False), (1001, 1001, True), (1002, last[""], False)}
    assert index.add(empty).count() == 0


def brute_lines(items, width, fingerprint=None):
    """``fingerprint`` orders texts that share an id."""
    fingerprint = fingerprint or {t: 0 for _, t in items}
    items = [(-1 if i is None else i, t) for i, t in items]
    first = {}
    texts = {(i, t) for i, t in items if t is not None}
    order = lambda i, t, p: (i, fingerprint[t], p)
    for i, t in texts:
        ls = t.split("\n")
        for p in range(len(ls) - width + 1):
            if WORD.search("".join(ls[p : p + width])):
                key = tuple(ls[p : p + width])
                first[key] = min(first.get(key, order(i, t, p)), order(i, t, p))
    out = Counter()
    for i, t in items:
        if t is None:
            out[(i, None, 0, 0)] += 1
            continue
        ls = t.split("\n")
        gone = [False] * len(ls)
        for p in range(len(ls) - width + 1):
            key = tuple(ls[p : p + width])
            if key in first and first[key] < order(i, t, p):
                gone[p : p + width] = [True] * width
        out[(i, "\n".join(x for x, g in zip(ls, gone) if not g), len(ls), sum(gone))] += 1
    return out


@pytest.mark.parametrize("width", [2, 3])
def test_line_dedup(docs, rows, empty, width):
    out = dedup_lines(docs, width)
    assert set(docs.columns) <= set(out.columns)
    prints = {r.text: r.p for r in docs.select("text", F.xxhash64("text").alias("p")).collect()}
    out = out.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    assert collected(out, "doc_id", "text", "n_lines", "n_removed") == brute_lines([(r[0], r[1]) for r in rows], width, prints)
    assert dedup_lines(empty).count() == 0
