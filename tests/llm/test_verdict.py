"""Texts and tables that once gave wrong results or stopped an operator."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foliomill.llm.jaccard_join import jaccard_components
from foliomill.llm.language_id import LanguageModel
from foliomill.llm.packing import Encoder, tokenize
from foliomill.llm.substring_dedup import dedup_substrings
from foliomill.llm.suffix_dedup import dedup_suffixes
from foliomill.llm.words import PRIME, Words, product, residue_windows

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]


def thue_morse(bits, pair):
    """The word over two letters that collides with its complement in polynomials modulo 2**64."""
    return "".join(pair[bin(k).count("1") % 2] for k in range(1 << bits))


def test_words_that_collide_modulo_a_power_of_two(spark):
    a, b = thue_morse(9, "hm"), thue_morse(9, "mh")
    around = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join([*around, a])), (2, " ".join([*around, b])), (3, " ".join([*around, a]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(docs).collect()}
    assert got == {1: (50, 0), 2: (50, 0), 3: (50, 50)}
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_opened_windows_that_collide_modulo_a_power_of_two(spark):
    """The same in windows that are opened: their anchor recurs beside different stretches."""
    a, b = thue_morse(9, "hm"), thue_morse(9, "mh")
    around, tails = [f"w{k}" for k in range(49)], [[f"{t}{k}" for k in range(30)] for t in "xy"]
    rows = [(1, " ".join([*around, a, *tails[0]])), (2, " ".join([*around, b, *tails[1]]))]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_bytes_that_collide_modulo_a_power_of_two(spark):
    rows = [(1, "z" * 144 + thue_morse(8, ")@")), (2, "z" * 144 + thue_morse(8, "@)")), (3, "y" * 10 + "z" * 144 + thue_morse(8, ")@"))]
    got = {r.doc_id: (r.n_removed, bytes(r.digest)) for r in dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    nothing, kept = hashlib.sha256(b"").digest(), lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {1: (400, nothing), 2: (0, kept(rows[1][1])), 3: (400, kept("y" * 10))}


def test_hashes_modulo_the_prime():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, PRIME, (2, 20_000), dtype=np.uint64)
    a[:2] = b[:2] = PRIME - 1
    assert product(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    words = Words([thue_morse(9, "hm").encode(), thue_morse(9, "mh").encode(), b"hm hm"])
    assert len(set(words.residues().tolist())) == 3 and len(set(words.residues(1).tolist())) == 3
    again = residue_windows(np.concatenate([a[:50], a[:50]]), 7)
    assert again[:44].tolist() == again[50:].tolist() and len(set(again[:50].tolist())) == 50


def test_long_runs_of_one_character():
    encoder, exact = Encoder(*PATHS), Tokenizer.from_file(PATHS[0])
    for c in " \n\ta1!é́ ":
        text = "x" + c * 1_000_000 + "y"
        assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(c)


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000)], "doc_id long, text string")
    got = tokenize(docs, *PATHS, keep_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    exact = Tokenizer.from_file(PATHS[0])
    assert {r.doc_id: r.n for r in got} == {r.doc_id: len(exact.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_letters_are_of_category_l(spark):
    train = spark.createDataFrame([(k, ("sun moon sky " if k % 2 else "soleil lune ciel ") * 5, "en" if k % 2 else "fr") for k in range(40)], "doc_id long, text string, lang string")
    model = LanguageModel.fit(train)
    texts = ["²½ ①", "Ⅷ", "12 _ ٣", "²½ sun moon", "ª", "ﾞ", "我"]
    lang, score = model.scores(texts)
    assert [x == "und" for x in lang] == [not any(map(str.isalpha, t)) for t in texts] and lang[3] == "en"
    assert all((s == 0) == (x == "und") for s, x in zip(score, lang))


def test_languages_are_bounded(spark):
    """Dirty labels, of which the model keeps the most frequent."""
    rows = [(k, "sun moon sky tree", "en") for k in range(30)] + [(100 + k, "soleil lune ciel arbre", "fr") for k in range(20)]
    rows += [(1000 + k, f"text {k}", f"label {k}") for k in range(10_000)]
    model = LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3, most_rows=45)
    assert model.languages == ["en", "fr", "label 0"] and model.weights.shape[1] == 3
    assert model.scores(["moon sky", "ciel lune"])[0] == ["en", "fr"]


def test_near_duplicates_with_maps(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, {"b": 2, "a": 1}, [{"x": 1}]), (1, words, {"a": 1}, None), (2, words + " more", {"c": 1}, None), (3, "other text", None, None), (None, words, {"n": 0}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>, deep array<map<string, int>>")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 3), (True, None)]
    assert next(r.tags for r in got if r.doc_id == 1) in ({"a": 1}, {"b": 2, "a": 1})
