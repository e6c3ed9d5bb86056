"""Searches of tables of queries: equal to plain scoring, without nested loops, and with blocks left out."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliomill import sinks
from foliomill.operators import dictionary as D, search as S


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["adc", "adcs", "adder", "pwm", "pwm0", "timer", "time", "timers", "un_it", "common", "z9", "zz", "q"]
    docs = []
    for k in range(3000):
        text = ["common"] * (1 + int(rng.paretovariate(1.2))) + [rng.choice(words) for _ in range(rng.randrange(6))]
        docs.append((k, " ".join(text[:400])))
    docs += [(3000, None), (3001, ""), (3002, "the of a"), (3003, "ADC adc-Timer/pwm0")]
    rows = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    path = str(tmp_path_factory.mktemp("index"))
    sinks.write_index(S.postings(rows, "doc", (("text", 1),)), rows.select("doc"), path)
    return path, docs


QUERIES = [(1, "adc"), (2, "common"), (3, "tim tim timer"), (4, "pw zz COMMON"), (5, "q z the"), (6, "nothing"), (7, ""), (8, None), (9, "un_it, adde!"), (10, "ad ti pw")]


def plain(docs, query, top):
    import re

    tf = {d: Counter(t for t in re.findall("[a-z0-9_]+", (x or "").lower()) if len(t) > 1 and t not in D.K.INDEX_STOP) for d, x in docs}
    df = Counter(t for c in tf.values() for t in c)
    scores = defaultdict(float)
    for q in S.query_terms(query or ""):
        for d, c in tf.items():
            for t, n in c.items():
                if t.startswith(q):
                    scores[d] += n * (1 if t == q else 0.5) * math.log(1 + len(docs) / df[t])
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("top", [40, 3])
def test_tables_of_queries(spark, index, top):
    path, docs = index
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    got = defaultdict(list)
    for r in D.search_table(spark, path, queries, top).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc, r.score))
    for k, q in QUERIES:
        want = plain(docs, q, top)
        assert [d for d, _ in got[k]] == [d for d, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[k], want)), q
    one = [(r.doc, r.score) for r in S.search_index(spark, path, "pw zz common", top).collect()]
    assert one == got[4]


def test_blocks_are_left_out_and_tokens_meet_terms_by_keys(spark, index, tmp_path):
    path, _ = index
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max(F.size("entries"))).first()[0] <= D.BLOCK and blocks.filter("term = 'common'").count() > 20
    df = {r.term: r.df for r in spark.read.parquet(f"{path}/terms").collect()}
    assert df == {r.term: r["count"] for r in spark.read.parquet(f"{path}/postings").groupBy("term").count().collect() if len(r.term) > 1}
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    n = spark.read.parquet(f"{path}/about").first().n_docs
    plan = D.query_weights(queries, spark.read.parquet(f"{path}/terms"), n)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    D.query_weights(queries, spark.read.parquet(f"{path}/terms"), n).write.parquet(str(tmp_path / "w"))
    weights = spark.read.parquet(str(tmp_path / "w"))
    count = lambda skip: {r.query_id: r["count"] for r in D.wanted_blocks(weights, blocks, 40, skip).groupBy("query_id").count().collect()}
    every, some = count(False), count(True)
    assert some[2] < every[2] / 3 and sum(some.values()) < sum(every.values()) * 0.8 and set(some) == set(every)
