"""Calls of models under load, and answers that are kept as they are made."""

import os
import threading
import time
import urllib.error
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliomill.operators import clients, enrich as E
from foliomill.operators.calls import Policy, answers
from foliomill.plans.build import Settings, answer_cache, build, enriched

QUICK = Policy(parallel=6, attempts=3, limit=5, wait=0.01)


def test_calls_run_at_once_and_keep_their_order():
    lock, now, most = threading.Lock(), [0], [0]

    def ask(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (5 - k % 5))
        with lock:
            now[0] -= 1
        return k * k

    began = time.time()
    assert [a for a, _ in answers(ask, ((k,) for k in range(40)), QUICK)] == [k * k for k in range(40)]
    assert most[0] == 6 and time.time() - began < 40 * 0.06 / 2


def test_failed_calls_are_tried_again_and_late_ones_given_up():
    tries = {}

    def ask(k):
        tries[k] = tries.get(k, 0) + 1
        if k == 1 and tries[k] < 3:
            raise urllib.error.HTTPError("", 503, "busy", {"Retry-After": "0.01"}, None)
        if k == 2:
            raise urllib.error.HTTPError("", 400, "wrong", {}, None)
        if k == 3:
            raise ConnectionError("down")
        if k == 4:
            time.sleep(2)
        return k

    got = list(answers(ask, [(k,) for k in range(6)], Policy(parallel=3, attempts=3, limit=0.2, wait=0.01)))
    assert [a for a, _ in got] == [0, 1, None, None, None, 5] and tries == {0: 1, 1: 3, 2: 1, 3: 3, 4: 3, 5: 1}
    assert [type(e).__name__ for _, e in got] == ["NoneType", "NoneType", "HTTPError", "ConnectionError", "TimeoutError", "NoneType"]
    assert list(answers(ask, [], QUICK)) == []


def test_refused_and_cut_answers_are_not_used():
    def reply(**more):
        create = lambda **_: SimpleNamespace(**more)
        return clients.cloud_client(connect=lambda: SimpleNamespace(messages=SimpleNamespace(create=create)), timeout=3)("m")

    text = SimpleNamespace(type="text", text='{"summary": "x"}')
    assert reply(content=[text, text], stop_reason="end_turn")("t", "x") == '{"summary": "x"}' * 2
    for answer in (dict(content=[text], stop_reason="refusal"), dict(content=[text], stop_reason="max_tokens"), dict(content=[], stop_reason="end_turn")):
        with pytest.raises(clients.Unusable):
            reply(**answer)("t", "x")


@pytest.fixture
def counted(tmp_path, monkeypatch):
    """A backend whose every call leaves a file, and which can't answer where a file tells it so."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def factory(model):
        def ask(title, text):
            name = f"{title}-{time.time_ns()}-{os.getpid()}-{threading.get_ident()}"
            (folder / name).write_text(text)
            if (folder.parent / f"kill-{title}").exists():
                time.sleep(1.5)  # the others end meanwhile
                os._exit(7)
            if (folder.parent / f"fail-{title}").exists():
                raise ValueError("no answer")
            return '{"summary": "about ' + title + '", "registers": [{"name": "R", "fields": [{"bits": "3:0", "name": "F", "access": "R/W"}]}]}'

        return ask

    monkeypatch.setitem(E.BACKENDS, "ollama", factory)
    monkeypatch.setitem(E.PROBES, factory, lambda: not (tmp_path / "down").exists())
    return SimpleNamespace(folder=folder, asked=lambda: sorted(p.name.split("-")[0] for p in folder.iterdir()), path=tmp_path)


SECTIONS = [(f"d/s{k}", f"t{k}", f"text {k}") for k in range(20)] + [("d/again", "t3", "text 3")]


def test_answers_are_kept_and_asked_for_once(spark, counted):
    sections = spark.createDataFrame(SECTIONS, "section_id string, title string, text string")
    settings = Settings(backend="ollama", calls=QUICK)
    cache = answer_cache(spark, str(counted.path / "cache"), buckets=4)
    (counted.path / "fail-t5").touch()
    got = {r.section_id: r for r in enriched(sections.limit(12).union(sections.filter("section_id = 'd/again'")), settings, cache).collect()}
    assert counted.asked() == sorted(f"t{k}" for k in range(12)) and len(got) == 13
    assert (got["d/s3"].summary, got["d/s3"].backend, got["d/s3"].registers[0].fields[0].bits) == ("about t3", "ollama", "3:0")
    assert (got["d/s5"].summary, got["d/s5"].backend) == ("", "none") and got["d/again"].summary == "about t3"
    again = {r.section_id: r for r in enriched(sections, settings, answer_cache(spark, str(counted.path / "cache"), buckets=4)).collect()}
    assert counted.asked() == sorted(f"t{k}" for k in range(20)) and len(again) == 21 and again["d/s5"] == got["d/s5"]
    spark.sql(f"drop table {cache.name}")  # as in a new session
    assert enriched(sections, settings, answer_cache(spark, str(counted.path / "cache"), buckets=4)).count() == 21 and len(counted.asked()) == 20
    (counted.path / "fail-t5").unlink()
    anew = {r.section_id: r for r in enriched(sections, Settings(backend="ollama", calls=QUICK, resume=False), cache).collect()}
    assert len(counted.asked()) == 40 and len(anew) == 21 and anew["d/s5"].backend == "ollama"
    assert enriched(sections, Settings(backend="ollama", model="other", calls=QUICK), cache).count() == 21 and len(counted.asked()) == 60


def test_a_small_delta_does_not_shuffle_the_cache(spark, counted):
    cache = answer_cache(spark, str(counted.path / "cache"), buckets=4)
    rows = spark.range(50).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    cache.add(E.enrich(rows, key="cache_key"))
    delta = spark.createDataFrame([("k1", "t"), ("n1", "t"), ("n1", "t")], "cache_key string, title string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the cache were large
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (cache.lacking(delta), delta.join(cache.read(), "cache_key"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "cache_key" in line)
        above = plan[: plan.index(scan)].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        path, level = [], depth(scan)
        for line in reversed(above):
            if depth(line) < level:
                path.append(line)
                level = depth(line)
        assert not any("Exchange hashpartitioning" in line for line in path), plan
    assert [r.cache_key for r in cache.lacking(delta).collect()] == ["n1"]
    assert delta.join(cache.read(), "cache_key").count() == 1


def test_a_killed_job_keeps_finished_answers(spark, counted):
    sections = spark.createDataFrame(SECTIONS[:20], "section_id string, title string, text string")
    cache = answer_cache(spark, str(counted.path / "cache"), buckets=8)
    settings = Settings(backend="ollama", calls=Policy(parallel=1, attempts=1, limit=30))
    (counted.path / "kill-t7").touch()
    with pytest.raises(Exception):
        enriched(sections, settings, cache)
    kept = cache.read().count()
    assert 0 < kept < 20
    (counted.path / "kill-t7").unlink()
    before = len(counted.asked())
    assert {r.summary for r in enriched(sections, settings, cache).collect()} == {f"about t{k}" for k in range(20)}
    assert len(counted.asked()) - before == 20 - kept


def test_a_corrupt_file_counts_as_absent(spark, counted):
    sections = spark.createDataFrame(SECTIONS[:20], "section_id string, title string, text string")
    cache = answer_cache(spark, str(counted.path / "cache"), buckets=4)
    settings = Settings(backend="ollama", calls=QUICK)
    enriched(sections, settings, cache)
    broken = sorted((counted.path / "cache").rglob("*.parquet"))[0]
    broken.write_bytes(b"nonsense")
    broken.with_name(f".{broken.name}.crc").unlink(missing_ok=True)
    left = cache.read().count()
    assert left < 20 and enriched(sections, settings, cache).count() == 20 and len(counted.asked()) == 40 - left


def test_a_build_pays_once(spark, counted):
    o = spark.createDataFrame([("d", 0, 1, "1 Overview", 0), ("d", 1, 1, "2 Pins", 1)], "doc string, ord int, level int, title string, page int")
    p = spark.createDataFrame([("d", 0, "first"), ("d", 1, "second")], "doc string, page int, text string")
    settings = Settings.of("medium", calls=QUICK)
    for n, cache in ((2, None), (4, answer_cache(spark, str(counted.path / "cache"))), (4, answer_cache(spark, str(counted.path / "cache")))):
        out = build(o, p, settings=settings, cache=cache)
        for name, t in out.items():
            t.write.mode("overwrite").parquet(str(counted.path / "out" / name))
        assert len(counted.asked()) == n
        assert {r.s for r in out["search_docs"].collect()} == {"about 1 Overview", "about 2 Pins"}
    (counted.path / "down").touch()
    with pytest.warns(UserWarning, match="can't be reached"):
        build(o, p, settings=settings, cache=answer_cache(spark, str(counted.path / "cache")))
