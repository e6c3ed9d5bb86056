"""Enrichment of sections: keywords, summaries, registers, code, and pluggable language models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import constants as K
from ..functions.text import code_examples, registers, strip, summary
from .calls import Policy, answers
from .clients import cloud_available, cloud_client, local_available, local_client



def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


#: What a model is asked for; workers derive a JSON schema from it, without a session.
ANSWERED = StructType([
    StructField("summary", StringType()),
    StructField("keywords", ArrayType(StringType())),
    StructField("registers", ArrayType(StructType([*_texts("name", "description", "address"), StructField("fields", ArrayType(_texts("bits", "name", "access", "description")))]))),
    StructField("code_examples", ArrayType(_texts("title", "language", "code"))),
])
#: An enrichment: that and where it came from.
ENRICHMENT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANSWERED) + ", backend string"


def keywords(df: DataFrame, key: str, text: str, top: int = 12) -> DataFrame:
    """``key, word, weight, rank``: words that look like identifiers count twice; ties go to the
    first in the text.  Texts are dealt by key, and what is counted and ranked stays where they are: a text
    is shorter than its counts.  As many tasks as a shuffle has share it, however short the texts."""
    df = df.select(F.col(key), F.col(text)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))
    words = df.select(F.col(key), F.posexplode(F.regexp_extract_all(text, F.lit(K.KEYWORD_TOKEN), F.lit(0))).alias("pos", "word"))
    words = words.filter(~F.lower("word").isin(K.KEYWORD_STOP))
    heavy = (F.col("word") == F.upper("word")) | F.col("word").rlike(".[A-Z]")
    counts = words.groupBy(key, "word").agg(F.sum(F.when(heavy, 2).otherwise(1)).cast("long").alias("weight"), F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "pos"))
    return counts.withColumn("rank", nth).filter(F.col("rank") <= top).select(key, "word", "weight", "rank")


def found_in_text(sections: DataFrame, key: str = "section_id", text: str = "text") -> DataFrame:
    """The heuristic enrichment of every section but its keywords, which alone need a shuffle."""
    t = F.col(text)
    return sections.select(key, summary(t).alias("summary"), registers(t).alias("registers"), code_examples(t).alias("code_examples"))


def baseline(sections: DataFrame, key: str = "section_id", text: str = "text", backend: str = "none") -> DataFrame:
    """The heuristic enrichment of every section."""
    best = keywords(sections, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("k"))
    best = best.select(F.col(key).alias("__key"), F.transform("k", lambda x: x["word"]).alias("keywords"))
    made = found_in_text(sections, key, text)
    out = made.join(best, made[key].eqNullSafe(best["__key"]), "left")
    return out.select(key, "summary", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "registers", "code_examples", F.lit(backend).alias("backend"))


#: A brace, or a string from its quote to the closing one (or to the end).
_BRACE = re.compile(r'[{}]|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.DOTALL)


@F.pandas_udf(StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    """The first balanced object in a text, minding strings and escapes; null if none closes."""

    def find(s: str | None) -> str | None:
        at = (s or "").find("{")
        depth = 0
        for found in _BRACE.finditer(s, at) if at >= 0 else ():
            if (c := found[0]) in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return s[at : found.end()]
        return None

    return raw.map(find)


@F.pandas_udf(StringType())
def first_valid_object(raw: pd.Series) -> pd.Series:
    """The first balanced object in a text, if it is valid JSON."""

    def valid(blob: str | None) -> str | None:
        try:
            return blob if blob is not None and isinstance(json.loads(blob), dict) else None
        except ValueError:
            return None

    return first_json_object.func(raw).map(valid)


#: Values that may be anything come as their JSON text; what is in a list is looked at one by one.
ANSWER = "summary string, keywords string, registers string, code_examples string"
REGISTER = "name string, description string, address string, fields string"
FIELD = "bits string, name string, access string, description string"
EXAMPLE = "title string, language string, code string"


def _objects(text: Column, schema: str) -> Column:
    """The objects of a JSON list, whatever else it holds; empty where there is no list."""
    items = F.coalesce(F.from_json(text, "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    return F.transform(objects, lambda v: F.from_json(F.to_json(v), schema))


def merge_answer(raw: Column, base: Column, backend: Column) -> Column:
    """An answer of a language model laid over the baseline; what is missing or malformed keeps the
    baseline, whole if there is no valid object (its provenance too)."""
    blob = first_valid_object(raw)
    data = F.from_json(blob, ANSWER)
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    given = data["keywords"]
    as_list = F.from_json(given, "array<string>")
    split = F.filter(F.transform(F.split(given, ","), strip), lambda x: x != "")
    words = F.when(F.coalesce(given, F.lit("")).isin("", "[]"), base["keywords"]).when(given.startswith("["), as_list).otherwise(split)
    field = lambda f: F.struct(*[text(f[n]).alias(n) for n in ("bits", "name", "access", "description")])
    regs = F.transform(
        F.filter(_objects(data["registers"], REGISTER), lambda r: F.coalesce(r["name"], F.lit("")) != ""),
        lambda r: F.struct(
            *[text(r[n]).alias(n) for n in ("name", "description", "address")], F.transform(_objects(r["fields"], FIELD), field).alias("fields")
        ),
    )
    either = lambda c, default: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(default))
    code = F.transform(
        F.filter(_objects(data["code_examples"], EXAMPLE), lambda c: text(c["code"]) != ""),
        lambda c: F.struct(
            either(F.coalesce(c["title"], F.lit("Example")), "Example").alias("title"), either(F.coalesce(c["language"], F.lit("c")), "c").alias("language"),
            F.regexp_replace(c["code"], r"(?U)\s+\z", "").alias("code"),
        ),
    )
    merged = F.struct(
        F.coalesce(F.nullif(text(data["summary"]), F.lit("")), base["summary"]).alias("summary"),
        F.slice(words, 1, 16).alias("keywords"),
        F.when(F.size(regs) > 0, regs).otherwise(base["registers"]).alias("registers"),
        F.when(F.size(code) > 0, code).otherwise(base["code_examples"]).alias("code_examples"),
        backend.alias("backend"),
    )
    return F.when(blob.isNotNull(), merged).otherwise(base)


#: Language model backends by name: a factory ``model -> (title, text) -> answer``.  A client is made
#: once per partition.  Register another to use it.
BACKENDS: dict[str, Callable] = {"ollama": local_client(), "anthropic": cloud_client()}
#: What tells whether a backend that comes with the library can be reached.
PROBES: dict[Callable, Callable[[], bool]] = {BACKENDS["ollama"]: local_available, BACKENDS["anthropic"]: cloud_available}
ALIASES = {"none": "none", "ollama": "ollama", "anthropic": "anthropic", "claude": "anthropic"}


def get_backend(name: str) -> str:
    try:
        return ALIASES[(name or "none").lower()]
    except KeyError:
        raise ValueError(f"unknown backend: {name}") from None


def available(name: str) -> bool:
    name = get_backend(name)
    return name == "none" or (name in BACKENDS and PROBES.get(BACKENDS[name], lambda: True)())


def enrich(
    sections: DataFrame, backend: str = "none", model: str | None = None, key: str = "section_id", policy: Policy = Policy(), partitions: int | None = None,
) -> DataFrame:
    """Baseline, with a backend's answers merged on top; a section whose call fails keeps its baseline.

    The model is asked last, after everything is shuffled: what a task has been told goes into its
    output at once.  With ``partitions`` rows are dealt by ``key`` into so many tasks; each makes its
    calls as ``policy`` says.
    """
    name = get_backend(backend)
    base = baseline(sections, key)
    asked = name != "none" and name in BACKENDS
    if not asked:
        return base if partitions is None else base.repartition(partitions, key)
    factory = BACKENDS[name]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory(model)
        for whole in batches:
            for at in range(0, whole.num_rows, policy.ahead):
                batch = whole.slice(at, policy.ahead)
                titles, texts = (batch.column(c).to_pylist() for c in (1, 2))
                told = [answer for answer, _ in answers(client, [(t or "", x or "") for t, x in zip(titles, texts)], policy)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(told, pa.string())], names=[key, "base", "raw"])

    packed = base.select(F.col(key).alias("__key"), F.struct(*[c for c in base.columns if c != key]).alias("base"))
    rows = sections.select(key, "title", "text").join(packed, F.col(key).eqNullSafe(F.col("__key"))).select(key, "title", "text", "base")
    if partitions is not None:
        rows = rows.repartition(partitions, key)
    kinds = dict(rows.dtypes)
    told = rows.mapInArrow(ask, f"`{key}` {kinds[key]}, base {kinds['base']}, raw string")
    return told.select(key, merge_answer(F.col("raw"), F.col("base"), F.lit(name)).alias("e")).select(key, "e.*")
