"""The corpus pipeline: language ID, line dedup, near-duplicate join, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``.  ``run`` applies them to ``documents``, writing each stage's result as Parquet
and reading it again, so a lost executor costs one stage at most.

Edge cases: every stage takes nulls in any column, repeated rows and an empty table (which gives an
empty result); further columns are carried through to packing, whatever their names but those that
begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foliomill.llm.jaccard_join import jaccard_components
from foliomill.llm.language_id import UNKNOWN, LanguageModel, held_out
from foliomill.llm.line_dedup import LONG_WORDS, dedup_lines
from foliomill.llm.mixing import mix
from foliomill.llm.packing import pack, tokenize
from foliomill.llm.scratch import cut

#: Keys of near-duplicates up to this number (8 MB) are broadcast, so that texts that stay are not shuffled.
FEW_KEYS = 1_000_000
#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: null texts, texts without a letter, and
    those whose language is less certain than ``LEAST_SCORE``.  Repeated rows are judged alike."""
    model = LanguageModel.fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    scored = model.predict(docs, lang_out="__lang", score_out="__score")
    return scored.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs and of long lines; a document that held nothing
    else goes.  Null and blank texts stay as they are, rows that share id and text share the outcome,
    and ``n_chars`` follows the text where something was deleted."""
    out = dedup_lines(docs, long_words=LONG_WORDS, lines_out="__lines_before", removed_out="__removed")
    out = out.filter((F.col("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _in_order(field: T.StructField) -> Column:
    """A column, as JSON text if it holds maps or variants, which have no order."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{field.name}`")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the least by id, then text fingerprint.

    Rows without id take no part and are kept.  A document is an id with a text (a 64-bit hash of
    both; where documents clash in it, which another hash tells, all of them stay): rows that share
    both count once, the least of their other columns (of columns that have no order, by their JSON
    text); of an id's several texts each is judged in its own group.
    """
    named = docs.filter("doc_id is not null").withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = jaccard_components(named, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    other = F.xxhash64(F.lit(1), "text", "doc_id")
    keys = named.groupBy("__key").agg(F.min("doc_id").alias("id"), F.min(F.xxhash64("text")).alias("print"), F.count(F.lit(1)).alias("n"), (F.min(other) < F.max(other)).alias("clash"))
    keys = keys.filter("not clash").drop("clash")
    judged = cut(groups.join(keys, "__key"), "near-judged")
    least = judged.groupBy("component_id").agg(F.min(F.struct("id", "print", "__key")).alias("least")).select(F.col("least.__key").alias("__least"), F.col("component_id").alias("__of"))
    judged = judged.join(least, F.col("component_id") == F.col("__of")).select("__key", "n", (F.col("__key") == F.col("__least")).alias("stays"))
    odd = cut(judged.filter("not stays or n > 1"), "near-odd")  # all other texts stay where they are
    few = odd.count() <= FEW_KEYS
    met = lambda some: F.broadcast(some) if few else some.hint("merge")
    out = named.join(met(odd.select("__key")), "__key", "left_anti").select(*docs.columns)
    several = odd.filter("stays")
    if not several.isEmpty():
        rows = named.join(met(several.select("__key")), "__key", "left_semi").groupBy("__key")
        order = F.struct(*[_in_order(f) for f in docs.schema])
        out = out.union(rows.agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*"))
    return out.union(docs.filter("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins out documents so that sources meet their target weights; rows without source
    are a source of their own, repeated rows are drawn together."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document (and of each repeat of it) lies in the packed sequences."""
    import public_tokenizers

    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return pack(tokenize(docs.select("doc_id", "source", "text"), *paths, keep_ids=False))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-duplicate join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the trained classifier and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
