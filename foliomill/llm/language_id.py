"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Code points of the lower-cased text form 1- to 3-grams, hashed to ``DIM`` features.  A document's
value for a feature is its share of the document's n-grams times the feature's inverse document
frequency, counted over every training document.  Weights come from follow-the-regularised-leader
(proximal, per coordinate) with L1 and L2 penalties over a bounded sample of labelled rows, of the most
frequent ``most_languages`` values of the label; a
temperature fitted on a fifth of that sample, kept out of training, calibrates the probabilities.

Because values are linear in the counts, a text is scored by one pass that adds up its n-grams'
weights; texts are taken in slices, so memory does not depend on their length.

Edge cases: a null text, or one without any letter (a code point of category L), is ``und`` with score 0; NUL characters take
part in no n-gram; without training rows every text is ``und``; repeated rows count as often as
they come; an empty table gives an empty result; other columns are carried along, and columns named
like the two added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .scratch import cut
from .words import give_back

DIM = 1 << 16
ORDERS = (1, 2, 3)
SLICE = 1 << 19
UNKNOWN = "und"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the n-grams that start at each code point, and which hold no NUL."""
    size = max(0, len(c) - n + 1)
    h, ok = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)), np.ones(size, bool)
    for k in range(n):
        part = c[k : k + size]
        h = h * np.uint32(0x01000193) + part
        ok &= part != 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h & np.uint32(DIM - 1), ok


def slices(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of a text in slices; the first ``lead`` of each belong to the slice before."""
    for at in range(0, len(text), SLICE):
        lead = min(at, ORDERS[-1] - 1)
        yield codes(text[at - lead : at + SLICE]), lead


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    total = np.zeros(DIM, np.int64)
    for c, lead in slices(text):
        for n in ORDERS:
            f, ok = grams(c, n)
            first = max(0, lead - n + 1)
            total += np.bincount(f[first:][ok[first:]], minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """For each feature the number of texts that hold it, and the number of texts.

    Each partition sends at most ``DIM`` counts, which are summed by feature in Spark; the driver
    gets ``DIM`` numbers at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, here = np.zeros(DIM, np.int64), 0, np.zeros(DIM, bool)
        for batch in batches:
            for value in batch.column(0):
                rows += 1
                for c, lead in slices(value.as_py() or ""):
                    for n in ORDERS:
                        f, ok = grams(c, n)
                        here[f[ok]] = True
                df += here
                here[:] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([rows, *df[at]], pa.int64())], names=["f", "n"])

    found = texts.select(text_col).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM, np.int64)
    for f, n in found:
        if f >= 0:
            df[f] = n
    return df, next((n for f, n in found if f < 0), 0)


def sample_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int, most_languages: int, most_rows: int) -> list:
    """At most ``rows_per_language`` labelled rows of each of the ``most_languages`` most frequent
    languages (ties by name), fewer where that would be over ``most_rows`` in all; least hash of id first.

    Rows are thinned where they are read, by a hash and the counts of the languages, so that a frequent
    language does not gather in a task.  Returns (language, features, counts).
    """
    unit = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(float(1 << 53))
    rows = labelled.select(id_col, lang_col, unit.alias("__unit"))
    sizes = rows.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__size"))
    sizes = cut(sizes.orderBy(F.desc("__size"), "__lang").limit(most_languages), "languages")  # a known size
    rows_per_language = max(1, min(rows_per_language, most_rows // max(1, sizes.count())))
    # Four times as many as are wanted, by hash, so that few of a frequent language are shuffled.
    likely = rows.join(sizes, F.col(lang_col) == F.col("__lang")).filter(F.col("__unit") * F.col("__size") < 4 * rows_per_language)
    order = Window.partitionBy(lang_col).orderBy("__unit", id_col)
    chosen = (
        likely.withColumn("__nth", F.row_number().over(order))
        .filter(F.col("__nth") <= rows_per_language).select(F.col(id_col).alias("__id")).distinct()
    )
    texts = labelled.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang, text in zip(*(batch.column(k) for k in range(3))):
                at, n = counted(text.as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()], pa.int64()), pa.array([lang.as_py()]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<u4").tobytes()], pa.binary())],
                    names=["i", "lang", "f", "n"],
                )

    kept = texts.select(F.col(id_col).cast("long"), lang_col, text_col)
    found = kept.mapInArrow(featurise, "i long, lang string, f binary, n binary").collect()
    found = sorted(found, key=lambda r: (hash_order(r["i"]), r["lang"], r["f"], r["n"]))
    return [(r["lang"], np.frombuffer(r["f"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(float)) for r in found]


def hash_order(i: int | None) -> int:
    """A fixed shuffle of ids."""
    x = ((i or 0) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1


@dataclass
class LanguageModel:
    """Weights per feature and language (already times idf), a bias, and a temperature."""

    languages: list[str]
    weights: np.ndarray  # DIM x languages, float32
    bias: np.ndarray
    temperature: float = 1.0

    @classmethod
    def fit(
        cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = 1000, most_languages: int = 200, most_rows: int = 20_000, epochs: int = 3, alpha: float = 1.0, beta: float = 0.01,
        l1: float = 1e-3, l2: float = 1e-3,
    ) -> LanguageModel:
        """Learns from ``docs``; document frequencies count all of them, weights come from at most
        ``rows_per_language`` rows of each language, ``most_languages`` languages and ``most_rows`` rows:
        the model has ``DIM`` weights a language, the driver holds the sample."""
        df, n = document_frequencies(docs, text_col)
        idf = np.log((1 + n) / (1 + df)) + 1
        rows = sample_rows(docs.filter(F.col(lang_col).isNotNull()), id_col, text_col, lang_col, rows_per_language, most_languages, most_rows)
        languages = sorted({r[0] for r in rows})
        examples = [(languages.index(lang), f, idf[f] * k / k.sum()) for lang, f, k in rows if len(f)]
        check, train = examples[::5], [x for k, x in enumerate(examples) if k % 5]
        z = np.zeros((DIM + 1, max(1, len(languages))))
        g2 = np.zeros_like(z)

        def solved(at):
            zs = z[at]
            return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(g2[at])) / alpha + l2)

        for _ in range(epochs):
            for y, f, x in train:
                at, v = np.append(f, DIM), np.append(x, 1.0)
                w = solved(at)
                p = v @ w
                p = np.exp(p - p.max())
                p /= p.sum()
                p[y] -= 1
                g = v[:, None] * p
                more = g * g
                z[at] += g - (np.sqrt(g2[at] + more) - np.sqrt(g2[at])) / alpha * w
                g2[at] += more
        w = solved(np.arange(DIM + 1))
        model = cls(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1].astype(np.float32))
        if check and len(languages) > 1:
            logits = np.array([x @ w[f] + w[-1] for _, f, x in check])
            right = np.array([y for y, _, _ in check])
            grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
            doubt = 1 / (len(check) + 2)  # as if one more had been wrong; else no error means no limit
            aim = np.full(logits.shape, doubt / (len(languages) - 1))
            aim[np.arange(len(right)), right] = 1 - doubt

            def loss(t):
                s = logits / t
                s = s - s.max(1, keepdims=True)
                return (np.log(np.exp(s).sum(1)) - (s * aim).sum(1)).mean()

            model.temperature = float(min(grid, key=loss))
        return model

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        width = len(self.languages)
        total, n_grams = np.zeros((len(texts), max(1, width))), np.zeros(len(texts))
        table = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        room = max(1 << 12, (1 << 21) // max(1, width))
        held, rows, size = [], [], 0

        def flush():
            gap = np.zeros(ORDERS[-1], np.uint32)
            c = np.concatenate([x for part, _ in held for x in (part, gap)])
            starts = np.cumsum([0, *(len(part) + len(gap) for part, _ in held)])[:-1]
            leads = np.array([lead for _, lead in held])
            for n in ORDERS:
                f, ok = grams(c, n)
                for s, lead in zip(starts[leads > 0], leads[leads > 0]):
                    ok[s : s + max(0, lead - n + 1)] = False
                f = np.where(ok, f, DIM)
                np.add.at(n_grams, rows, np.add.reduceat(ok.astype(np.int64), starts))
                for k in range(width):
                    np.add.at(total[:, k], rows, np.add.reduceat(table[:, k][f], starts, dtype=np.float64))

        for row, text in enumerate(texts):
            if text and width and any(map(str.isalpha, text)):
                for part in slices(text):
                    held.append(part)
                    rows.append(row)
                    size += len(part[0])
                    if size > room:
                        flush()
                        held, rows, size = [], [], 0
        if held:
            flush()
        logits = (total / np.maximum(n_grams, 1)[:, None] + (self.bias if width else 0)) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = n_grams > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p.max(1), 0.0)

    def predict(self, docs: DataFrame, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
        """``docs`` with the predicted language and its probability."""
        kept = docs.drop(*[c for c in (lang_out, score_out) if c != text_col])
        schema = T.StructType([*kept.schema, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
        model = docs.sparkSession.sparkContext.broadcast(self)  # DIM x languages numbers

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    lang, p = model.value.scores(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(p)], names=[f.name for f in schema])
            give_back()

        return kept.mapInArrow(score, schema)
