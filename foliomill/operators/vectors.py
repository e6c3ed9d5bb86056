"""Chunks, embeddings and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import chunks


def section_chunks(sections: DataFrame, key: str = "section_ord", text: str = "text", limit: int = 1200) -> DataFrame:
    """``key, pos, chunk, snippet``."""
    out = sections.select(key, F.posexplode(chunks(F.col(text), limit)).alias("pos", "chunk"))
    return out.withColumn("snippet", F.replace(F.substring("chunk", 1, 160), F.lit("\n"), F.lit(" ")))


def embed(rows: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "chunk", batch: int = 64) -> DataFrame:
    """Rows with ``vec``: unit vectors of 32-bit floats, rounded to five places.  The model is made
    once per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            parts = [np.asarray(model(list(frame[text][a : a + batch])), np.float32) for a in range(0, len(frame), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield frame.assign(vec=list(np.round(v, 5).astype(np.float32)))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, vec array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k vectors closest in angle to one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vec)
    score = F.round(F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))), 5)
    return vectors.select(key, score.alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(k)
