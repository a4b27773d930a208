"""Vectors: normalising, building with a pluggable embedder, brute-force cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that go to an embedder at once, and hits of a search.
BATCH, TOP = 64, 40

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def hashing_embedder(dim: int = 64) -> Embedder:
    """A model-free stand-in: signed hashed counts of words. For tests and for use where no model is at hand."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        return out.tolist()

    return embed


def missing(items: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Items (kind, item, text) without a vector of this model."""
    return items.join(vectors.where(F.col("model") == model).select("kind", "item"), ["kind", "item"], "left_anti")


def build(items: DataFrame, vectors: DataFrame, model: str, embed: Embedder) -> DataFrame:
    """Vectors (kind, item, model, dim, vec) of the missing items, normalised; append them. Blank texts get none."""
    todo = missing(items, vectors, model).where("text is not null and trim(text) <> ''").select("kind", "item", "text")
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a : a + BATCH]
                v = np.asarray(embed(part["text"].tolist()), dtype="float64")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=v, where=n > 0)
                yield pd.DataFrame({"kind": part["kind"].to_numpy(), "item": part["item"].to_numpy(), "model": model, "dim": v.shape[1], "vec": list(v.astype("float32"))})

    return todo.mapInPandas(run, f"kind string, item {kind}, model string, dim int, vec array<float>")


def search(vectors: DataFrame, query: Sequence[float], k: int = TOP, id_col: str = "item", vec_col: str = "vec") -> DataFrame:
    """The k rows most like a query vector by cosine, with the cosine: a literal in the plan, JVM expressions, top-k per task. Zero and null vectors have cosine 0."""
    q = np.asarray(query, dtype="float64")
    n = float(np.linalg.norm(q))
    lit = F.array(*[F.lit(float(x)) for x in (q / n if n else q)])
    v = F.col(vec_col)
    cos = dot(v, lit) / F.nullif(norm(v), F.lit(0.0))
    return vectors.withColumn("cosine", F.coalesce(cos, F.lit(0.0))).orderBy(F.desc("cosine"), id_col).limit(k)
