"""Encoders: anything that adds an embedding to texts, and a cache of what was encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


class Encoder(Protocol):
    """Adds ``embedding array<float>`` to a table with a text column."""

    name: str

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame: ...


class HashedGrams:
    """The built-in encoder: counts of character n-grams in hashed places, as unit vectors. All in the JVM."""

    def __init__(self, dim: int = 256, n: int = 3):
        self.dim, self.n, self.name = dim, n, f"grams{n}-{dim}"

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        from ..functions.similarity import grams

        places = F.transform(grams(F.coalesce(F.col(text), F.lit("")), self.n), lambda g: F.pmod(F.xxhash64(g), F.lit(self.dim)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter("_p", lambda p: p == i)).cast("double"))
        size = F.sqrt(F.aggregate("_v", F.lit(0.0).cast("double"), lambda s, x: s + x * x)) + 1e-12
        return df.withColumn("_p", places).withColumn("_v", counts).withColumn("embedding", F.transform("_v", lambda x: (x / size).cast("float"))).drop("_p", "_v")


class Precomputed:
    """Vectors from a table (key, embedding)."""

    def __init__(self, vectors: DataFrame, name: str = "precomputed"):
        self.vectors, self.name = vectors, name

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        known = self.vectors.select(F.col("key").alias("_key"), "embedding")
        return df.join(known, F.col(text) == F.col("_key"), "left").drop("_key")


class Model:
    """A user's model: a function that makes ``list[str] -> ndarray``, loaded once in each worker.

    load is called in the worker; pooling and normalising are the model's affair, so
    mean-pooled and first-token models are two encoders of different names.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], name: str, batch: int = 64, normalize: bool = True):
        self.load, self.name, self.batch, self.normalize = load, name, batch, normalize

    def encode(self, df: DataFrame, text: str = "text") -> DataFrame:
        load, batch, normalize = self.load, self.batch, self.normalize

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                out: list[np.ndarray] = []
                for i in range(0, len(s), batch):
                    v = np.asarray(model([x or "" for x in s.iloc[i : i + batch]]), np.float32)
                    out += list(v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) if normalize else v)
                yield pd.Series(out)

        run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def cache_key(model: str, normed):
    """``model::`` and 16 hex digits of the normalised text's SHA-256."""
    return F.concat(F.lit(f"{model}::"), F.substring(F.sha2(normed, 256), 1, 16))


def encode_cached(texts: DataFrame, cache: DataFrame | None, encoder: Encoder, source: str = "") -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, new cache rows): only distinct normalised texts that the cache lacks are encoded.

    texts: (text, …); cache: (key, text, normalized_text, model_name, source, embedding).
    The later text of one key names the cache row. A null text has no vector and isn't cached.
    """
    keyed = texts.withColumn("normalized_text", tx.normalize(F.col("text"))).withColumn("key", cache_key(encoder.name, F.col("normalized_text")))
    need = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.max("text").alias("text"), F.first("normalized_text").alias("normalized_text"))
    known = cache.filter(F.col("model_name") == encoder.name).select("key", "embedding") if cache is not None else None
    if known is not None:
        need = need.join(known.select("key"), "key", "left_anti")
    new = encoder.encode(need, "text").select("key", "text", "normalized_text", F.lit(encoder.name).alias("model_name"), F.lit(source).alias("source"), "embedding")
    all_ = new.select("key", "embedding") if known is None else known.unionByName(new.select("key", "embedding"))
    return keyed.join(all_, "key", "left").drop("key", "normalized_text"), new


def check_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors, of which any with another number of dimensions is an error when it is read."""
    size = F.size("embedding")
    return vectors.withColumn("embedding", F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(F.format_string("a vector has %d dimensions, not " + str(dim), size)).cast("array<float>")))
