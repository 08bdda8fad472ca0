"""Stores that other tools made, read as tables: SQLite files, and vectors in a NumPy file beside a CSV of their texts."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import identifier

#: Rows that one task reads of a SQLite table or a file of vectors.
STEP = 100_000
KINDS = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}


def sqlite_table(spark: SparkSession, path: str, table: str, step: int = STEP) -> DataFrame:
    """A table of a SQLite file that every worker can read, a range of row numbers in each task."""
    name = identifier(table)
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        columns = con.execute(f'PRAGMA table_info("{name}")').fetchall()
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone() if columns else (None, None)
    if not columns:
        raise ValueError(f"{path} has no table {name}")
    names = [c[1] for c in columns]
    kinds = ", ".join(f"`{c[1]}` {KINDS.get(c[2].upper().split('(')[0], 'string')}" for c in columns)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first in part["id"].tolist():
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                    rows = con.execute(f'SELECT * FROM "{name}" WHERE rowid >= ? AND rowid < ?', (first, first + step))
                    while some := rows.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names, dtype=object)

    starts = spark.range(low or 0, (high if high is not None else -1) + 1, step)
    return starts.repartition(max(1, min(1000, ((high or 0) - (low or 0)) // step + 1))).mapInPandas(read, kinds)


def vector_store(spark: SparkSession, vectors: str, texts: str, step: int = STEP) -> DataFrame:
    """(text, normalized_text, model_name, source, embedding) of vectors (.npy) and their texts (.csv), row by row.

    Both files must be readable by every worker and have as many rows; vectors of another number is an error.
    """
    shape = np.load(vectors, mmap_mode="r").shape
    own = pd.read_csv(texts, dtype=str, keep_default_na=False)
    if len(own) != shape[0]:
        raise ValueError(f"{shape[0]} vectors but {len(own)} texts")
    columns = [c for c in ("text", "normalized_text", "model_name", "source") if c in own.columns]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first in part["id"].tolist():
                rows = pd.read_csv(texts, dtype=str, keep_default_na=False, skiprows=range(1, first + 1), nrows=step)[columns]
                body = np.load(vectors, mmap_mode="r")[first : first + len(rows)].astype(np.float32)
                yield rows.assign(embedding=list(body))

    starts = spark.range(0, shape[0], step)
    return starts.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns) + ", embedding array<float>")


def keyed(store: DataFrame) -> DataFrame:
    """Such a store as a cache of vectors: with its keys, each once."""
    from ..operators.encoders import cache_key

    key = F.concat(F.col("model_name"), F.substring(cache_key("", F.col("normalized_text")), 1, 18))
    return store.withColumn("key", key).dropDuplicates(["key"])


def newest(folder: str, pattern: str) -> str | None:
    """The last file of a folder by name, if there is any."""
    found = sorted(str(p) for p in Path(folder).glob(pattern))
    return found[-1] if found else None
