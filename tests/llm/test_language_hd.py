"""Hyperdimensional profiles against vectors built one n-gram at a time, and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from termweave.llm import language_hd, queries


def plain_bundle(text: str) -> np.ndarray:
    s = language_hd.space(language_hd.DIMENSIONS, language_hd.SEED)
    symbols = [0]
    for c in text.lower():
        x = int(language_hd._fold()[ord(c)]) if ord(c) < 1 << 16 else 27 + 64 + ord(c) % 37
        if x or symbols[-1]:
            symbols.append(x)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(language_hd.DIMENSIONS)
    letters = s.places[2]
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if a or b or c:
            total += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    return total


def test_bundles_against_plain_version():
    texts = ["The cat.", "", "...", "Ünïcode 日本 🎉", "a", "x  y\n\nz"]
    got = language_hd.space(language_hd.DIMENSIONS, language_hd.SEED).bundle(pa.array(texts))
    for g, t in zip(got, texts):
        assert np.array_equal(g, plain_bundle(t)), t


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    prototypes = language_hd.train(docs.filter(part))
    found = language_hd.identify(docs.filter(~part), prototypes).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    share = found.filter("n_chars >= 40").agg(F.avg((F.col("lang") == F.col("lang_found")).cast("int"))).first()[0]
    assert share >= 0.95


def test_query_covers_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = queries.op9_language_id(spark, small)
    assert found.count() == docs.count()
    assert {r[0] for r in found.select("lang_found").distinct().collect()} - {"und"} <= {r[0] for r in docs.select("lang").distinct().collect()}


def test_training_ignores_the_order_of_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = language_hd.train(docs), language_hd.train(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert list(a) == list(b) and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_ties_go_to_the_first_name(spark):
    v = language_hd._unit(np.ones((1, language_hd.DIMENSIONS)))[0]
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert language_hd.identify(docs, {"aa": v, "bb": v}).first()["lang_found"] == "aa"
