"""Exact copies against texts compared whole, also where chunk hashes collide."""

from __future__ import annotations

import random

import holding
import numpy as np
import pyarrow as pa
import pytest

from conftest import prose
from termweave.llm import chunk_dedup, queries
from termweave.llm.common import utf8


def test_query_agrees_with_sql(spark, duck, small):
    df = queries.op6_exact_dedup(spark, small)
    names, wanted = holding.of_sql(duck, chunk_dedup.SQL)
    assert sorted(df.columns) == names and holding.of(df) == wanted and wanted


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_colliding_hashes_are_told_apart(spark, bits):
    rng = random.Random(bits)
    texts = [prose(rng.randrange(12), rng.choice((3, 300, 900))) for _ in range(60)] + ["", "", None, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["keep_id"], r["copies"]) for r in chunk_dedup.exact_copies(df, hash_bits=bits).collect())
    wanted = [(i, texts.index(t), texts.count(t)) for i, t in rows if t is not None and texts.count(t) > 1]
    assert got == wanted
    kept = sorted(r["doc_id"] for r in chunk_dedup.drop_exact_copies(df, hash_bits=bits).collect())
    assert kept == [i for i, t in rows if t is None or texts.index(t) == i]


def test_cuts_depend_on_the_text_alone():
    texts = [prose(i, n) for i, n in enumerate((2000, 1, 60, 5000))]
    data, off = utf8(pa.array(texts))
    counts, ends = chunk_dedup.cuts(data, off)
    ends = np.split(ends, np.cumsum(counts)[:-1])
    for t, e, at in zip(texts, ends, off):
        alone = chunk_dedup.cuts(*utf8(pa.array([t])))[1]
        assert len(alone) == len(e)
        sizes = np.diff([0, *alone])
        assert sizes.sum() == len(t.encode()) and sizes.max() <= chunk_dedup.MAX_CHUNK and (sizes[:-1] >= chunk_dedup.MIN_CHUNK).all()
    # A changed beginning leaves the later cuts where they were.
    moved = chunk_dedup.cuts(*utf8(pa.array(["changed " + texts[3]])))[1] - 8
    assert len(set(moved.tolist()) & set(chunk_dedup.cuts(*utf8(pa.array([texts[3]])))[1].tolist())) > 5
