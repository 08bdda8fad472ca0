"""Counts of spliced chunks against whole texts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from conftest import prose
from termweave.llm import queries, token_counts

ENC = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes(), token_counts.PATTERN)


@pytest.mark.parametrize("seed", range(40))
def test_splices_against_whole_texts(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab ", "a\n\n  b", "日本語 x", "xyz", "   \n", "it's don't 12 34\n", "é 🎉 ▁"])
    text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))
    chunk = rng.choice((8, 32, 100))
    overlap = rng.choice((2, 6, chunk // 2))
    n, chunks, widened = token_counts.count(ENC, text, chunk, overlap)
    assert n == len(ENC.encode_ordinary(text))
    assert chunks >= 1 or not text


def test_many_chunks_and_widening():
    text = prose(4, 20_000)
    n, chunks, widened = token_counts.count(ENC, text, 5000, 200)
    assert n == len(ENC.encode_ordinary(text)) and chunks > 20 and widened == 0
    block = "x" * 3000 + " y " + "z" * 3000
    n, chunks, widened = token_counts.count(ENC, block, 1000, 50)
    assert n == len(ENC.encode_ordinary(block)) and widened > 0


def test_query_against_whole_texts(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op8_token_counts(spark, small).collect()}
    assert found == {i: len(ENC.encode_ordinary(t)) for i, t in texts.items()}
