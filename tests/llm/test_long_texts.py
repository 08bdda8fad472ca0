"""Texts that cross every block (512 KiB) and Arrow batch (4 MB) that the operators work in."""

from __future__ import annotations

from pathlib import Path

import pytest

from conftest import prose
from termweave.llm import bestfit_packing, chunk_dedup, html_tagpath, language_hd, repetition, sentencepiece_codec, simhash_dedup, suffix_dedup, token_counts
from termweave.llm.common import BLOCK_BYTES

PASSAGE = " ".join(f"shared{i}" for i in range(70))


@pytest.fixture(scope="module")
def texts() -> dict[int, str]:
    long, longer = prose(21, 110_000), prose(22, 720_000).replace(" ", "x ")  # no word of the one is in the other
    out = {1: long, 2: f"{longer} {PASSAGE} end", 3: long + " changed", 4: long, 5: f"short {PASSAGE} text"}
    assert len(out[1]) > BLOCK_BYTES and len(out[2]) > 4 << 20
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").repartition(2).cache()


def rows(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


def test_long_repetition(docs, texts):
    found = rows(repetition.repetition_coverage(docs))
    assert {i: r["n_words"] for i, r in found.items()} == {i: len(t.split()) for i, t in texts.items()}


def test_long_simhash(docs):
    assert {i: r["group_id"] for i, r in rows(simhash_dedup.near_groups(docs)).items()} == {1: 1, 3: 1, 4: 1}


def test_long_exact(docs):
    assert {i: (r["keep_id"], r["copies"]) for i, r in rows(chunk_dedup.exact_copies(docs)).items()} == {1: (1, 2), 4: (1, 2)}


def test_long_suffix(docs, texts):
    n = len(texts[1].split())
    at = len(texts[2].split()) - 71
    found = sorted(tuple(r) for r in suffix_dedup.repeated_spans(docs).collect())
    assert found == [(1, 0, n, True), (2, at, at + 70, True), (3, 0, n, False), (4, 0, n, False), (5, 1, 71, False)]


def test_long_pieces(docs, texts):
    found = rows(sentencepiece_codec.encode_pieces(docs))
    assert all(r["round_trip"] and r["n_ids"] >= len(texts[i].split()) for i, r in found.items())


def test_long_tokens(docs, texts):
    enc = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes(), token_counts.PATTERN)
    wanted = {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    found = rows(token_counts.token_counts(docs))
    assert {i: r["n_tokens"] for i, r in found.items()} == wanted and found[2]["n_chunks"] > 50
    packed = bestfit_packing.pack_documents(docs, length=token_counts.tokens(docs["text"])).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == wanted


def test_long_language(docs):
    found = rows(language_hd.identify(docs, language_hd.train(docs)))
    assert {r["lang_found"] for r in found.values()} == {"en"} and all(r["score"] > 0 for r in found.values())


def test_long_pages(spark, texts):
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{texts[1][i : i + 2000]}, and so on.</p>" for i in range(0, len(texts[1]), 2000)) + "</article></body>"
    found = html_tagpath.extract_content(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert found["content"].count("and so on.") == page.count("and so on.") and "menu" not in found["content"]
