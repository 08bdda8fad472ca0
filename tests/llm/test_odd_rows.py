"""Every operator and stage over nulls, empty and huge texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from termweave.llm import bestfit_packing, chunk_dedup, html_tagpath, language_hd, repetition, sentencepiece_codec, simhash_dedup, suffix_dedup, token_counts, url_reputation


def by_id(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def pages(df):
    return df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.concat(F.lit("https://a.example/"), F.col("page_id").cast("string")))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "url": lambda d: url_reputation.judge(pages(d), labels(d.sparkSession)),
    "simhash": simhash_dedup.near_groups,
    "repetition": repetition.repetition_coverage,
    "encode": sentencepiece_codec.encode_pieces,
    "decode": lambda d: sentencepiece_codec.decode_pieces(sentencepiece_codec.encode_pieces(d)),
    "suffix": suffix_dedup.repeated_spans,
    "exact": chunk_dedup.exact_copies,
    "packing": bestfit_packing.pack_documents,
    "tokens": token_counts.token_counts,
    "language": lambda d: language_hd.identify(d, language_hd.train(d)),
    "html": lambda d: html_tagpath.extract_content(pages(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(nothing, name):
    df = OPERATORS[name](nothing)
    assert df.count() == 0 and len(df.columns) > 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_over_empty_tables(spark, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = stage(spark, nothing, "")
    assert df.count() == 0
    assert name == "packing" or df.columns == nothing.columns


def test_url(odd):
    found = OPERATORS["url"](odd)
    rows = {r["page_id"]: r for r in found.collect()}
    assert found.count() == odd.count()
    assert rows[None]["host"] is None and rows[None]["keep"] is not None
    assert rows[1]["host"] == "a.example" and rows[1]["domain"] == "a.example" and rows[1]["suffix"] == "example"
    assert all(0 <= r["bad_rate"] <= r["bad_bound"] <= 1 for r in rows.values())


def test_url_without_labels(odd, spark):
    none = labels(spark).limit(0)
    rows = url_reputation.judge(pages(odd), none).collect()
    assert len(rows) == odd.count() and {r["bad_rate"] for r in rows} == {0.5} and {r["n_labels"] for r in rows} == {0}


def test_simhash(odd):
    rows = by_id(simhash_dedup.near_groups(odd))
    assert {i: r[0]["group_id"] for i, r in rows.items()} == {1: 1, 2: 1}
    assert [len(r) for r in rows.values()] == [1, 1] and rows[1][0]["group_size"] == 2


def test_simhash_stage(odd):
    kept = by_id(simhash_dedup.drop_near_copies(odd))
    assert 2 not in kept and len(kept[1]) == 1 and len(kept[None]) == 2 and {3, 4, 5, 6, 7} <= set(kept)


def test_repetition(odd):
    rows = by_id(repetition.repetition_coverage(odd))
    assert sum(map(len, rows.values())) == odd.count()
    for i in (3, 4, 5, 6):
        assert not rows[i][0]["keep"] and sum(rows[i][0][c] for c in repetition.COLUMNS) == 0 or i == 6
    assert rows[2][0] == rows[2][1] and rows[7][0]["n_words"] == 40_000
    assert rows[10][0]["n_words"] == 1 and rows[10][0]["keep"]
    stage = corpus_pipeline.quality_rules(odd.sparkSession, odd, "")
    assert stage.count() == sum(r["keep"] for rs in rows.values() for r in rs) and stage.columns == odd.columns


def test_pieces(odd):
    rows = by_id(sentencepiece_codec.encode_pieces(odd))
    assert rows[3][0]["ids"] is None and rows[3][0]["n_ids"] is None and rows[4][0]["ids"] == [] and rows[4][0]["n_ids"] == 0
    assert rows[2][0] == rows[2][1] and len(rows[None]) == 2


def test_suffix(odd):
    rows = by_id(suffix_dedup.repeated_spans(odd))
    assert set(rows) == {1, 2, 9}
    # Rows of one id are one document; the null id isn't compared.
    assert [(r["start_token"], r["end_token"], r["is_first"]) for r in rows[1]] == [(0, 80, True)]
    assert [(r["start_token"], r["end_token"], r["is_first"]) for r in rows[2]] == [(0, 80, False)]
    assert [(r["start_token"], r["end_token"], r["is_first"]) for r in rows[9]] == [(90, 155, False)]
    assert suffix_dedup.repeated_spans(odd.filter("doc_id IN (2, 3)")).count() == 0


def test_suffix_stage(odd):
    kept = by_id(suffix_dedup.drop_repeated_passages(odd))
    before = by_id(odd)
    assert set(kept) == set(before) - {2} and len(kept[None]) == 2
    assert kept[1] == before[1] and kept[7] == before[7] and kept[3][0]["text"] is None
    assert kept[9][0]["text"].split() == before[9][0]["text"].split()[:90] and kept[9][0]["n_chars"] == len(kept[9][0]["text"])


def test_exact(odd):
    rows = by_id(chunk_dedup.exact_copies(odd))
    assert {i: len(r) for i, r in rows.items()} == {1: 1, 2: 2, None: 1}
    assert {(r["keep_id"], r["copies"]) for rs in rows.values() for r in rs} == {(1, 4)}


def test_exact_stage(odd):
    kept = by_id(chunk_dedup.drop_exact_copies(odd))
    assert 2 not in kept and len(kept[1]) == 1
    assert [r["text"] for r in kept[None]] == [None] and {3, 4, 5, 6, 7, 8, 9, 10, 11} <= set(kept)
    twice = odd.filter("doc_id = 2")
    assert chunk_dedup.drop_exact_copies(twice).count() == 1
    nulls = odd.filter("doc_id IS NULL")
    assert chunk_dedup.drop_exact_copies(nulls.unionAll(nulls)).filter("text IS NULL").count() == 2


def test_packing(odd):
    rows = by_id(bestfit_packing.pack_documents(odd))
    assert not {3, 4, 5} & set(rows) and len(rows[2]) == 2 and len(rows[None]) == 1
    assert len(rows[7]) == -(-40_000 // bestfit_packing.CAPACITY) and sum(r["n_tokens"] for r in rows[7]) == 40_000


def test_tokens(odd):
    rows = by_id(token_counts.token_counts(odd))
    assert (rows[3][0]["n_tokens"], rows[3][0]["n_chunks"]) == (0, 0) and rows[4][0]["n_tokens"] == 0
    assert rows[2][0] == rows[2][1] and rows[10][0]["n_widened"] > 0 and rows[7][0]["n_chunks"] > 1


def test_language(odd):
    rows = by_id(OPERATORS["language"](odd))
    for i in (3, 4, 5, 6):
        assert rows[i][0]["lang_found"] == "und" and rows[i][0]["score"] is None
    assert rows[1][0]["lang_found"] in ("en", "de") and rows[2][0] == rows[2][1]
    none = language_hd.identify(odd, {})
    assert {r["lang_found"] for r in none.collect()} == {"und"}


def test_html(odd):
    rows: dict = {}
    for r in OPERATORS["html"](odd).collect():
        rows.setdefault(r["page_id"], []).append(r)
    assert rows[3][0]["content"] is None and rows[4][0]["content"] == "" and rows[5][0]["n_nodes"] == 0
    assert rows[2][0] == rows[2][1] and sum(map(len, rows.values())) == odd.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_documents_as_they_are(spark, odd, name):
    df = dict(corpus_pipeline.STAGES)[name](spark, odd, "")
    assert df.count() > 0
    if name != "packing":
        assert df.dtypes == odd.dtypes
