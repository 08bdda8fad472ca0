"""Repeated passages against all windows compared one by one."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from word_docs import doc
from termweave.llm import queries, suffix_dedup

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def brute_spans(texts: dict[int, str | None], window: int = suffix_dedup.WINDOW) -> list[tuple[int, int, int, bool]]:
    places = defaultdict(list)
    for i in sorted(texts):
        w = WORD.findall((texts[i] or "").lower())
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].append((i, p))
    marks = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for n, (i, p) in enumerate(sorted(found)):
                marks[i, n == 0].add(p)
    out = []
    for (i, first), ps in marks.items():
        for p in sorted(ps):
            if p - 1 not in ps:
                end = p
                while end + 1 in ps:
                    end += 1
                out.append((i, p, end + window, first))
    return sorted(out)


def spans(spark, texts: dict[int, str | None], **more) -> list[tuple]:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in suffix_dedup.repeated_spans(df, **more).select("doc_id", "start_token", "end_token", "is_first").collect())


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = sorted(tuple(r) for r in queries.op5_suffix_dedup(spark, small).select("doc_id", "start_token", "end_token", "is_first").collect())
    wanted = brute_spans({r["doc_id"]: r["text"] for r in docs.collect()})
    assert found == wanted and wanted


@pytest.mark.parametrize("seed", range(4))
def test_small_windows(spark, seed):
    rng = random.Random(seed)
    texts = {i: doc(rng, rng.randrange(60), 4) for i in range(12)}
    for window, digit in ((4, 2), (6, 3), (5, 5)):
        assert spans(spark, texts, window=window, digit=digit) == brute_spans(texts, window)


def test_repetition_inside_a_document(spark):
    part = " ".join(f"w{i}" for i in range(55))
    texts = {1: f"{part} between {part}"}
    assert spans(spark, texts) == brute_spans(texts) == [(1, 0, 55, True), (1, 56, 111, False)]


def test_one_word_over_and_over(spark):
    texts = {1: "a " * 60, 2: "a " * 49}
    assert spans(spark, texts) == brute_spans(texts)


def test_cut_keeps_the_rest():
    texts = pa.array(["One, two; THREE four!", "é日本 x", "keep"])
    spots = pa.array([[{"start": 1, "end": 3}], [{"start": 0, "end": 2}], None], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    assert suffix_dedup.without(texts, spots) == ["One,  four!", None, "keep"]


def test_stretches_find_the_same_runs(monkeypatch):
    rng = random.Random(3)
    w = suffix_dedup.Words(pa.array([doc(rng, n, 4) for n in (400, 3, 90, 0, 57)]))
    for window, digit in ((50, 25), (6, 3), (5, 5)):
        monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 20)
        wanted = suffix_dedup.windows(w, window, digit)
        assert wanted[1].tolist() == [min(range(p, p + window - digit + 1), key=lambda i: (int(wanted[2][i]) >> 24, i)) for p in wanted[0].tolist()]
        for stretch in (1, 7, 64):
            monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
            assert [x.tolist() for x in suffix_dedup.windows(w, window, digit)] == [x.tolist() for x in wanted]


def test_more_words_than_24_bits_count():
    """The end of a very long document has the runs that it has alone."""
    n, tail = (1 << 24) + 500, 300
    words = np.random.default_rng(1).integers(0, 1 << 63, n, dtype=np.uint64)
    of = lambda h: suffix_dedup.windows(SimpleNamespace(hash=h, left=lambda: np.arange(len(h), 0, -1)), 50, 25)
    at, least, _ = of(words)
    end, alone, _ = of(words[-tail:])
    assert len(at) == n - 49
    assert (at[-len(end) :] - end == n - tail).all() and (least[-len(end) :] - alone == n - tail).all()


@pytest.mark.parametrize("hot", (0, 3))
def test_hot_digits_give_the_same(spark, hot):
    rng = random.Random(9)
    texts = {i: doc(rng, rng.randrange(60), 4) for i in range(15)} | {20: None, 21: ""}
    texts |= {30 + i: texts[3] for i in range(4)} | {40 + i: f"{texts[3]} {texts[5]}" for i in range(3)}
    assert spans(spark, texts, window=6, digit=3, hot=hot) == brute_spans(texts, 6)


def test_a_passage_of_very_many_documents(spark):
    """One line in 100,000 documents: each keeps its own words, the least id the line."""
    line = " ".join(f"license{i}" for i in range(55))
    df = spark.range(100_000).selectExpr("id AS doc_id", f"concat('own', id, ' {line} end', id) AS text")
    found = suffix_dedup.repeated_spans(df, hot=1000)
    got = found.groupBy("start_token", "end_token", "is_first").agg({"doc_id": "min", "*": "count"}).collect()
    assert sorted((r["start_token"], r["end_token"], r["is_first"], r["min(doc_id)"], r["count(1)"]) for r in got) == [(1, 56, False, 1, 99_999), (1, 56, True, 0, 1)]
