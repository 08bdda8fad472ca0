"""Repetition coverage against a plain version."""

from __future__ import annotations

import re
from collections import Counter

import holding
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import queries, repetition

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def plain(text: str | None) -> dict[str, int]:
    low = (text or "").lower()
    words = WORD.findall(low)
    out = {"n_words": len(words), "n_chars": sum(map(len, words))}
    for n in range(2, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        if n in repetition.TOP:
            out[f"top_chars_{n}"] = max((c * sum(map(len, g)) for g, c in count.items() if c > 1), default=0)
        if n in repetition.DUP:
            inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
            out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside)
    lines = [tuple(WORD.findall(x)) for x in low.split("\n")]
    lines = [x for x in lines if x]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    return out | {"n_lines": len(lines), "dup_lines": len(again), "dup_line_chars": sum(len(w) for x in again for w in x)}


def rejected(text: str | None) -> bool:
    m = plain(text)
    c = m["n_chars"]
    over = any(m[f"top_chars_{n}"] * 100 > p * c for n, p in repetition.TOP.items()) or any(m[f"dup_chars_{n}"] * 100 > p * c for n, p in repetition.DUP.items())
    return not m["n_words"] or over or m["dup_line_chars"] * 100 > repetition.LINE_CHARS * c or m["dup_lines"] * 100 > repetition.LINES * m["n_lines"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日.\n ", max_size=80), st.lists(st.sampled_from(["a", "b", "c\n", "dd"]), max_size=60).map(" ".join)), max_size=5))
def test_measures_against_plain_version(texts):
    got = repetition.measure(pa.array([t or "" for t in texts], pa.string()))
    decided = repetition.decide(got)
    for i, t in enumerate(texts):
        assert {c: int(got[c][i]) for c in repetition.COLUMNS} == plain(t)
        assert bool(decided[i]) is not rejected(t)


def test_query_agrees_with_sql(spark, duck, small):
    df = queries.op3_repetition(spark, small)
    names, wanted = holding.of_sql(duck, repetition.SQL)
    assert sorted(df.columns) == names and holding.of(df) == wanted


def test_clean_prose_stays(spark, small):
    share = queries.op3_repetition(spark, small).filter("n_words >= 50").selectExpr("avg(int(keep))").first()[0]
    assert share > 0.5


@pytest.mark.parametrize(("text", "kept"), [("one two three four five six seven eight nine ten", True), ("spam spam eggs " * 20, False), ("same line here\n" * 5, False), ("", False), (None, False)])
def test_decisions(text, kept):
    assert bool(repetition.decide(repetition.measure(pa.array([text or ""])))[0]) is kept
