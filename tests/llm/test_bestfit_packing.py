"""Packing against a plain search for the tightest bin."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import bestfit_packing, queries, token_counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 64))
def test_against_plain_search(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = bestfit_packing.pack(lengths, capacity)
    rooms: list[int] = []
    for n, b, off in zip(lengths, bins, offsets):
        tight = min((r for r in rooms if r >= n), default=None)
        if tight is None:
            rooms.append(capacity)
            assert b == len(rooms) - 1
        else:
            assert rooms[b] == tight
        assert off == capacity - rooms[b]
        rooms[b] -= n


def test_query(spark, small):
    """Every token is in one place, no bin overflows, and bins are nearly as few as can be."""
    rows = queries.op7_bestfit_packing(spark, small).collect()
    enc = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes(), token_counts.PATTERN)
    wanted = {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["bin_offset"], r["n_tokens"]))
        docs[r["doc_id"]].append((r["doc_start"], r["n_tokens"]))
    for parts in docs.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == {d: n for d, n in wanted.items() if n}
    for parts in bins.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= bestfit_packing.CAPACITY
    assert sorted(tuple(sorted(n for _, n in parts)) for parts in bins.values()) == brute(wanted.values(), bestfit_packing.CAPACITY)


def brute(lengths, capacity: int) -> list[tuple[int, ...]]:
    """What the bins hold after best fit decreasing over all pieces, one by one."""
    pieces = sorted((min(capacity, n - at) for n in lengths for at in range(0, n, capacity)), reverse=True)
    bins: list[list[int]] = []
    got: list[int] = []  # when each bin got the room it has
    for at, n in enumerate(pieces):
        fit = [(capacity - sum(b), -got[i], i) for i, b in enumerate(bins) if sum(b) + n <= capacity]
        i = min(fit)[2] if fit else len(bins)
        if not fit:
            bins.append([])
            got.append(at)
        bins[i].append(n)
        got[i] = at
    return sorted(tuple(sorted(b)) for b in bins)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_plan_is_what_packing_one_by_one_gives(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = bestfit_packing.pack(lengths, capacity)
    runs, opened = bestfit_packing.plan(Counter(lengths), capacity)
    found, seen = [], Counter()
    for n in lengths:
        rank, bin_, step, each, offset = [r for r in runs[n] if r[0] <= seen[n]][-1]
        k = seen[n] - rank
        found.append((bin_ + k // each * step, offset + k % each * n))
        seen[n] += 1
    assert found == list(zip(bins, offsets)) and opened == len(set(bins))


def test_the_plan_doesn_t_grow_with_the_documents():
    rng = random.Random(1)
    many = {n: rng.randrange(10**9) for n in range(1, 2048)}
    runs, opened = bestfit_packing.plan(many, 2048)
    assert sum(map(len, runs.values())) < 50_000 and opened >= sum(n * k for n, k in many.items()) / 2048


@pytest.mark.parametrize("partitions", (1, 5))
def test_given_lengths(spark, partitions):
    """Null ids, repeated rows and equal lengths over several partitions, against packing one by one."""
    docs = spark.range(1200).select(F.when(F.col("id") % 5 != 0, F.col("id") % 300).alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 10 != 0, F.col("id") % 23).alias("len"))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = bestfit_packing.pack_documents(docs, length=F.col("len"), capacity=9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["bin_offset"], r["n_tokens"]))
    for parts in bins.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert sorted(tuple(sorted(n for _, n in p)) for p in bins.values()) == brute([i % 23 for i in range(1200) if i % 10], 9)
    assert sorted(bins) == list(range(len(bins)))
    assert sum(r["doc_id"] is None for r in rows) == sum(-(-(i % 23) // 9) for i in range(1200) if i % 10 and i % 5 == 0)
