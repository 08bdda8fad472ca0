"""The pipeline over the smallest documents against a brute-force version of every stage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa

from termweave.llm import bestfit_packing, simhash_dedup, suffix_dedup, token_counts
from termweave.llm.common import written
from test_repetition import rejected
from test_suffix_dedup import brute_spans


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    df = written(stages["quality rules"](spark, docs, small))
    assert df.columns == docs.columns
    now = {i: t for i, t in now.items() if not rejected(t)}
    assert {r["doc_id"] for r in df.collect()} == set(now)

    df = written(stages["exact dedup"](spark, df, small))
    first: dict[str, int] = {}
    for i in sorted(now):
        first.setdefault(now[i], i)
    now = {i: t for t, i in first.items()}
    assert {r["doc_id"] for r in df.collect()} == set(now)

    df = written(stages["near dedup"](spark, df, small))
    ids = sorted(now)
    prints, size = simhash_dedup.fingerprints(pa.array([now[i] for i in ids]), simhash_dedup.BLOCKS * simhash_dedup.BLOCK_BITS)
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    root = {i: i for i in ids}
    for a, b in zip(*np.nonzero(np.triu(distance <= simhash_dedup.CLOSE, 1))):
        if size[a] and size[b]:
            low, high = sorted((root[ids[a]], root[ids[b]]))
            root = {k: low if v == high else v for k, v in root.items()}
    brute = {i for i in ids if root[i] == i}
    kept = {r["doc_id"] for r in df.collect()}
    assert brute <= kept, "no document goes that has no near copy"
    assert len(kept - brute) <= 0.1 * len(set(ids) - brute) + 1e-9
    now = {i: now[i] for i in kept}

    df = written(stages["passage dedup"](spark, df, small))
    wanted = {}
    later = defaultdict(list)
    for i, a, b, is_first in brute_spans(now):
        if not is_first:
            later[i].append((a, b))
    for i, text in now.items():
        spots = [m.span() for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", text.lower())]
        gone = {k for a, b in later[i] for k in range(a, b)}
        if gone and len(gone) == len(spots):
            continue
        wanted[i] = [text[s:e] for k, (s, e) in enumerate(spots) if k not in gone]
    found = {r["doc_id"]: r for r in df.collect()}
    assert set(found) == set(wanted) and df.columns == docs.columns
    for i, r in found.items():
        assert re.findall(r"[a-z0-9\x80-\U0010ffff]+", r["text"].lower()) == [w.lower() for w in wanted[i]]
        assert r["n_chars"] == len(r["text"]) or r["text"] == now[i]

    packed = stages["packing"](spark, df, small).collect()
    tokens = Counter()
    for p in packed:
        tokens[p["doc_id"]] += p["n_tokens"]
    enc = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes(), token_counts.PATTERN)
    assert tokens == {i: n for i, r in found.items() if (n := len(enc.encode_ordinary(r["text"])))}
    run = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed))
    assert run.columns == ["bin", "bin_offset", "doc_id", "piece", "doc_start", "n_tokens"]
    assert bestfit_packing.CAPACITY >= max(p["bin_offset"] + p["n_tokens"] for p in packed) and suffix_dedup.WINDOW == 50
