"""Near-duplicate groups against all pairs of fingerprints."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from conftest import prose
from termweave.llm import queries, simhash_dedup
from termweave.llm.components import components

BITS = simhash_dedup.BLOCKS * simhash_dedup.BLOCK_BITS


def plain_print(text: str) -> np.ndarray:
    """The majority of the words' bits, one bit at a time."""
    from termweave.llm.common import Words, mix

    hashes = sorted(set(Words(pa.array([text])).hash.tolist()))
    seeds = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.array([np.unpackbits(mix(np.uint64(h) ^ seeds).view(np.uint8)) for h in hashes], int)
    return (2 * bits.sum(axis=0) > len(hashes)).astype(np.uint8)


def brute_groups(texts: dict[int, str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    ids = sorted(texts)
    prints, size = simhash_dedup.fingerprints(pa.array([texts[i] for i in ids]), BITS)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= simhash_dedup.CLOSE
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1))) if size[a] and size[b]]
    root = {i: i for i in ids}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = {k: low if v == high else v for k, v in root.items()}
    return root, pairs


def test_fingerprints_against_plain_version():
    texts = [prose(1, 30), "one", "a b", prose(2, 500)]
    got, size = simhash_dedup.fingerprints(pa.array(texts), BITS)
    for p, t in zip(got, texts):
        assert np.array_equal(np.unpackbits(p), plain_print(t))
    assert size[1] == 1


def test_recall_over_all_pairs(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    root, pairs = brute_groups(texts)
    found = {r["doc_id"]: r["group_id"] for r in queries.op2_simhash_dedup(spark, big).collect()}
    hit = sum(a in found and found[a] == found.get(b) for a, b in pairs)
    assert len(pairs) > 50 and hit >= 0.9 * len(pairs)
    assert all(root[i] == root[g] for i, g in found.items()), "every group is within one of brute force"


def test_edited_copies_are_found_and_others_left_alone(spark):
    rng, rows, family = random.Random(5), [], {}
    for i in range(120):
        words = prose(i, 150).split()
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for _ in range(4):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((i * 10 + j, " ".join(copy)))
    found = {r["doc_id"]: r["group_id"] for r in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    family = defaultdict(set)
    for d, g in found.items():
        family[g].add(d // 10)
    assert all(len(f) == 1 for f in family.values())
    assert sum(found.get(d) == d // 10 * 10 for d, _ in rows) >= 0.95 * len(rows)


def test_thousands_of_copies(spark):
    """A hot block costs no more than a spanning forest."""
    base = prose(3, 200).split()
    rows = [(i, " ".join(base[:-1] + [f"tail{i}"])) for i in range(3000)]
    groups = simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert groups.selectExpr("count(*)", "max(group_id)", "min(group_size)").first()[:] == (3000, 0, 3000)


def test_pairs_below_the_number_of_blocks_always_share_one():
    """The pigeonhole: fewer differing bits than blocks."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, (200, BITS), dtype=np.uint8)
    b = a.copy()
    for r in b:
        r[rng.choice(BITS, simhash_dedup.BLOCKS - 1, replace=False)] ^= 1
    x, y = (simhash_dedup.block_values(np.packbits(m, axis=1), simhash_dedup.BLOCKS, simhash_dedup.BLOCK_BITS) for m in (a, b))
    assert (x == y).any(axis=1).all()


def test_ties_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (60, 4), dtype=np.uint8)
    prints[20:30] = prints[5] ^ np.array([1, 0, 0, 0], np.uint8)
    key = np.sort(rng.integers(0, 6, 60))
    label = simhash_dedup.ties(key, prints, 10)
    near = (np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= 10) & (key[:, None] == key[None])
    reach = near.copy()
    for _ in range(60):
        reach = (reach.astype(int) @ near.astype(int)) > 0
    assert np.array_equal(label, reach.argmax(axis=1))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (103, 102), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n for n, r in found.items() if r == 0} == set(range(51)) and found[101] == 100 and found[103] == 102
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys_are_dealt_to_parts(spark):
    """More near copies than a task holds: every two parts meet; one outsider among them is left alone."""
    base = prose(3, 200).split()
    rows = [(i, " ".join(base[:-1] + [f"tail{i}"])) for i in range(900)] + [(5000, prose(77, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = simhash_dedup.near_groups(docs, hot=150).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[:] for r in found) == [(i, 0, 900) for i in range(900)]


def test_keys_are_cut_whole():
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(300, 17)]))
    cut = [0, 3, 3, 90, 200, 260, 261, 400, 500]
    batches = [pa.RecordBatch.from_pydict({"key": key[a:b], "at": np.arange(a, b)}) for a, b in zip(cut, cut[1:])]
    whole = list(simhash_dedup._whole_keys(iter(batches)))
    assert [x for t, _, _ in whole for x in t.column("at").to_pylist()] == list(range(500))
    ends = [t.column("key")[-1].as_py() for t, _, _ in whole]
    assert len(set(ends)) == len(ends) and not any(hot for *_, hot in whole)
    parts = list(simhash_dedup._whole_keys(iter(batches), 100))
    assert [x for t, _, _ in parts for x in t.column("at").to_pylist()] == list(range(500))
    hot = [(part, set(t.column("key").to_pylist())) for t, part, h in parts if h]
    assert len(hot) > 1 and [p for p, _ in hot] == list(range(len(hot))) and all(k == {17} for _, k in hot)


def test_partners_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 1 << 63, (80, 2), dtype=np.uint64)
    sketch[30:40] = sketch[4] ^ np.uint64(3)
    key = np.sort(rng.integers(0, 5, 80))
    near = (np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(axis=2, dtype=int) <= 50) & (key[:, None] == key[None]) & ~np.eye(80, dtype=bool)
    assert np.array_equal(simhash_dedup.partnered(key, sketch, 50), near.any(axis=1))


def test_blocks_grow_with_the_logarithm_of_the_documents():
    assert simhash_dedup.layout(1) == simhash_dedup.layout(1 << 24) == (simhash_dedup.BLOCKS, simhash_dedup.BLOCK_BITS)
    for nodes in (1 << 25, 1 << 30, 50_000_000_000):
        blocks, width = simhash_dedup.layout(nodes)
        assert nodes / 2**width <= 16
        share = 1 - simhash_dedup.CLOSE / BITS
        chance = [1 - (1 - share**w) ** b for b, w in ((simhash_dedup.BLOCKS, simhash_dedup.BLOCK_BITS), (blocks, width))]
        assert chance[1] >= chance[0] - 0.01
        own = simhash_dedup.block_bits_of(BITS, blocks, width)
        assert own.shape == (blocks, width) and all(len(set(r)) == width for r in own.tolist())


def test_sketches_of_close_pairs_are_near():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2, (20_000, BITS), dtype=np.uint8)
    b = a.copy()
    for r in b:
        r[rng.choice(BITS, simhash_dedup.CLOSE, replace=False)] ^= 1
    x, y = (simhash_dedup.sketches(np.packbits(m, axis=1)) for m in (a, b))
    far = np.bitwise_count(x ^ y).sum(axis=1, dtype=int)
    assert far.max() <= simhash_dedup.sketch_close(BITS, simhash_dedup.CLOSE)
    assert (np.bitwise_count(x ^ x[::-1]).sum(axis=1, dtype=int) > simhash_dedup.sketch_close(BITS, simhash_dedup.CLOSE)).mean() > 0.99


def exact_ties(prints: np.ndarray, close: int, far: np.ndarray | None = None) -> list[int]:
    """The least row of each group of close pairs, pair by pair."""
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= close
    if far is not None:
        near &= far[:, None] != far[None]
    root = list(range(len(prints)))
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def test_groups_are_those_of_all_pairs(spark):
    """Pairs of short texts up to the very threshold; no block of theirs need be equal."""
    rng, texts = random.Random(11), {}
    for i in range(400):
        words = prose(i, 24).split()
        texts[2 * i] = " ".join(words)
        words[rng.randrange(24)] = f"new{i}"
        if i % 2:
            words[rng.randrange(24)] = f"more{i}"
        texts[2 * i + 1] = " ".join(words)
    root, pairs = brute_groups(texts)
    prints, _ = simhash_dedup.fingerprints(pa.array([texts[i] for i in range(800)]), BITS)
    far = [np.bitwise_count(prints[a] ^ prints[b]).sum(dtype=int) for a, b in pairs]
    assert sum(f > 80 for f in far) > 30, "pairs that blocks find by chance only"
    for hot in (simhash_dedup.HOT, 300):
        groups = simhash_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=hot)
        found = {r["doc_id"]: r["group_id"] for r in groups.collect()}
        assert {i: found.get(i, i) for i in texts} == root


def planted(rng: np.random.Generator, n: int) -> np.ndarray:
    """Fingerprints in pairs, some CLOSE bits apart and some one more; some with as many bits in each part, or in few parts."""
    a = rng.integers(0, 2, (n, BITS), dtype=np.uint8)
    b = a.copy()
    even, wide = divmod(simhash_dedup.CLOSE, simhash_dedup.BLOCKS), simhash_dedup.BLOCK_BITS
    assert even == (3, 0)
    for i, r in enumerate(b):
        if i % 4 == 0:
            own = np.concatenate([p * wide + rng.choice(wide, 3, replace=False) for p in range(simhash_dedup.BLOCKS)])
        elif i % 4 == 1:
            own = rng.permutation(BITS)[: simhash_dedup.CLOSE]
        elif i % 4 == 2:
            own = rng.permutation(BITS)[: simhash_dedup.CLOSE + 1]
        else:
            own = np.arange(simhash_dedup.CLOSE) + rng.integers(BITS)
        r[own % BITS] ^= 1
    return np.packbits(np.concatenate([a, b]), axis=1)


def test_close_ties_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    prints = planted(rng, 120)
    copies = np.repeat(prints[:1], 90, axis=0)
    copies[:, 70:] = rng.integers(0, 256, (90, 10), dtype=np.uint8)
    copies[::9, 40:70] = rng.integers(0, 256, (10, 30), dtype=np.uint8)
    prints = rng.permutation(np.concatenate([prints, copies]))
    every, far = range(simhash_dedup.BLOCKS), rng.random(len(prints)) < 0.5
    want = exact_ties(prints, simhash_dedup.CLOSE)
    assert sum(w != i for i, w in enumerate(want)) > 150
    for pairs in (simhash_dedup.PAIRS, 7):
        monkeypatch.setattr(simhash_dedup, "PAIRS", pairs)
        assert simhash_dedup.close_ties(prints, None, simhash_dedup.BLOCKS, simhash_dedup.CLOSE, every).tolist() == want
        got = simhash_dedup.close_ties(prints, far, simhash_dedup.BLOCKS, simhash_dedup.CLOSE, every).tolist()
        across = exact_ties(prints, simhash_dedup.CLOSE, far)
        assert all(got[i] == got[w] for i, w in enumerate(across)), "every pair of the two sides is tied"
        assert all(want[i] == want[g] for i, g in enumerate(got)), "and nothing that isn't close"


def test_parts_of_other_widths_and_thresholds():
    rng = np.random.default_rng(8)
    for blocks, close in ((8, 12), (8, 5), (16, 40), (64, 70), (10, 3)):
        prints = rng.integers(0, 256, (60, 40), dtype=np.uint8)
        prints[30:] = prints[:30]
        bits = np.unpackbits(prints, axis=1)
        for i in range(30, 60):
            bits[i, rng.permutation(320)[: close + i % 2]] ^= 1
        prints = np.packbits(bits, axis=1)
        r = simhash_dedup.radii(blocks, close)
        assert (r + 1).sum() == close + 1 and r.max() - r.min() <= 1
        assert simhash_dedup.close_ties(prints, None, blocks, close, range(blocks)).tolist() == exact_ties(prints, close)
