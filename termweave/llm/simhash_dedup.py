"""SimHash near-duplicate groups, exactly those of all pairs.

A document's fingerprint has BLOCKS * BLOCK_BITS bits: each is the majority, over
the distinct words of the document, of that bit of the words' hashes. Two documents
are near if their fingerprints differ in at most CLOSE bits; the groups are the
connected components of all such pairs. No pair is left to chance:

Let the parts (blocks) of a fingerprint have radii that with one for each part add up to
CLOSE + 1 (`radii`). If a pair is near, its differing bits, less the radius and one for each
part, add up to -1 around the ring of parts. So by the cycle lemma there is a part
from which on all sums are below 0: it differs in at most its radius, and it and the
parts after it, k in all, in at most their radii and k - 1. The pairs of the first kind
are found by looking up all values within the radius (`masks`), those of the second by
one 64-bit word (`part_words`); what is left is verified by all bits.

Fingerprints are dealt to tables of HOT, and every two tables, or a table and itself,
meet in a task, or in several that have some parts each if there are fewer than cores.
So a task's memory is bounded; what is sent and compared grows as the square of the
fingerprints, with a small factor (README).

Nothing is capped. Equal fingerprints are one node from the start. Inside a task rows
of one value that are tied are one class, and pairs that are tied aren't compared again,
so thousands of copies cost a spanning forest and not all their pairs.

Defined cases: documents without words (null, empty, punctuation) and rows with a
null id are in no group; rows with one id are one document; a text of any length is
read whole; an empty table gives an empty result; other columns are ignored (stage:
passed on untouched).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, tidy, two, written
from .components import components

BLOCKS, BLOCK_BITS = 32, 20
#: Bits of BLOCKS * BLOCK_BITS in which near copies may differ (15 %).
CLOSE = 96
#: Fingerprints of one deal (a task holds two deals), and of a table that is worth a task more.
HOT, LEAST = 1 << 18, 1 << 10
#: Pairs that numpy works on at once, close ones that wait to be tied, and how far apart rows of one value are compared first.
PAIRS, HELD, LAGS = 1 << 16, 1 << 12, (1, 2, 4, 8, 16, 32, 64)
#: Bits of a sketch.
SKETCH = 128
#: Nodes that may share a block value by chance, as a power of two.
PARTNERS = 4

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def fingerprints(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bits/8 bytes, distinct words of each document)."""
    w = Words(texts)
    docs, lanes = len(texts), -(-bits // 64)
    out, size = np.zeros((docs, bits // 8), np.uint8), np.zeros(docs, np.int64)
    seeds = mix(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cells = np.arange(bits // 8) * 256
    for d in range(docs):
        words = np.unique(w.hash[w.first[d] : w.first[d + 1]])
        n = size[d] = len(words)
        ones = np.zeros((bits // 8, 8), np.float32)
        for i in range(0, n, 16384):
            h = mix(words[i : i + 16384, None] ^ seeds[None]).view(np.uint8)[:, : bits // 8]
            ones += np.bincount((h + cells).ravel(), minlength=256 * (bits // 8)).reshape(-1, 256).astype(np.float32) @ _BITS
        if n:
            out[d] = np.packbits(ones * 2 > n, axis=1)[:, 0]
    return out, size


# layout to ties serve joins on equal blocks, which find near pairs by chance; near_groups doesn't use them.


def layout(nodes: int, blocks: int = BLOCKS, block_bits: int = BLOCK_BITS, close: int = CLOSE) -> tuple[int, int]:
    """(blocks, bits of each) for so many fingerprints; blocks and block_bits as long as these are wide enough."""
    width = max(block_bits, min(math.ceil(math.log2(max(nodes, 1))) - PARTNERS, blocks * block_bits))
    share = max(1 - close / (blocks * block_bits), 0.5)
    return math.ceil(blocks * share ** (block_bits - width)), width


def block_bits_of(bits: int, blocks: int, width: int) -> np.ndarray:
    """blocks x width of the bits of each block: consecutive ones, then those of permutations."""
    rows, turn = [], np.arange(bits)
    rng = np.random.default_rng(bits)
    while len(rows) < blocks:
        rows += list(turn[: bits // width * width].reshape(-1, width))
        turn = rng.permutation(bits)
    return np.array(rows[:blocks])


def block_values(prints: np.ndarray, blocks: int, block_bits: int) -> np.ndarray:
    """documents x blocks of block numbers above block values."""
    bits = np.unpackbits(prints, axis=1)
    weights = (1 << np.arange(block_bits - 1, -1, -1)).astype(np.int64)
    return np.stack([bits[:, own] @ weights + (i << block_bits) for i, own in enumerate(block_bits_of(bits.shape[1], blocks, block_bits))], axis=1)


def sketches(prints: np.ndarray) -> np.ndarray:
    """SKETCH bits of each fingerprint, evenly from all over it, as 64-bit words."""
    bits = np.unpackbits(prints, axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, np.arange(SKETCH) * bits.shape[1] // SKETCH], axis=1)).view(np.uint64)


def sketch_close(bits: int, close: int) -> int:
    """How far apart the sketches of a pair within close bits may be: 5.2 standard deviations above the mean."""
    share = min(close / bits, 1.0)
    return math.ceil(SKETCH * share + 5.2 * math.sqrt(SKETCH * share * (1 - share)))


def _prints(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, _ in pieces(batches):
            prints, size = fingerprints(texts, bits)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(map(bytes, prints)), pa.binary())], ["doc_id", "print"]).filter(pa.array(size > 0))

    return run


def _keys(blocks: int, block_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = _bytes(batch.column(1))
            sketch = sketches(prints).view(np.int64)
            first, second = pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1]))
            bits = np.unpackbits(prints, axis=1)
            weights = (1 << np.arange(block_bits - 1, -1, -1)).astype(np.int64)
            for i, own in enumerate(block_bits_of(bits.shape[1], blocks, block_bits)):
                yield pa.RecordBatch.from_arrays([pa.array(bits[:, own] @ weights + (i << block_bits)), batch.column(0), first, second], ["key", "node", "s1", "s2"])
        tidy()

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: where each key's rows begin, which run each row is in, and where its run ends."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    return begin, run, np.append(begin[1:], len(key))[run]


def partnered(key: np.ndarray, sketch: np.ndarray, close: int) -> np.ndarray:
    """For rows sorted by key, which have another row of their key with a sketch at most close bits away."""
    begin, run, stop = _runs(key)
    found, at, lag = np.zeros(len(key), bool), np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at + lag < stop[at]]
        if lag & (lag - 1) == 0 and len(at):
            at = at[~np.logical_and.reduceat(found, begin)[run[at]]]
        if not len(at):
            return found
        a = at[~(found[at] & found[at + lag])]
        for i in range(0, len(a), 1 << 16):
            x = a[i : i + (1 << 16)]
            near = x[np.bitwise_count(sketch[x] ^ sketch[x + lag]).sum(axis=1, dtype=np.int64) <= close]
            found[near] = found[near + lag] = True


def ties(key: np.ndarray, prints: np.ndarray, close: int) -> np.ndarray:
    """For rows sorted by key, the least row each is tied to by close pairs of its key."""
    label = np.arange(len(key))
    words = np.ascontiguousarray(np.pad(prints, ((0, 0), (0, -prints.shape[1] % 8)))).view(np.uint64)
    begin, run, stop = _runs(key)
    at, lag = np.arange(len(key)), 0
    while True:
        lag += 1
        at = at[at + lag < stop[at]]
        if lag & (lag - 1) == 0 and len(at):  # runs that are one group by now need no more pairs
            done = np.maximum.reduceat(label, begin) == begin
            at = at[~done[run[at]]]
        if not len(at):
            return label
        a = at[label[at] != label[at + lag]]
        for i in range(0, len(a), 1 << 16):
            x = a[i : i + (1 << 16)]
            near = np.bitwise_count(words[x] ^ words[x + lag]).sum(axis=1, dtype=np.int64) <= close
            _union(label, x[near], x[near] + lag)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Tie the pairs a, b; before and after, label is the least row of each group."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := label[label], label):  # paths halve
            label[:] = up


def _whole_keys(batches: Iterator[pa.RecordBatch], most: float = math.inf) -> Iterator[tuple[pa.Table, int, bool]]:
    """Rows sorted by key, cut between keys, as (rows, part, is there more than one part).

    Only a key with more than most rows is cut into parts, of that many rows or a batch more.
    """
    held: list[pa.RecordBatch] = []
    part = 0

    def table(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        old = int(np.searchsorted(key, held[-1].column(0)[0].as_py(), "right")) if held else 0
        if old:
            held.append(batch.slice(0, old))
        if held and old < len(key):  # the key that was open has ended
            yield table(held), part, part > 0
            held, part = [], 0
        last = max(old, int(np.searchsorted(key, key[-1])))  # the last key may go on in the next batch
        if last > old:
            yield table([batch.slice(old, last - old)]), 0, False
        if last < len(key):
            held.append(batch.slice(last))
        if held and sum(b.num_rows for b in held) > most:
            yield table(held), part, True
            held, part = [], part + 1
    if held:
        yield table(held), part, part > 0


def radii(blocks: int, close: int) -> np.ndarray:
    """Bits in which each part may differ: they and one for each part add up to close + 1 (-1: the part isn't needed)."""
    least, more = divmod(close - blocks + 1, blocks)
    return least + (np.arange(blocks) < more)


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius ones, fewest ones first."""
    rings = [[sum(1 << i for i in ones) for ones in combinations(range(bits), n)] for n in range(min(radius, bits) + 1)]
    return np.array([m for ring in rings for m in ring], np.int64)


def part_words(prints: np.ndarray, first: int, width: int) -> np.ndarray:
    """width (at most 64) bits of each fingerprint from bit first on, around its end."""
    own = prints[:, (first // 8 + np.arange(9)) % prints.shape[1]]
    high = np.ascontiguousarray(own[:, :8]).view(">u8")[:, 0].astype(np.uint64)
    both = high << np.uint64(first % 8) | own[:, 8].astype(np.uint64) >> np.uint64(8 - first % 8)
    return both >> np.uint64(64 - width)


def _spans(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Spans i:j of the rows with first, first + 1, ... (n of each, none 0): about PAIRS at a time."""
    ends, i = np.cumsum(n), 0
    while i < len(n):
        base = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        yield i, j, np.arange(int(ends[j - 1]) - base) + np.repeat(first[i:j] - (ends[i:j] - n[i:j] - base), n[i:j])
        i = j


class _Sorted:
    """Rows by their value in one part: runs of one value, and in them classes of rows that are tied."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, shift: int, width: int, label: np.ndarray):
        value = (words[rows] >> np.uint64(shift)).astype(np.int64)
        own = label[rows]
        order = np.argsort(value << 22 | own) if width <= 40 and len(label) <= 1 << 22 else np.lexsort((own, value))
        self.rows, value, own = rows[order], value[order], own[order]
        new = np.append(True, value[1:] != value[:-1])
        at = np.flatnonzero(new | np.append(True, own[1:] != own[:-1]))
        self.at, self.size = at, np.diff(np.append(at, len(rows)))  # where each class begins in rows, its rows
        self.row, self.value, self.words = self.rows[at], value[at], words[self.rows[at]]  # of its first row
        self.many = np.flatnonzero(self.size > 1)
        run = np.flatnonzero(new[at])  # the first class of each run
        self.run, self.runs = run, np.diff(np.append(run, len(at)))
        self.by_value = width <= 22
        if self.by_value:
            self.first, self.classes = np.zeros(1 << width, np.int32), np.zeros(1 << width, np.int32)
            self.first[self.value[run]], self.classes[self.value[run]] = run, self.runs

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the values there are, and the first class and the number of classes of each of these."""
        if self.by_value:
            n = self.classes[value]
            own = np.flatnonzero(n)
            return own, self.first[value[own]].astype(np.int64), n[own].astype(np.int64)
        at = np.minimum(np.searchsorted(self.value[self.run], value), len(self.run) - 1)
        own = np.flatnonzero(self.value[self.run[at]] == value)
        return own, self.run[at[own]], self.runs[at[own]]


def close_ties(prints: np.ndarray, far: np.ndarray | None, blocks: int, close: int, parts: Iterable[int]) -> np.ndarray:
    """The least row that each row is tied to by the close pairs which these parts find; of all parts, by all close pairs.

    far: only pairs of a row for which it is true and one for which it isn't are sure to be tied, others may be; None: any pairs.
    """
    label, width = np.arange(len(prints)), prints.shape[1] * 8 // blocks
    full = np.ascontiguousarray(prints).view(np.uint64)
    radius, chain = radii(blocks, close), max(1, min(64 // width, blocks))
    sides = [np.arange(len(prints))] if far is None else [np.flatnonzero(~far), np.flatnonzero(far)]
    if not all(map(len, sides)):
        return label
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def tie(x: np.ndarray, y: np.ndarray) -> None:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        near = np.bitwise_count(full[x] ^ full[y]).sum(axis=1, dtype=np.int64) <= close
        if near.any():
            held.append((x[near], y[near]))
            if sum(len(h) for h, _ in held) > HELD:
                settle()

    def settle() -> None:
        if held:
            _union(label, *map(np.concatenate, zip(*held)))
            held.clear()

    for part in parts:
        if radius[part] < 0:
            continue
        words, shift = part_words(prints, part * width, chain * width), (chain - 1) * width
        most = int(radius[(part + np.arange(chain)) % blocks].sum()) + chain - 1
        order = np.argsort(words)
        value = words[order] >> np.uint64(shift)
        for lag in LAGS:  # thousands of copies are one class before any two classes meet
            same = np.flatnonzero(value[lag:] == value[:-lag])
            for i in range(0, len(same), PAIRS):
                tie(order[same[i : i + PAIRS]], order[same[i : i + PAIRS] + lag])
            settle()
        one = _Sorted(sides[0], words, shift, width, label)
        two_ = one if far is None else _Sorted(sides[1], words, shift, width, label)

        def meet(a: np.ndarray, words: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
            """The first rows of classes a (of one) and of the n classes from first on (of two_)."""
            for i, j, b in _spans(first, n):
                ring = np.flatnonzero(np.bitwise_count(np.repeat(words[i:j], n[i:j]) ^ two_.words[b]) <= most)
                if len(ring):
                    tie(one.row[a[i + np.searchsorted(np.cumsum(n[i:j]), ring, "right")]], two_.row[b[ring]])

        def meet_all(x: _Sorted, y: _Sorted, mask: int) -> None:
            """All rows of those classes of x that have several, and of their classes of y, unless tied."""
            own, first, n = y.find(x.value[x.many] ^ mask)
            for i, j, b in _spans(first, n):
                a = np.repeat(x.many[own[i:j]], n[i:j])
                apart = np.flatnonzero(label[x.row[a]] != label[y.row[b]])
                a, b = a[apart], b[apart]
                for k, l, row in _spans(x.at[a], x.size[a]):
                    to = np.repeat(b[k:l], x.size[a[k:l]])
                    for g, h, other in _spans(y.at[to], y.size[to]):
                        u, v = np.repeat(x.rows[row[g:h]], y.size[to[g:h]]), y.rows[other]
                        ring = np.bitwise_count(words[u] ^ words[v]) <= most
                        tie(u[ring], v[ring])

        lower = {}  # each two runs of one table meet once, from the one without the highest bit of the mask
        for mask in masks(width, int(radius[part])).tolist():
            if far is None and not mask:
                n = np.repeat(one.run + one.runs, one.runs) - 1 - np.arange(len(one.at))
                a = np.flatnonzero(n)
                meet(a, one.words[a], a + 1, n[a])
            else:
                top = mask.bit_length() if far is None else 0
                if top not in lower:
                    a = np.flatnonzero(one.value >> (top - 1) & 1 == 0) if top else np.arange(len(one.at))
                    lower[top] = a, one.value[a]
                a, value = lower[top]
                own, first, n = two_.find(value ^ mask)
                a = a[own]
                meet(a, one.words[a], first, n)
            if len(one.many):
                meet_all(one, two_, mask)
            if far is not None and len(two_.many):
                meet_all(two_, one, mask)
        settle()
    return label


def _edges(blocks: int, close: int, dealt: int, turns: int):
    """Rows (key, far, node, print) sorted by key -> a spanning forest (u, v) of the close pairs of each key's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _, _ in _whole_keys(batches):
            begin, _, _ = _runs(held.column("key").to_numpy())
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(held)]):
                t = held.slice(i, j - i)
                pair, turn = divmod(t.column("key")[0].as_py(), turns)
                far = t.column("far").to_numpy() if pair // dealt != pair % dealt else None
                node, prints = t.column("node").to_numpy(), _fixed(t.column("print"))
                label = close_ties(prints, far, blocks, close, range(turn, blocks, turns))
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"])
        tidy()

    return run


def _fixed(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints, all of one length and none null, without an object for each."""
    if column.num_chunks != 1:
        return _bytes(column)
    own = column.chunk(0)
    ends = np.frombuffer(own.buffers()[1], np.int32 if pa.types.is_binary(own.type) else np.int64)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(own), -1)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, block_bits: int = BLOCK_BITS, close: int = CLOSE, hot: int = HOT) -> DataFrame:
    """(doc_id, group_id, group_size) of every document that has a near copy; group_id is its least id."""
    if blocks * block_bits % 64 or blocks * block_bits < SKETCH or block_bits > 62:
        raise ValueError(f"blocks * block_bits must be whole 64-bit words, {SKETCH} bits at least, and block_bits at most 62")
    own = two(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    prints = written(own.mapInArrow(_prints(blocks * block_bits), "doc_id long, print binary"))
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("node")).select("node", "print"))
    total = nodes.count()
    dealt = max(1, -(-total // hot))
    tasks = max(1, min(2 * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST))
    turns = min(blocks, -(-tasks // (dealt * (dealt + 1) // 2)))
    rows = nodes.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(dealt))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    key = (F.least("own", "other") * dealt + F.greatest("own", "other")) * turns + F.col("turn")
    rows = rows.select(key.cast("long").alias("key"), (F.col("own") > F.col("other")).alias("far"), "node", "print")
    by_block = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(blocks, close, dealt, turns), "u long, v long")
    # A document with several rows ties their fingerprints. Copies of a fingerprint join their node at the end.
    docs_of = written(prints.join(nodes, "print").select("doc_id", "node"))
    several = docs_of.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v <> most").select("doc_id", "v")
    by_print = docs_of.join(several, "doc_id").select(F.col("node").alias("u"), "v")
    roots = components(by_block.unionAll(by_print)).select("node", "root")
    members = docs_of.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("group_id")).distinct()
    sizes = members.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return members.join(sizes, "group_id").select("doc_id", "group_id", "group_size")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the near copies of a document with a lesser id. All columns stay."""
    gone = near_groups(docs, id_col, text_col, **params).filter("doc_id <> group_id").select(F.col("doc_id").alias("k"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("k"))
    return rows.join(gone, "k", "left_anti").select("row.*")
