"""Best-fit-decreasing packing of documents into sequences, over the whole table at once.

Lengths are the numbers of words (white-space runs between them) unless a column
gives them. Documents longer than a sequence are cut into full sequences and one
rest. Rests are taken by falling length, each going to the open bin with the least room
that is enough. A segment tree over the CAPACITY + 1 possible rooms finds that bin in
O(log CAPACITY).

What bins look like depends on how many rests there are of each length alone, which is a
table of at most CAPACITY rows. From it one task makes the plan: bins that were filled
alike are stretches of numbers, and rests of one length go to whole stretches, so its
steps grow with CAPACITY and not with the documents. Each rest then finds its bin by its
rank among those of its length; ranks come from one sort by (length, id) over all
partitions and the sums of those before. Only (id, length) is shuffled.

Defined cases: null and empty texts (length 0) and null lengths take no room and
aren't in the result; a null id is packed as null; repeated rows are packed each;
ties go by id, and among equal bins to the one that got that room last; a text of any
length is cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

CAPACITY = 2048


class RoomTree:
    """Segment tree over rooms 0..capacity: is there an open bin with that room?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin of the least room that is at least `least`: (room, number)."""
        any_, size = self.any, self.size
        i = least + size
        if not any_[i]:
            while i & 1 or not any_[i + 1]:  # up, until there is something to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < size:
                i = 2 * i if any_[2 * i] else 2 * i + 1
        room = i - size
        number = self.bins[room].pop()
        if not self.bins[room]:
            any_[i] = 0
            i >>= 1
            while i and not (any_[2 * i] or any_[2 * i + 1]):
                any_[i] = 0
                i >>= 1
        return room, number


def pack(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each length, which must fall and be 1..capacity."""
    tree, bins, offsets, opened = RoomTree(capacity), [], [], 0
    for n in lengths:
        room, number = tree.take(n) or (capacity, opened)
        opened += number == opened
        bins.append(number)
        offsets.append(capacity - room)
        if room > n:
            tree.put(room - n, number)
    return bins, offsets


Run = tuple[int, int, int, int, int]


def plan(many: dict[int, int], capacity: int) -> tuple[dict[int, list[Run]], int]:
    """Runs of each length, and the number of bins, for so many rests of each length.

    A run (rank, bin, step, each, offset): the rests from that rank on go, `each` to a bin, to
    the bins bin, bin + step, ... at offset, offset + length, ... It is what `pack` does with
    the lengths one by one, numbers of bins included.
    """
    tree, opened, out = RoomTree(capacity), 0, {}
    #: Bins of one room as stretches (first, last): the bin to be taken next is the last one.
    stretches: list[tuple[int, int]] = []

    def put(room: int, first: int, last: int) -> None:
        if room:
            stretches.append((first, last))
            tree.put(room, len(stretches) - 1)

    for n in sorted(many, reverse=True):
        left, runs, rank = many[n], [], 0
        while left:
            if found := tree.take(n):
                room, number = found
                first, last = stretches[number]
            else:
                each = capacity // n
                room, bins = capacity, -(-left // each)
                first, last = opened + bins - 1, opened  # the first to be filled is the first to be opened
                opened += bins
            each, step = room // n, 1 if first < last else -1
            count = abs(last - first) + 1
            full = min(count, left // each)
            runs.append((rank, last, -step, each, capacity - room))
            # The bins that are taken last come back on top of their room's stretches.
            taken = full * each
            if full:
                put(room - each * n, last, last - step * (full - 1))
            last -= step * full
            if full < count:
                if some := min(left - taken, each - 1):
                    if first != last:
                        put(room, first, last - step)
                    put(room - some * n, last, last)
                    taken += some
                else:
                    put(room, first, last)
            left -= taken
            rank += taken
        out[n] = runs
    return out, opened


def _ranked(capacity: int):
    """Rows (doc_id, n) by falling r = n % capacity, with the partition, and how many of their r and how many full sequences are before them in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen, full = -1, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            r, count = n % capacity, n // capacity
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
            if r[0] == last:
                nth[: first[1] if len(first) > 1 else len(r)] += seen
            last, seen = r[-1], nth[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), batch.column(0), batch.column(1), pa.array(r), pa.array(nth), pa.array(full + np.cumsum(count) - count)], ["part", "doc_id", "n", "r", "nth", "full"])
            full += int(count.sum())

    return run


def _placed(runs: dict[int, list[Run]], before: dict[tuple[int, int], int], whole: dict[int, int], capacity: int):
    """before: rests of a length in earlier partitions, by (partition, length); whole: full sequences in earlier partitions."""
    tables = {n: np.array(r, np.int64).reshape(-1, 5) for n, r in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n, r, nth, full = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
            ids, count = batch.column(1), n // capacity
            for i in range(0, len(n), 1024):  # a document may have very many pieces
                k = slice(i, i + 1024)
                row = np.repeat(np.arange(len(n))[k], count[k])
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
                if len(row):
                    start = np.array([whole[p] for p in part[row].tolist()], np.int64)
                    yield _rows(start + full[row] + piece, np.zeros(len(row), np.int64), ids.take(pa.array(row)), piece, np.full(len(row), capacity), capacity)
            for length in np.unique(r[r > 0]).tolist():
                row, t = np.flatnonzero(r == length), tables[length]
                rank = np.array([before[p, length] for p in part[row].tolist()], np.int64) + nth[row]
                which = np.searchsorted(t[:, 0], rank, "right") - 1
                in_run, each = rank - t[which, 0], t[which, 3]
                yield _rows(t[which, 1] + in_run // each * t[which, 2], t[which, 4] + in_run % each * length, ids.take(pa.array(row)), count[row], np.full(len(row), length), capacity)

    return run


def _rows(bins: np.ndarray, offset: np.ndarray, ids: pa.Array, piece: np.ndarray, length: np.ndarray, capacity: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(offset), ids, pa.array(piece), pa.array(piece * capacity), pa.array(length)], ["bin", "bin_offset", "doc_id", "piece", "doc_start", "n_tokens"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of a document: its bin, place there, and place in the document.

    Full sequences have the first numbers of bins.
    """
    small_batches(docs.sparkSession)
    n = F.regexp_count(F.col(text_col).cast("string"), F.lit(r"\S+")) if length is None else length
    # Written, as sorting by ranges reads it twice and counting may need Python.
    own = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n"))).filter("n > 0").withColumn("r", F.col("n") % capacity)
    # Equal rows may be a large part of all: the last key deals them to several partitions, and it doesn't matter which is which.
    order = [F.desc("r"), F.asc_nulls_last("doc_id"), F.asc("n")]
    dealt = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order)
    rows = written(dealt.select("doc_id", "n").mapInArrow(_ranked(capacity), "part long, doc_id long, n long, r long, nth long, full long"))
    # At most one row for each partition, and one more for each length.
    sums = rows.groupBy("part", "r").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {capacity}")).alias("full")).collect()
    many: dict[int, int] = {}
    before, whole, full = {}, {}, 0
    for s in sorted(sums, key=lambda s: (s["part"], -s["r"])):
        before[s["part"], s["r"]] = many.get(s["r"], 0)
        many[s["r"]] = many.get(s["r"], 0) + s["k"]
        whole.setdefault(s["part"], full)
        full += s["full"]
    many.pop(0, None)
    runs, _ = plan(many, capacity)
    runs = {k: [(rank, b + full, *rest) for rank, b, *rest in v] for k, v in runs.items()}
    return rows.mapInArrow(_placed(runs, before, whole, capacity), "bin long, bin_offset long, doc_id long, piece long, doc_start long, n_tokens long")
