"""Exact duplicates by content-defined chunk recipes.

Texts are cut where a rolling (gear) hash of the last 32 bytes has CUT_BITS zero
bits, never below MIN_CHUNK nor above MAX_CHUNK bytes, so equal texts have equal
chunks. Chunk contents move once, to be deduplicated: a chunk's identifier is its
64-bit hash, verified by comparing contents, with a number added where different
contents share a hash. Documents are then compared by their ordered lists of
identifiers alone.

Defined cases: a null text is no copy of anything; empty texts are copies of each
other; repeated rows count as copies; a null id is carried as null and never
names a group unless all ids of the group are null; a text of any length is read whole;
of rows with one id and text the stage keeps the first by their other columns; an empty table gives an empty result; other columns are ignored (stage: passed on untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import blocks, mix, small_batches, tidy, utf8, written

CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 256, 16384
WINDOW = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of each text, end of every chunk). A text's cuts depend on that text alone."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    sure = np.flatnonzero((h & np.uint32((1 << CUT_BITS) - 1) << np.uint32(32 - CUT_BITS)) == 0) + 1
    ends: list[int] = []
    counts = np.zeros(len(off) - 1, np.int64)
    for d in range(len(off) - 1):
        at, stop, was = int(off[d]), int(off[d + 1]), len(ends)
        i = int(np.searchsorted(sure, at + MIN_CHUNK))
        while stop - at > MIN_CHUNK:
            while i < len(sure) and sure[i] < at + MIN_CHUNK:
                i += 1
            at = min(int(sure[i]) if i < len(sure) else stop, at + MAX_CHUNK, stop)
            ends.append(at)
        if stop > at:
            ends.append(stop)
        counts[d] = len(ends) - was
    return counts, np.array(ends, np.int64)


def _chunked(batches: Iterator[pa.RecordBatch], hash_bits: int):
    """Per block: rows, chunks of each row, then hashes and contents of all chunks."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for i, j in blocks(column):
            data, off = utf8(column.slice(i, j - i))
            counts, ends = cuts(data, off)
            view = memoryview(data)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            content = [bytes(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in content), np.uint64, len(content))
            yield batch.slice(i, j - i), counts, (hashes >> np.uint64(64 - hash_bits)).view(np.int64), content
    tidy()


def _recipes(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, hashes, _ in _chunked(batches, hash_bits):
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(hashes))], ["doc_id", "text_key", "recipe"])

    return run


def _contents(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, hashes, content in _chunked(batches, hash_bits):
            # equal contents of a block move once
            first = list(dict.fromkeys(zip(hashes.tolist(), content)))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in first], pa.int64()), pa.array([c for _, c in first], pa.binary())], ["h", "chunk"])

    return run


def _placed(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, hashes, content in _chunked(batches, hash_bits):
            row = np.repeat(np.arange(len(counts)), counts)
            ord_ = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(ord_), pa.array(hashes), pa.array(content, pa.binary())], ["doc_id", "text_key", "ord", "h", "chunk"])

    return run


def _groups(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    """(doc_id, text_key, keep_id, copies) of the rows whose text occurs more than once."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).filter("text IS NOT NULL")
    chunks = own.mapInArrow(_contents(hash_bits), "h long, chunk binary").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = written(chunks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    recipes = own.mapInArrow(_recipes(hash_bits), "doc_id long, text_key long, recipe array<long>")
    if shared.isEmpty():  # every hash stands for one content: the hash is the identifier
        recipes = recipes.withColumn("recipe", F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("sub"))))
    else:
        # At 64 bits some hashes collide among 10**10 chunks: only texts with one of these send their chunks again.
        recipes = written(recipes)
        number = Window.partitionBy("h").orderBy("chunk")
        subs = chunks.join(shared, "h").select("h", "chunk", F.row_number().over(number).alias("sub"))
        none = F.array().cast("array<struct<h:long,sub:int>>")
        plain = F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("sub")))
        hit = written(recipes.select("text_key", F.explode("recipe").alias("h")).join(shared, "h", "left_semi").select("text_key").distinct())
        there = own.join(hit, "text_key", "left_semi").select("doc_id", "text_key", "text")
        placed = there.mapInArrow(_placed(hash_bits), "doc_id long, text_key long, ord long, h long, chunk binary")
        # One recipe per (id, key of the text); rows that share both are the same text.
        lists = placed.join(subs, ["h", "chunk"], "left").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("ord", F.struct("h", F.coalesce("sub", F.lit(0)).alias("sub")).alias("id")))).alias("l"))
        lists = lists.select("doc_id", "text_key", F.col("l.id").alias("recipe"))
        r = recipes.join(hit, "text_key", "left_semi").select("doc_id", "text_key").alias("r")
        match = F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.text_key") == F.col("l.text_key"))
        again = r.join(lists.alias("l"), match, "left").select("r.doc_id", "r.text_key", F.coalesce("recipe", none).alias("recipe"))
        recipes = recipes.join(hit, "text_key", "left_anti").select("doc_id", "text_key", plain.alias("recipe")).unionByName(again)
    recipes = written(recipes)
    repeated = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1")
    return recipes.join(repeated, "recipe").select("doc_id", "text_key", "keep_id", "copies")


def _orders(kind: DataType) -> bool:
    """Whether Spark can sort by a type: maps and variants have no order."""
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, copies) for each row whose text occurs more than once; keep_id is the least id."""
    return _groups(docs, id_col, text_col, hash_bits).select("doc_id", "keep_id", "copies")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """docs with one row for each text, that with the least id. All columns and null texts stay."""
    groups = written(_groups(docs, id_col, text_col, hash_bits))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("k"), F.xxhash64(text).alias("t"), text.isNull().alias("none")).alias("r")

    def on(other: str):
        return F.col("r.k").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("r.t") == F.col(f"{other}.text_key")) & ~F.col("r.none")

    gone = groups.filter(~kept).select("doc_id", "text_key").distinct().alias("g")
    out = rows.join(gone, on("g"), "left_anti").alias("r")
    again = written(groups.filter(kept).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key"))
    if again.isEmpty():
        return out.select("row.*")
    # Repeated rows of the one that stays: the first of them in the order of their other columns.
    order = [F.col(f"row.{c}") if _orders(t) else F.to_json(F.struct(F.col(f"row.{c}").alias("x"))) for c, t in ((f"`{f.name}`", f.dataType) for f in docs.schema)]
    first = Window.partitionBy("k", "t").orderBy(*order)
    once = out.join(again.alias("a"), on("a"), "left_semi").select("row", "k", "t", "none", F.row_number().over(first).alias("nth")).filter("nth = 1").drop("nth")
    return out.join(again.alias("b"), on("b"), "left_anti").unionAll(once).select("row.*")


SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
FROM documents WHERE text IS NOT NULL QUALIFY copies > 1"""
