"""Shared parts: batches bounded by bytes, and vectorised word splitting.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Splitting and hashing work on whole Arrow buffers with numpy;
no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import discard, written

__all__ = ["BATCH_BYTES", "BLOCK_BYTES", "Rolling", "WORD_RE2", "Words", "blocks", "discard", "mix", "pieces", "small_batches", "spread", "tidy", "two", "utf8", "written"]

#: Bytes of text that numpy works on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes in one Arrow batch between the JVM and a Python worker, unless the session says otherwise.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as documents may be long; a setting other than the default stays.

    It also sees to it that workers can import this package.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(name, BATCH_BYTES)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns of the input can't clash or be read."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


# --- words ------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("0") : ord("9") + 1] = _WORD[128:] = True
#: The same words for SQL engines with RE2 or Java patterns, on lower-cased text.
WORD_RE2 = r"[a-z0-9\x{80}-\x{10FFFF}]+"

_P, _Q, _Q2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


@functools.lru_cache(8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below 2**bits (base is odd)."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        step = b
        for _ in range(bits):
            p = np.concatenate([p, p * np.uint64(step)])
            step = step * step % (1 << 64)
        both.append(p)
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values in constant time each."""

    def __init__(self, values: np.ndarray, base: int = _Q):
        n = len(values)
        pw, self.inv = _powers(base, max(10, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inv[start] + (stop - start).astype(np.uint64))


class Words:
    """The words of some texts: first/last byte, document, hash and characters of each."""

    def __init__(self, texts: pa.Array, hashes: bool = True):
        data, self.off = utf8(pc.utf8_lower(texts))
        self.data = data
        word = _WORD[data]
        edge = np.ones(len(data) + 1, bool)  # a word can't go on over these
        edge[:] = False
        edge[self.off] = True
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, word
        now = np.empty(len(data) + 1, bool)
        now[:-1], now[-1] = word, False
        self.start = np.flatnonzero(now & (~before | edge))
        self.stop = np.flatnonzero(before & (~now | edge))
        self.first = np.searchsorted(self.start, self.off)  # words of document d: first[d]:first[d+1]
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        chars = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        self.char_at = chars
        self.chars = (chars[self.stop] - chars[self.start]).astype(np.int64)
        if hashes:
            self.hash = _word_hashes(data, self.start, self.stop)

    def left(self) -> np.ndarray:
        """How many words there are from each word to its document's end."""
        return self.first[self.doc + 1] - np.arange(len(self.doc))


def _word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, span: int = 1 << 17) -> np.ndarray:
    """Hash of each word's bytes, a span of bytes at a time so that memory stays small."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + span, "right")))
        base = start[i]
        out[i:j] = Rolling(data[base : stop[j - 1]].astype(np.uint64) + np.uint64(1), _P).of(start[i:j] - base, stop[i:j] - base)
        i = j
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        i = j


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Each batch in blocks: the rows, their texts with null as empty, and which were null."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for i, j in blocks(column):
            part = column.slice(i, j - i)
            yield batch.slice(i, j - i), pc.fill_null(part, ""), pc.is_null(part)
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] values, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)
