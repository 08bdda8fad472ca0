"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs. A 3-gram of letters is the
product (binding) of its letters' vectors, permuted by place; a text is the sum
(bundle) of its 3-grams, a language the sum of its training texts' directions.
A text's language is the prototype with the greatest cosine.

Prototypes are fitted on at most TRAIN labelled documents of each language, those
with the least hash of their id; everything else runs over all documents. Sums of
3-gram vectors are a product of the texts' 3-gram counts and a matrix, so the cost
per text is that of its distinct 3-grams.

Defined cases: texts without letters (null, empty) have language ``und`` and null
scores; rows with a null language or id don't train; with no training text every
document is ``und``; ties go to the language that is first by name; repeated rows
give repeated results; a text of any length is bundled whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, two, written

DIMENSIONS, TRAIN, SEED = 1024, 500, 7
#: Symbols: 0 is any run of non-letters, 1-26 are a-z, the rest other letters.
SYMBOLS = 128
#: 3-gram vectors in memory at once; cells of the table of counts for each 3-gram there is, up to which the table is made.
PART, DENSE = 1 << 14, 20
#: 3-gram vectors that a worker keeps.
KEPT = 1 << 15
#: Most ids of training documents that are sent to every task (8 MB).
SENT = 1_000_000


@functools.cache
def _fold() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = 27 + (c - 0xC0 if 0xC0 <= c < 0x100 else 64 + c % 37)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


class Space:
    """The random letter vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.dimensions = dimensions
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.kept, self.used = np.empty((KEPT, dimensions), np.int8), 0

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of some 3-grams."""
        a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return self.places[0][a] * self.places[1][b] * self.places[2][c]

    def rows(self, codes: np.ndarray) -> np.ndarray | None:
        """Where the vectors of 3-grams are kept; None if these alone are too many (all there can be would take gigabytes)."""
        r = self.row[codes]
        if r.min(initial=0) < 0:
            new = np.unique(codes[r < 0])
            if self.used + len(new) > KEPT:  # start anew
                self.row[:], self.used = -1, 0
                new = np.unique(codes)
            if len(new) > KEPT:
                return None
            self.kept[self.used : self.used + len(new)] = self.vectors(new)
            self.row[new] = self.used + np.arange(len(new))
            self.used += len(new)
            r = self.row[codes]
        return r

    def bundle(self, texts: pa.Array) -> np.ndarray:
        """The sum of each text's 3-gram vectors (texts x dimensions)."""
        low = pc.utf8_lower(texts)
        sizes = np.asarray(pc.utf8_length(low).to_numpy(zero_copy_only=False), np.int64) + 2
        points = np.frombuffer("".join(f" {t} " for t in low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = np.where(points < 1 << 16, _fold()[points & 0xFFFF], 27 + 64 + (points % 37)).astype(np.int32)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # one gap for a run of non-letters of a document
        keep = np.append(True, (symbol[1:] != 0) | (symbol[:-1] != 0) | (doc[1:] != doc[:-1]))
        symbol, doc = symbol[keep], doc[keep]
        own = doc[2:] == doc[:-2]
        code = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
        own &= code > 0
        code, doc = code[own], doc[2:][own]
        out = np.zeros((len(sizes), self.dimensions), np.float32)
        if not len(code):
            return out
        rows = self.rows(code)
        if rows is None:
            used, column = np.unique(code, return_inverse=True)
            vectors = lambda x: self.vectors(used[x]).astype(np.float32)
        else:
            used = np.flatnonzero(np.bincount(rows))
            place = np.zeros(used[-1] + 1, np.int64)
            place[used] = np.arange(len(used))
            column = place[rows]
            vectors = lambda x: self.kept[used[x]].astype(np.float32)
        # A product of counts and vectors where most texts have many of the 3-grams, else a sum over those they have.
        if len(sizes) * len(used) <= DENSE * len(code):
            for i in range(0, len(used), PART):
                n = min(PART, len(used) - i)
                here = slice(None) if n == len(used) else (column >= i) & (column < i + n)
                counts = np.bincount(doc[here] * n + (column[here] - i), minlength=len(sizes) * n).reshape(len(sizes), n)
                out += counts.astype(np.float32) @ vectors(slice(i, i + n))
            return out
        cell, times = np.unique(doc * len(used) + column, return_counts=True)
        doc, column = cell // len(used), cell % len(used)
        for i in range(0, len(cell), PART):
            d = doc[i : i + PART]
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            out[d[first]] += np.add.reduceat(vectors(column[i : i + PART]) * times[i : i + PART, None].astype(np.float32), first, axis=0)
        return out


@functools.lru_cache(4)
def space(dimensions: int, seed: int) -> Space:
    return Space(dimensions, seed)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _sum(dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, texts, _ in pieces(batches):
            unit = _unit(space(dimensions, seed).bundle(texts)).astype(np.float64)
            langs = np.array(rows.column(2).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                total[lang] = total.get(lang, 0) + unit[langs == lang].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "total"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from at most per_language documents of each."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("doc_id").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
    # Sent to every task only if they are few (8 bytes each); else both sides are shuffled.
    chosen = written(chosen)
    chosen = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    parts = own.join(chosen, "doc_id", "left_semi").mapInArrow(_sum(dimensions, seed), "lang string, total array<double>")
    # One row of sums for each language and dimension comes to the driver.
    sums = parts.select("lang", F.posexplode("total").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("l")).select("lang", F.col("l.x").alias("total")).toPandas()
    total: dict[str, np.ndarray] = {}
    for lang, v in sorted(zip(sums["lang"], sums["total"]), key=lambda x: (x[0], *x[1][:2])):
        total[lang] = total.get(lang, 0) + np.asarray(v)
    return {lang: _unit(v[None])[0] for lang, v in sorted(total.items()) if np.any(v)}


def _compare(prototypes: dict[str, np.ndarray], dimensions: int, seed: int):
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, _ in pieces(batches):
            vectors = space(dimensions, seed).bundle(texts)
            blank = ~vectors.any(axis=1) if names else np.ones(len(texts), bool)
            cosines = np.round(_unit(vectors) @ matrix.T, 6) if names else np.zeros((len(texts), 1))
            best = cosines.argmax(axis=1)
            score = cosines[np.arange(len(best)), best].astype(np.float64)
            rest = cosines.copy()
            rest[np.arange(len(best)), best] = -2
            margin = score - rest.max(axis=1) if len(names) > 1 else np.full(len(best), np.nan)
            lang = np.where(blank, "und", np.array(names or ["und"], object)[best])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score, mask=blank), pa.array(margin, mask=blank | np.isnan(margin))], ["doc_id", "lang_found", "score", "margin"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_found, score, margin) of every document."""
    return two(docs, id_col, text_col).mapInArrow(_compare(prototypes, dimensions, seed), "doc_id long, lang_found string, score double, margin double")
