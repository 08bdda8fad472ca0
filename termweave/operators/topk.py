"""Top-k joins by similarity, ranks, and the views of their results.

Results are long: one row for each query and rank. Scores are rounded before
they are ranked, and ties go by a key of the candidate, so that ranks don't
depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..storage import written

DIGITS = 6
MISS = 99
#: Distinct n-grams that are laid out at once as a dense matrix.
GRAMS = 2048
#: Queries of a block that are scored at once, and bytes of corpus blocks that a task of a product holds.
ROWS, PART = 256, 32 << 20


def ranked(scored: DataFrame, k: int | None, by: str | list[str], score: Column | str = "score", ties: list[str] | None = None) -> DataFrame:
    """The k best of each group with their rank (bigint from 1); Spark cuts to k before the shuffle."""
    keys = [by] if isinstance(by, str) else by
    best = F.desc(score) if isinstance(score, str) else score.desc()
    order = Window.partitionBy(*keys).orderBy(best, *(F.asc(t) for t in ties or ["label"]))
    out = scored.withColumn("rank", F.row_number().over(order))
    return (out.filter(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("bigint"))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, block: int = 8192, exclude_same: bool = False) -> DataFrame:
    """queries (qid, embedding) x corpus (cid, embedding) -> (qid, cid, score, rank), exact cosine.

    Both sides are laid out in blocks (a row for each block of vectors); every pair of blocks
    is one matrix product. A task meets some blocks of queries with a part of the corpus, keeps
    the k best of each query over all of that part, and only these leave it. So the work is
    spread over both sides, and neither has to fit into a task.
    """
    left = _packed(queries.select(F.col("qid").cast("long").alias("id"), "embedding"), block).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    right = _packed(corpus.select(F.col("cid").cast("long").alias("id"), "embedding"), block).select(F.col("ids").alias("cids"), F.col("data").alias("cdata"))
    pairs = _product(written(left), written(right), "qdata", "cdata")
    kinds = _kind(queries), _kind(corpus)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = found = None
        for batch in batches:
            for i in range(batch.num_rows):
                # All blocks of a part come after one another for each block of queries.
                if batch.column(0)[i].as_py() != at:
                    if found:
                        yield found.rows()
                    at, found = batch.column(0)[i].as_py(), _Best(*_block(batch, i, 1, kinds[0]), k, exclude_same)
                found.meet(*_block(batch, i, 3, kinds[1]))
        if found:
            yield found.rows()

    return ranked(pairs.mapInArrow(best, "qid long, cid long, score double"), k, "qid", ties=["cid"])


def _kind(vectors: DataFrame) -> np.dtype:
    """What the numbers of a block are kept as."""
    return np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)


def _block(batch: pa.RecordBatch, i: int, j: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block, without those that have no direction (NaN, infinite)."""
    ids = batch.column(j)[i].values.to_numpy()
    m = np.frombuffer(batch.column(j + 1)[i].as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m /= np.where(size > 0, size, 1)
    fine = np.isfinite(m).all(axis=1)
    return (ids, m) if fine.all() else (ids[fine], m[fine])


class _Best:
    """The k best of each query of a block, of all corpus blocks that it met.

    Products are made in single precision; what could be among the k by the greatest error
    of these (and of the rounding) is scored in double precision.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_same: bool):
        self.ids, self.vectors, self.single, self.k, self.exclude_same = ids, vectors, vectors.astype(np.float32), k, exclude_same
        self.scores, self.cids = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.slack = (vectors.shape[1] + 4) * 2.0**-23 + 2 * 10.0**-DIGITS

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        single, place = c.astype(np.float32).T, None
        same = self.exclude_same and bool(np.isin(c_ids, self.ids).any())
        for start in range(0, len(self.ids) if len(c_ids) else 0, ROWS):
            part = slice(start, start + ROWS)
            near = self.single[part] @ single
            if same:
                near[self.ids[part, None] == c_ids[None]] = -np.inf
            least = self.scores[part, -1] - self.slack
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and len(c_ids) > self.k:
                least[new] = np.partition(near[new], len(c_ids) - self.k, axis=1)[:, len(c_ids) - self.k] - 2 * self.slack
            rows = np.flatnonzero(near.max(axis=1) >= least)
            if not len(rows):
                continue
            close = (near[rows] >= least[rows, None]) & (near[rows] > -np.inf)
            # Where very many are close (equal vectors), the rows are scored as a whole.
            many = close.sum(axis=1) > 8 * self.k + 64
            if many.any():
                place = np.argsort(np.argsort(c_ids, kind="stable")) if place is None else place
                whole = np.round(self.vectors[part][rows[many]] @ c.T, DIGITS) + 0.0
                whole[~close[many]] = -np.inf
                row, at = _leaders(whole, place, self.k)
                keep = np.isfinite(whole[row, at])
                row, at = row[keep], at[keep]
                self._take(start + rows[many][row], c_ids[at], whole[row, at])
                rows, close = rows[~many], close[~many]
            row, at = np.divmod(np.flatnonzero(close), len(c_ids))
            row = start + rows[row]
            self._take(row, c_ids[at], np.round(np.einsum("ij,ij->i", self.vectors[row], c[at]), DIGITS) + 0.0)

    def _take(self, row: np.ndarray, cids: np.ndarray, scores: np.ndarray) -> None:
        """Puts candidates among the k of their rows."""
        had = np.unique(row)
        row, cids, scores = (np.concatenate([x, y]) for x, y in ((row, np.repeat(had, self.k)), (cids, self.cids[had].ravel()), (scores, self.scores[had].ravel())))
        order = np.lexsort((cids, -scores, row))
        row, cids, scores = row[order], cids[order], scores[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.scores[row[keep], rank[keep]], self.cids[row[keep], rank[keep]] = scores[keep], cids[keep]

    def rows(self) -> pa.RecordBatch:
        row, at = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.cids[row, at]), pa.array(self.scores[row, at])], ["qid", "cid", "score"])


def _leaders(scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest scores of each row; for equal ones those of the least place."""
    rows, columns = scores.shape
    if k >= columns:
        return np.repeat(np.arange(rows), columns), np.tile(np.arange(columns), rows)
    # All that is above the k-th score, and of those equal to it the first few.
    least = np.partition(scores, columns - k, axis=1)[:, columns - k, None]
    above = scores > least
    row, at = np.nonzero(scores == least)
    order = np.lexsort((place[at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(rows))
    take = np.arange(len(row)) - first[row] < (k - above.sum(axis=1))[row]
    more, there = np.nonzero(above)
    return np.concatenate([more, row[take]]), np.concatenate([there, at[take]])


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of one side with every one of the other.

    Both are written: so blocks are made once, and the bytes of a table of blocks are known
    when Spark decides whether it is small enough (spark.sql.autoBroadcastJoinThreshold) to
    go to every task, or a product of both sides' partitions it is.
    """
    return written(left).crossJoin(written(right))


def _product(left: DataFrame, right: DataFrame, *data: str) -> DataFrame:
    """Every block of one written side with every one of the other, in tasks of a part of each.

    A part of the right side has at most PART bytes: it is held while the left one's blocks pass.
    There are a few tasks for each core, if there are blocks enough.
    """
    (n, _), (m, size) = (df.agg(F.count("*"), F.coalesce(F.sum(F.length(x)), F.lit(0))).first() for df, x in zip((left, right), data))
    tasks = 3 * left.sparkSession.sparkContext.defaultParallelism
    lefts = max(1, min(n, tasks))
    rights = max(1, min(m, max(-(-size // PART), -(-tasks // lefts))))
    return left.repartition(lefts).hint("shuffle_replicate_nl").crossJoin(right.repartition(rights))


def _packed(vectors: DataFrame, block: int) -> DataFrame:
    """Blocks of vectors: (ids, bytes of a matrix)."""
    kind = _kind(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            count = -(-batch.num_rows // block)
            for i in range(count):
                start, end = batch.num_rows * i // count, batch.num_rows * (i + 1) // count
                part = batch.slice(start, end - start)
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "data"])

    return vectors.mapInArrow(pack, "ids array<long>, data binary")


def gram_topk(queries: DataFrame, corpus: DataFrame, k: int, text: str = "text", n: int = 3, block: int = 1024) -> DataFrame:
    """queries (qid, text) x corpus (cid, text) -> (qid, cid, score, rank) by cosine of n-gram counts.

    As in vector_topk, both sides lie in blocks, and k candidates of each query leave a
    pair of blocks: no pair of rows is shuffled, and a common n-gram is no hot key. Inside
    a pair of blocks, the counts of the n-grams that both have are multiplied as matrices.
    Only pairs that share an n-gram are scored.
    """
    q, c = (_gram_blocks(df.filter(F.col(text).isNotNull()).select(F.col(i).alias("id"), sim.grams(F.col(text), n).alias("g")), block) for df, i in ((queries, "qid"), (corpus, "cid")))
    pairs = _met(q.select(*(F.col(x).alias(f"q_{x}") for x in q.columns)), c)
    qid, cid = (df.schema[i].dataType.simpleString() for df, i in ((queries, "qid"), (corpus, "cid")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, c_ids = batch.column(0)[i].values, batch.column(5)[i].values
                dots = np.zeros((len(q_ids), len(c_ids)))
                left, right = (batch.column(j)[i].values for j in (1, 6))
                there = pc.index_in(left, value_set=right)
                both = np.flatnonzero(there.is_valid().to_numpy(zero_copy_only=False))
                there = there.take(pa.array(both)).to_numpy()
                a, b = (_Counts(batch, i, j) for j in (2, 7))
                for at in range(0, len(both), GRAMS):
                    dots += a.dense(both[at : at + GRAMS], len(q_ids)).T @ b.dense(there[at : at + GRAMS], len(c_ids))
                scores = np.where(dots > 0, np.round(dots / (a.size(len(q_ids))[:, None] * b.size(len(c_ids))[None]), DIGITS), -np.inf)
                # The columns are in the order of their ids.
                row, at = _leaders(scores, np.arange(len(c_ids)), k)
                keep = np.isfinite(scores[row, at])
                row, at = row[keep], at[keep]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), c_ids.take(pa.array(at)), pa.array(scores[row, at])], ["qid", "cid", "score"])

    return ranked(pairs.mapInArrow(best, f"qid {qid}, cid {cid}, score double"), k, "qid", ties=["cid"])


class _Counts:
    """Postings (n-gram, row, count) of a block, sorted by n-gram."""

    def __init__(self, batch: pa.RecordBatch, i: int, j: int):
        self.end, self.row, self.times = (np.frombuffer(batch.column(j + x)[i].as_buffer(), t) for x, t in enumerate((np.int64, np.int32, np.float64)))

    def dense(self, grams: np.ndarray, rows: int) -> np.ndarray:
        """grams x rows."""
        start = np.where(grams > 0, self.end[grams - 1], 0)
        count = self.end[grams] - start
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        out = np.zeros((len(grams), rows))
        out[np.repeat(np.arange(len(grams)), count), self.row[at]] = self.times[at]
        return out

    def size(self, rows: int) -> np.ndarray:
        return np.sqrt(np.bincount(self.row, weights=self.times * self.times, minlength=rows))


def _gram_blocks(grams: DataFrame, block: int) -> DataFrame:
    """(id, g) -> blocks (ids, grams, end, row, times): sorted ids, distinct n-grams, and postings."""
    kind = grams.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                part = part.filter(part.column(1).is_valid())
                if not part.num_rows:
                    continue
                part = part.take(pc.sort_indices(part.column(0)))
                row = np.repeat(np.arange(part.num_rows, dtype=np.int32), pc.list_value_length(part.column(1)).to_numpy())
                coded = part.column(1).flatten().dictionary_encode()
                cell, times = np.unique(coded.indices.to_numpy().astype(np.int64) * part.num_rows + row, return_counts=True)
                gram, row = cell // part.num_rows, (cell % part.num_rows).astype(np.int32)
                end = np.cumsum(np.bincount(gram, minlength=len(coded.dictionary)))
                ids, names = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), coded.dictionary))
                yield pa.RecordBatch.from_arrays([ids, names, *(pa.array([x.tobytes()], pa.binary()) for x in (end, row, times.astype(np.float64)))], ["ids", "grams", "end", "row", "times"])

    return grams.mapInArrow(pack, f"ids array<{kind}>, grams array<string>, end binary, row binary, times binary")


def token_topk(queries: DataFrame, corpus: DataFrame, k: int, at_least: float, block: int = 1024) -> DataFrame:
    """queries (qid, text) x corpus (cid, text) by token-sort ratio of at least at_least.

    Both sides lie in blocks. Of a pair of blocks, only those rows meet whose letters, each
    as often as both have it, are enough for the ratio; these alone are compared in full.
    """
    q = queries.select("qid", sim.sorted_tokens(F.col("text")).alias("a"))
    c = corpus.select("cid", sim.sorted_tokens(F.col("text")).alias("b"))
    left, right = _text_blocks(q.select(F.col("qid").alias("id"), F.col("a").alias("t")), block), _text_blocks(c.select(F.col("cid").alias("id"), F.col("b").alias("t")), block)
    pairs = left.select(F.col("ids").alias("q_ids"), F.col("texts").alias("q_texts"))
    pairs = _met(pairs, right)
    qid, cid = (df.schema[i].dataType.simpleString() for df, i in ((queries, "qid"), (corpus, "cid")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, a, c_ids, b = (batch.column(j)[i].values for j in range(4))
                row, at = np.nonzero(_letter_bound(a, b) >= at_least - 1e-9)
                row, at = pa.array(row), pa.array(at)
                yield pa.RecordBatch.from_arrays([q_ids.take(row), a.take(row), c_ids.take(at), b.take(at)], ["qid", "a", "cid", "b"])

    a, b = F.col("a"), F.col("b")
    close = pairs.mapInArrow(near, f"qid {qid}, a string, cid {cid}, b string").withColumn("masks", sim.letter_masks(b))
    scored = close.withColumn("score", F.round(sim.indel_ratio(sim.lcs(a, b, F.col("masks")), a, b), DIGITS)).filter(F.col("score") >= at_least)
    return ranked(scored.select("qid", "cid", "score"), k, "qid", ties=["cid"])


def _text_blocks(texts: DataFrame, block: int) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                part = part.filter(part.column(1).is_valid())
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x) for x in part.columns], ["ids", "texts"])

    return texts.mapInArrow(pack, f"ids array<{kind}>, texts array<string>")


def _letter_bound(a: pa.Array, b: pa.Array) -> np.ndarray:
    """a x b: 200 * letters in common, each as often as both have it, by both lengths; no indel ratio is above it."""
    points = [[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in x.to_pylist()] for x in (a, b)]
    letters = np.unique(np.concatenate([p for x in points for p in x] or [np.zeros(0, np.uint32)]))
    counts = [np.array([np.bincount(np.searchsorted(letters, p), minlength=len(letters)) for p in x], np.int32).reshape(len(x), -1) for x in points]
    both = np.add.outer(*(np.array([len(p) for p in x], np.int64) for x in points))
    common = np.zeros(both.shape, np.int64)
    for letter in range(len(letters)):
        common += np.minimum.outer(counts[0][:, letter], counts[1][:, letter])
    return np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)


def match_level(results: DataFrame, truth: DataFrame, query: str = "qid", fold: bool = True) -> DataFrame:
    """(query, level): the first rank whose label is the query's truth, else 99. truth: (query, curated)."""
    same = (tx.key(F.col("label")) == tx.key(F.col("curated"))) if fold else (F.col("label") == F.col("curated"))
    levels = truth.join(results.select(query, "label", "rank"), query, "left").groupBy(query).agg(F.min(F.when(same, F.col("rank"))).alias("r"))
    return levels.select(query, F.coalesce("r", F.lit(MISS)).cast("bigint").alias("match_level"))


def wide(results: DataFrame, k: int, query: str = "qid", extra: list[str] | None = None) -> DataFrame:
    """match1 … matchk with their scores as text, missing ranks null with score 0.0000; one aggregation."""
    out = []
    for i in range(1, k + 1):
        at = F.col("rank") == i
        out += [F.max(F.when(at, F.col("label"))).alias(f"match{i}"), F.coalesce(F.max(F.when(at, tx.score_text(F.round("score", 4)))), F.lit("0.0000")).alias(f"match{i}_score")]
    return results.groupBy(query, *(extra or [])).agg(*out)


def padded(results: DataFrame, queries: DataFrame, k: int, query: str = "qid") -> DataFrame:
    """Every query with all ranks 1..k; missing ones have null labels and score 0."""
    grid = queries.select(query).distinct().select(query, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rank"))
    return grid.join(results.select(query, "rank", "label", "score"), [query, "rank"], "left").select(query, "rank", "label", F.coalesce("score", F.lit(0.0)).alias("score"))


def rerank(candidates: DataFrame, scorer: Column, k: int, query: str = "qid") -> DataFrame:
    """Candidates (query, label, score, …) by another score; both are kept."""
    scored = candidates.drop("rank").withColumnRenamed("score", "similarity_score").withColumn("score", F.round(scorer, DIGITS))
    return ranked(scored, k, query)


def token_overlap(query: Column, text: Column) -> Column:
    """The built-in reranker's score: Jaccard similarity of the tokens."""
    return sim.jaccard(F.array_distinct(tx.tokens(query)), F.array_distinct(tx.tokens(text)))
