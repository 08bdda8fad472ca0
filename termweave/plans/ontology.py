"""Free-text values to ontology terms: a cascade in which each stage sees what the ones before left open.

Stages: 1 exact, 2 nearest labels, 2.5 with synonyms, 3 another retrieval (reranked;
3.5 fused with stage 2 by reciprocal ranks), 4 rewritten by a language model. Every
stage is a table (qid, rank, label, score, stage); a stage's input is cut off from the
plan before it where a Python encoder would run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exact, fusion, topk
from ..operators.encoders import Encoder
from ..sources.settings import Settings

Search = Callable[[DataFrame, int], DataFrame]
COLUMNS = ["qid", "rank", "label", "score", "stage"]


def gram_search(corpus: DataFrame, text: str = "label", label: str = "label", by: str = "code") -> Search:
    """Search of (qid, text) by n-gram cosine over corpus (label, code, …); ties go by the `by` column."""

    def search(queries: DataFrame, k: int) -> DataFrame:
        base = corpus.select(F.col(by).alias("cid"), F.lower(text).alias("text"), F.col(label).alias("label"))
        hits = topk.gram_topk(queries.select("qid", F.lower("text").alias("text")), base.select("cid", "text"), k)
        return hits.join(base.select("cid", "label"), "cid").select("qid", "rank", "label", "score")

    return search


def vector_search(corpus: DataFrame, encoder: Encoder, text: str = "label", label: str = "label") -> Search:
    """Search by an encoder's vectors; equal texts are encoded once."""

    def search(queries: DataFrame, k: int) -> DataFrame:
        base = corpus.select(F.col(text).alias("text"), F.col(label).alias("label")).distinct().withColumn("cid", F.xxhash64("text", "label"))
        asked = queries.select("text").distinct().withColumn("qid", F.xxhash64("text"))
        hits = topk.vector_topk(encoder.encode(asked, "text").select("qid", "embedding"), encoder.encode(base.select("cid", "text"), "text").select("cid", "embedding"), k)
        named = hits.join(base.select("cid", "label"), "cid").select(F.col("qid").alias("h"), "rank", "label", "score")
        return queries.select("qid", F.xxhash64("text").alias("h")).join(named, "h").select("qid", "rank", "label", "score")

    return search


@dataclass
class OntologyMapper:
    """corpus (label, code). search2 is needed; the others turn their stages on.

    synonyms searches original values, giving labels that may repeat; search3 with
    scorer (a column over query and label) reranks pool candidates; rewrite gives
    (qid, rank, label, score) for (qid, text).
    """

    corpus: DataFrame
    search2: Search
    synonyms: Search | None = None
    search3: Search | None = None
    scorer: Callable | None = None
    rewrite: Callable[[DataFrame], DataFrame] | None = None
    abbreviations: DataFrame | None = None
    settings: Settings = Settings()
    pool: int = 50
    fuse: bool = False
    use_truth_in_boost: bool = False
    cut: Callable[[DataFrame], DataFrame] = staticmethod(lambda df: df)

    def run(self, queries: DataFrame, truth: DataFrame | None = None) -> DataFrame:
        """(qid, rank, label, score, stage) for queries (qid, text)."""
        s, k = self.settings, self.settings.top_k
        first = exact.exact_match(queries, self.corpus).select("qid", F.lit(1).cast("bigint").alias("rank"), "label", F.lit(1.0).cast("double").alias("score"), F.lit(1.0).cast("double").alias("stage"))
        rest = exact.residual(queries, first)
        rest = self.cut(rest)
        normed = exact.normalize_queries(rest, self.corpus).select("qid", F.col("normed").alias("text"))
        if self.abbreviations is not None:
            normed = exact.expand_abbreviations(normed, self.abbreviations).select("qid", F.col("updated").alias("text"))
        normed = self.cut(normed)
        second = self.cut(self.search2(normed, k).withColumn("score", F.round("score", 4)))
        results = second.withColumn("stage", F.lit(2.0).cast("double")).select(*COLUMNS)
        if self.synonyms:
            low = fusion.low_confidence(second, s.synonym_below, normed)
            syn = self.synonyms(rest.join(low.select("qid"), "qid", "left_semi"), k).withColumn("score", F.round("score", 4))
            results = self.cut(fusion.synonym_boost(second, syn, k, truth if self.use_truth_in_boost else None, s.synonym_below, queries=normed).select(*COLUMNS))
        if self.search3:
            low = normed.join(fusion.low_confidence(results, s.s3_threshold, normed).select("qid"), "qid", "left_semi")
            third = self.search3(low, self.pool if self.scorer else k)
            if self.scorer:
                named = third.join(low.withColumnRenamed("text", "query"), "qid")
                third = topk.rerank(named, self.scorer(F.col("query"), F.col("label")), k)
            third = self.cut(third.select("qid", "rank", "label", F.round("score", 4).alias("score")))
            if self.fuse:
                better = fusion.reciprocal_ranks(results, third, k).select(*COLUMNS)
            else:
                better = third.withColumn("stage", F.lit(3.0).cast("double")).select(*COLUMNS)
            results = exact.replace_rows(results, better)
        if self.rewrite:
            low = rest.join(fusion.low_confidence(results, s.s4_threshold, rest).select("qid"), "qid", "left_semi")
            results = fusion.replace_by_stage(results, self.cut(self.rewrite(low)), 4.0)
        return first.unionByName(results)


def finished(results: DataFrame, queries: DataFrame, truth: DataFrame | None, k: int) -> DataFrame:
    """The wide view: query, ref_match, match_level, stage, match1, match1_score, …; a query without a result has no stage and no match."""
    view = queries.select("qid", F.col("text").alias("query")).join(topk.wide(results, k, extra=["stage"]), "qid", "left")
    view = view.withColumns({f"match{i}_score": F.coalesce(f"match{i}_score", F.lit("0.0000")) for i in range(1, k + 1)})
    if truth is not None:
        view = view.join(truth.select("qid", F.col("curated").alias("ref_match")), "qid", "left").join(topk.match_level(results, truth), "qid", "left")
    return view.drop("qid")


def stage_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(F.countDistinct("qid").alias("queries"))
