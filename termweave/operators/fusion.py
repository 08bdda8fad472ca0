"""Merging ranked candidates of several stages. All inputs are long: (qid, rank, label, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .topk import MISS, ranked

RRF = 60
BOOST_BELOW = 0.9


def not_obsolete(label: str = "label"):
    return ~F.lower(F.trim(F.col(label))).startswith("obsolete_")


def low_confidence(results: DataFrame, below: float, queries: DataFrame | None = None) -> DataFrame:
    """(qid, top) of the queries whose best score, to four digits, is below; null counts as 0.

    queries (qid, …): all that were asked, so that those without a result are among them, with 0.
    """
    top = results.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("rank") == 1, F.round("score", 4))), F.lit(0.0)).alias("top"))
    if queries is not None:
        top = queries.select("qid").distinct().join(top, "qid", "left").select("qid", F.coalesce("top", F.lit(0.0)).alias("top"))
    return top.filter(F.col("top") < below)


def max_merge(k: int, *lists: DataFrame) -> DataFrame:
    """The greatest score of each label over all lists; for equal scores the earlier list, then rank."""
    parts = [df.filter(F.col("label").isNotNull() & (F.col("label") != "")).select("qid", "label", "score", F.lit(i).alias("part"), "rank") for i, df in enumerate(lists)]
    all_ = reduce(DataFrame.unionByName, parts)
    best = all_.groupBy("qid", "label").agg(F.max("score").alias("score"), F.min(F.struct("part", "rank")).alias("first"))
    return ranked(best, k, "qid", ties=["first", "label"]).select("qid", "rank", "label", "score")


def synonym_boost(stage2: DataFrame, synonyms: DataFrame, k: int, truth: DataFrame | None = None, below: float = BOOST_BELOW, filter_obsolete: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """(qid, rank, label, score, stage): low-confidence queries take the merge with their synonyms' labels if it is better.

    Better is a higher top score, or, with truth (qid, curated), a lower match level.
    queries (qid, …): all that were asked, if some have no row in stage2.
    """
    low = low_confidence(stage2, below, queries)
    syn = synonyms.join(low, "qid", "left_semi")
    if filter_obsolete:
        syn = syn.filter(not_obsolete())
    old = stage2.join(low, "qid", "left_semi")
    merged = max_merge(k, old, syn)
    has = syn.select("qid").distinct()
    tops = merged.filter("rank = 1").select("qid", F.col("score").alias("new")).join(low, "qid").join(has, "qid", "left_semi")
    better = F.col("new") > F.col("top")
    if truth is not None:
        from .topk import match_level

        levels = match_level(merged, truth).withColumnRenamed("match_level", "l_new").join(match_level(old, truth).withColumnRenamed("match_level", "l_old"), "qid")
        tops = tops.join(levels, "qid", "left")
        better = better | F.coalesce(F.col("l_new") < F.col("l_old"), F.lit(False))
    boosted = tops.filter(better).select("qid")
    kept = stage2.join(boosted, "qid", "left_anti").select("qid", "rank", "label", "score", F.lit(2.0).cast("double").alias("stage"))
    return kept.unionByName(merged.join(boosted, "qid", "left_semi").withColumn("stage", F.lit(2.5).cast("double")))


def reciprocal_ranks(stage2: DataFrame, stage3: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion for the queries of stage3; the score shown is stage 2's, else stage 3's."""
    here = stage3.select("qid").distinct()
    parts = stage2.join(here, "qid", "left_semi").select("qid", "label", "rank", F.col("score").alias("s2"), F.lit(None).cast("double").alias("s3"))
    parts = parts.unionByName(stage3.select("qid", "label", "rank", F.lit(None).cast("double").alias("s2"), F.col("score").alias("s3")))
    fused = parts.filter(F.col("label").isNotNull()).groupBy("qid", "label").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("rrf"), F.max("s2").alias("s2"), F.max("s3").alias("s3"))
    out = ranked(fused, k, "qid", score="rrf")
    return out.select("qid", "rank", "label", F.coalesce("s2", "s3", F.lit(0.0)).alias("score"), "rrf", F.lit(3.5).cast("double").alias("stage"))


def merge_sources(k: int, results: DataFrame) -> DataFrame:
    """Results (query, source, label, score, ref_match) of several ontologies: the best score of each label, its source, and the first truth there is."""
    real = results.filter(F.col("label").isNotNull() & ~F.col("label").isin("", "N/A", "Not Found", "nan", "None"))
    best = real.groupBy("query", "label").agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), F.col("source"))).alias("source"))
    refs = results.filter("ref_match IS NOT NULL").groupBy("query").agg(F.min_by("ref_match", "source").alias("ref_match"))
    return ranked(best, k, "query").join(refs, "query", "left").select("query", "rank", "label", "score", "source", "ref_match")


def best_per_field(standard: DataFrame, alias: DataFrame, k: int) -> DataFrame:
    """Two lists (col, field, score, source): the best of each field, the standard's for equal scores; k of each column."""
    both = standard.select("col", "field", "score", "source", F.lit(0).alias("part")).unionByName(alias.select("col", "field", "score", "source", F.lit(1).alias("part")))
    one = Window.partitionBy("col", "field").orderBy(F.desc("score"), "part", "source")
    best = both.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r", "part")
    return ranked(best, k, "col", ties=["field"]).select("col", "rank", "field", "score", "source")


def replace_by_stage(results: DataFrame, rewritten: DataFrame, stage: float) -> DataFrame:
    """Results whose query has rewritten candidates (a first one that isn't N/A) take those."""
    good = rewritten.filter((F.col("rank") == 1) & F.col("label").isNotNull() & (F.col("label") != "N/A")).select("qid")
    new = rewritten.join(good, "qid", "left_semi").withColumn("stage", F.lit(stage).cast("double"))
    return results.join(good, "qid", "left_anti").unionByName(new.select(*results.columns))


def truth_levels(results: DataFrame, truths: DataFrame) -> DataFrame:
    """(query, match_level) for truths (query, ref_match with | between several); case counts."""
    wanted = truths.groupBy("query").agg(F.array_sort(F.collect_set("ref_match")).alias("t")).select("query", F.array_distinct(F.flatten(F.transform("t", tx.pipe_set))).alias("truths"))
    found = wanted.join(results.select("query", "rank", "label"), "query", "left").groupBy("query").agg(F.min(F.when(F.array_contains("truths", F.trim("label")), F.col("rank"))).alias("r"))
    return found.select("query", F.coalesce("r", F.lit(MISS)).cast("bigint").alias("match_level"))


def override_levels(levels: DataFrame, results: DataFrame, truths: DataFrame, in_truth, in_label) -> DataFrame:
    """Misses (99) whose truth is of a family take the first rank with a label of it."""
    rank = results.filter(in_label(F.lower(F.trim("label")))).groupBy("query").agg(F.min("rank").alias("family_rank"))
    of_family = truths.filter(F.exists(tx.pipe_set(F.col("ref_match")), lambda t: in_truth(F.lower(t)))).select("query").distinct().withColumn("of_family", F.lit(True))
    joined = levels.join(of_family, "query", "left").join(rank, "query", "left")
    hit = (F.col("match_level") == MISS) & F.col("of_family") & F.col("family_rank").isNotNull()
    return joined.select("query", F.when(hit, F.col("family_rank")).otherwise(F.col("match_level")).cast("bigint").alias("match_level"))


CANCER = ("cancer_type", "cancer_subtype", "cancer_type_details", "disease")


def cancer_override(levels: DataFrame, results: DataFrame, truths: DataFrame) -> DataFrame:
    return override_levels(levels, results, truths, lambda t: t.isin(*CANCER), lambda x: x.isin(*CANCER))


def treatment_override(levels: DataFrame, results: DataFrame, truths: DataFrame) -> DataFrame:
    return override_levels(levels, results, truths, lambda t: t.startswith("treatment_"), lambda x: x.startswith("treatment_"))
