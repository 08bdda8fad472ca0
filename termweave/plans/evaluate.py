"""How good results are: accuracy, confusion, F1, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

LEVELS = {"top5": (1, 3, 5), "rerank": (1, 5, 20, 30, 50)}


def accuracy_at(results: DataFrame, truths: DataFrame, levels: tuple[int, ...] = LEVELS["top5"]) -> DataFrame:
    """(k, accuracy): the percentage of truths (query, ref_match) among the first k labels; case counts."""
    hit = truths.join(results.select("query", "rank", "label"), "query", "left").groupBy("query", "ref_match").agg(F.min(F.when(F.col("label") == F.col("ref_match"), F.col("rank"))).alias("r"))
    share = lambda k: F.round(F.avg(F.coalesce((F.col("r") <= k).cast("int"), F.lit(0))) * 100, 6)
    one = hit.agg(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), share(k).alias("accuracy")) for k in levels)).alias("a"))
    return one.select(F.inline("a"))


def accuracy_by_level(rows: DataFrame, levels: tuple[int, ...] = (1, 3, 5), by: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Shares of rows (match_level, ref_match, method) at each level or better, of rows that have a truth."""
    rows = rows.filter("ref_match IS NOT NULL AND trim(ref_match) <> ''")
    rows = rows.filter(F.col("method").isin(include)) if include else rows
    rows = rows.filter(~F.col("method").isin(exclude)) if exclude else rows
    shares = [F.round(F.avg((F.col("match_level") <= k).cast("int")), 6).alias(f"acc_at_{k}") for k in levels]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *shares)


def crosstab(rows: DataFrame, truth: str = "ref_match", found: str = "label") -> DataFrame:
    """(truth, found, n): the confusion matrix, long."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count("*").alias("n"))


def macro_f1(matrix: DataFrame) -> DataFrame:
    """One row: the mean F1 over the classes that have one, by their own names."""
    tp = matrix.filter("truth = found").select(F.col("truth").alias("c"), F.col("n").alias("tp"))
    t = matrix.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t"))
    f = matrix.groupBy(F.col("found").alias("c")).agg(F.sum("n").alias("f"))
    per = t.join(f, "c").join(tp, "c", "left")
    score = F.when(F.coalesce("tp", F.lit(0)) > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("f")))
    return per.agg(F.round(F.avg(score), 6).alias("macro_f1"), F.count("*").alias("classes"))


def mcnemar_counts(a: DataFrame, b: DataFrame, truths: DataFrame, levels: tuple[int, ...] = LEVELS["top5"]) -> DataFrame:
    """(k, b, c): truths that only a has within k, and that only b has."""

    def ranks(df: DataFrame, name: str) -> DataFrame:
        return df.join(truths, "query").filter(F.col("label") == F.col("ref_match")).groupBy("query", "ref_match").agg(F.min("rank").alias(name))

    both = truths.select("query", "ref_match").distinct().join(ranks(a, "ra"), ["query", "ref_match"], "left").join(ranks(b, "rb"), ["query", "ref_match"], "left")
    ok = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    n = lambda test: F.sum(test.cast("bigint"))
    one = both.agg(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.coalesce(n(ok("ra", k) & ~ok("rb", k)), F.lit(0)).alias("b"), F.coalesce(n(~ok("ra", k) & ok("rb", k)), F.lit(0)).alias("c")) for k in levels)).alias("a"))
    return one.select(F.inline("a"))


def mcnemar(b: int, c: int) -> tuple[float, float, str]:
    """(statistic, p, method): exact below 25 discordant pairs, else chi-squared with continuity correction."""
    n = b + c
    if not n:
        return math.nan, math.nan, "no discordant pairs"
    if n < 25:
        tail = sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n
        return float(min(b, c)), min(1.0, 2 * tail), "exact binomial"
    stat = (abs(b - c) - 1) ** 2 / n
    return round(stat, 4), round(math.erfc(math.sqrt(stat / 2)), 6), "chi-squared"


def bin_of(score: Column, edges: list[float]) -> Column:
    """The bin (low, high] of a score as text, null outside."""
    out = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:]):
        out = F.when((score > low) & (score <= high), F.lit(f"({low}, {high}]")).otherwise(out)
    return out


def mismatches_by_score(rows: DataFrame, edges: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """(bin, mismatches) of rows (ref_match, label, score)."""
    wrong = rows.filter(~F.col("ref_match").eqNullSafe(F.col(label)))
    return wrong.groupBy(bin_of(F.col(score), edges).alias("bin")).agg(F.count("*").alias("mismatches")).filter("bin IS NOT NULL")


def comparison(rows: DataFrame, index: str, columns: str, names: list, value: str) -> DataFrame:
    """A table of values by two keys; the columns are given, so that no job looks for them."""
    return rows.groupBy(index).pivot(columns, names).agg(F.first(value))


def match_rate(rows: DataFrame) -> DataFrame:
    """(n, found, rate) of rows with match_found."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("match_found").cast("bigint")).alias("found"), F.round(F.avg(F.col("match_found").cast("int")), 6).alias("rate"))


def missing_terms(truths: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, n): truths that no label of the corpus (label) equals, whatever the case."""
    known = corpus.select(tx.key(F.col("label")).alias("k")).distinct()
    return truths.filter("ref_match IS NOT NULL").join(known, tx.key(F.col("ref_match")) == F.col("k"), "left_anti").groupBy(F.col("ref_match").alias("term")).agg(F.count("*").alias("n"))
