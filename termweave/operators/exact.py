"""Exact joins of queries, columns and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def exact_match(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries (qid, text) found in corpus (label, code) whatever their case: (qid, label, code)."""
    best = corpus.groupBy(tx.key(F.col("label")).alias("k")).agg(F.min_by("label", F.struct("code", "label")).alias("label"), F.min("code").alias("code"))
    return queries.join(best, tx.key(F.col("text")) == F.col("k")).select("qid", "label", "code")


def residual(queries: DataFrame, settled: DataFrame, on: str = "qid") -> DataFrame:
    """The queries that have no row in settled."""
    return queries.join(settled.select(on), on, "left_anti")


def expand_abbreviations(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries (qid, text) with updated: the name (code, name) of an abbreviation, else the trimmed text."""
    # one name for each key: that of the last code
    table = names.groupBy(tx.abbreviation(F.col("code")).alias("k")).agg(F.max_by("name", F.struct("code", "name")).alias("name"))
    return queries.join(table, tx.key(F.col("text")) == F.col("k"), "left").select("qid", "text", F.coalesce("name", F.trim("text")).alias("updated"))


def normalize_queries(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries (qid, text) with normed: American spelling, and singular where the corpus has that label."""
    plain = queries.withColumn("n", tx.american(F.col("text"))).withColumn("s", tx.singular(F.col("n")))
    known = corpus.select(tx.key(F.col("label")).alias("k")).distinct()
    return plain.join(known, F.lower("s") == F.col("k"), "left").select("qid", "text", F.when(F.col("k").isNotNull(), F.col("s")).otherwise(F.col("n")).alias("normed"))


def standard_exact(columns: DataFrame, schema: DataFrame) -> DataFrame:
    """columns (col) that name a field of schema (field_name, ord); of fields with one name the last."""
    fields = schema.groupBy(tx.normalize(F.col("field_name")).alias("k")).agg(F.max_by("field_name", "ord").alias("field"))
    return columns.join(fields, tx.normalize(F.col("col")) == F.col("k")).select("col", "field", F.lit(1.0).cast("double").alias("score"), F.lit("").alias("source"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """aliases (source, field_name, ord) -> (k, source, fields): the first spelling and the sorted fields of each alias."""
    named = aliases.filter(F.col("source").isNotNull() & (tx.normalize(F.col("source")) != ""))
    return named.groupBy(tx.normalize(F.col("source")).alias("k")).agg(F.min_by("source", F.struct("ord", "source")).alias("source"), F.array_sort(F.collect_set("field_name")).alias("fields"))


def alias_exact(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """columns (col) that are an alias, with each of its fields."""
    found = columns.join(alias_index(aliases), tx.normalize(F.col("col")) == F.col("k"))
    return found.select("col", F.explode("fields").alias("field"), F.lit(1.0).cast("double").alias("score"), "source")


def map_variants(rows: DataFrame, variants: DataFrame, column: str) -> DataFrame:
    """rows with matched_term and match_found from variants (variant, canonical)."""
    table = variants.groupBy(tx.key(F.col("variant")).alias("_k")).agg(F.max_by("canonical", F.struct("variant", "canonical")).alias("matched_term"))
    return rows.join(table, tx.key(F.col(column)) == F.col("_k"), "left").drop("_k").withColumn("match_found", F.col("matched_term").isNotNull())


def replace_rows(rows: DataFrame, better: DataFrame, on: str = "qid") -> DataFrame:
    """rows, where better has some of a key those instead."""
    return residual(rows, better, on).unionByName(better, allowMissingColumns=True)


def append_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key the table doesn't have, each key once: what an insert-or-ignore adds."""
    first = Window.partitionBy(*key).orderBy(*(F.col(c) for c in rows.columns))
    once = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return once.join(table.select(*key), key, "left_anti").select(*rows.columns)


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts to n before the shuffle."""
    at = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")
