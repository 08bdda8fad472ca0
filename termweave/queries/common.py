"""What the queries share: inputs made from the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: part names, each with its least key as code."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("code"))


def mutated() -> F.Column:
    """Six ways in which a name is written."""
    n, way = F.col("p_name"), F.col("p_partkey") % 6
    return (
        F.when(way == 0, n)
        .when(way == 1, F.upper(n))
        .when(way == 2, F.regexp_replace(n, " ", "_"))
        .when(way == 3, F.array_join(F.reverse(F.split(n, " ")), " "))
        .when(way == 4, F.concat(n, F.lit("s")))
        .otherwise(F.substring(n, F.lit(1), F.length(n) - 1))
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text, curated): every part, its name written in one of six ways."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), mutated().alias("text"), F.col("p_name").alias("curated"))


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({c}, '[^a-zA-Z0-9]', ' ', 'g')), '\\s+', ' ', 'g'))"


def american(c: str) -> str:
    from ..functions.text import AMERICAN

    c = f"regexp_replace({c}, '_', ' ', 'g')"
    for a, b in AMERICAN.items():
        c = f"regexp_replace({c}, '{a}', '{b}', 'gi')"
    return f"trim({c})"


LABELS = "labels AS (SELECT p_name AS label, min(p_partkey) AS code FROM part GROUP BY p_name)"
QUERIES = """queries AS (SELECT p_partkey AS qid, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '_')
  WHEN 3 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN 4 THEN p_name || 's' ELSE left(p_name, length(p_name) - 1) END AS text, p_name AS curated FROM part)"""


def sparse(name: str, source: str, id_: str, n: int = 3) -> str:
    """CTEs of n-gram counts of source (id_, text): {name}(id_, gram, w) and {name}_s(id_, s)."""
    return f"""{name}_g AS (SELECT {id_}, unnest(list_transform(range(1, greatest(1, length(t) - {n - 1}) + 1), lambda i: substring(t, i, {n}))) AS gram FROM (SELECT {id_}, ' ' || text || ' ' AS t FROM {source})),
{name} AS (SELECT {id_}, gram, count(*)::DOUBLE AS w FROM {name}_g GROUP BY ALL),
{name}_s AS (SELECT {id_}, sum(w * w) AS s FROM {name} GROUP BY {id_})"""


def gram_pairs(q: str, c: str, out: str, k: int | None = None, ties: str = "cid") -> str:
    """CTE out(qid, cid, score, rank) of n-gram cosines between sparse(q, …, 'qid') and sparse(c, …, 'cid')."""
    return f"""{out}_a AS (SELECT qid, cid, round(d / (sqrt(s1.s) * sqrt(s2.s)), 6) AS score FROM (SELECT {q}.qid, {c}.cid, sum({q}.w * {c}.w) AS d FROM {q} JOIN {c} USING (gram) GROUP BY ALL) JOIN {q}_s s1 USING (qid) JOIN {c}_s s2 USING (cid)),
{out} AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {ties}) AS rank FROM {out}_a {f'QUALIFY rank <= {k}' if k else ''})"""


def indel_ratio(a: str, b: str) -> str:
    """Indel ratio of two texts, by the table of common-subsequence lengths."""
    cell = f"CASE WHEN unicode(substring({b}, j[1], 1)) = x[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], list_last(row)) END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: [k]), lambda row, j: list_append(row, {cell}), [0])"
    table = f"list_reduce(list_transform(string_split({a}, ''), lambda x: [unicode(x)]), lambda above, x: {row}, list_transform(range(0, length({b}) + 1), lambda i: 0))"
    return f"(200.0::DOUBLE * list_last({table}) / (length({a}) + length({b})))"


def sorted_tokens(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex(trim({c}), '\\s+'), lambda t: t <> '')), ' ')"
