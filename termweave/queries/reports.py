"""Queries of evaluations, clusters and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clustering, fusion, topk
from ..operators.callables import rematch_rows
from ..operators.encoders import HashedGrams
from ..plans import evaluate, suggest
from ..sources.tables import to_cells
from ..storage import written
from .cascade import cells
from .common import LABELS, QUERIES as ASKED, gram_pairs, labels, queries, sparse, table
from .match import K, _HALVES, _halves, ngram_topk

_GRAMS = f"""{LABELS}, {ASKED}, q0 AS (SELECT qid, lower(text) AS text FROM queries), c0 AS (SELECT code AS cid, lower(label) AS text FROM labels),
{sparse('q', 'q0', 'qid')}, {sparse('c', 'c0', 'cid')}, {gram_pairs('q', 'c', 'h0', K)}, h AS (SELECT qid AS query, rank, label, score FROM h0 JOIN labels ON code = cid), t AS (SELECT qid AS query, curated AS ref_match FROM queries)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(results (query, rank, label, score), truths (query, ref_match)) of the n-gram search."""
    hits = ngram_topk(spark, sf_dir).join(labels(spark, sf_dir).withColumnRenamed("code", "cid"), "cid")
    return hits.select(F.col("qid").alias("query"), "rank", "label", "score"), queries(spark, sf_dir).select(F.col("qid").alias("query"), F.col("curated").alias("ref_match"))


def accuracy_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_at(*_found(spark, sf_dir))


ACCURACY_AT = f"""WITH {_GRAMS}, r AS (SELECT t.query, min(CASE WHEN label = ref_match THEN rank END) AS r FROM t LEFT JOIN h USING (query) GROUP BY t.query)
SELECT k::BIGINT AS k, round(avg(CASE WHEN r <= k THEN 1 ELSE 0 END) * 100, 6) AS accuracy FROM r, (VALUES (1), (3), (5)) v(k) GROUP BY k"""


def accuracy_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the way in which the names are written, but for exact ones."""
    results, truths = _found(spark, sf_dir)
    levels = topk.match_level(results, truths.withColumnRenamed("ref_match", "curated"), "query")
    method = F.format_string("way%d", F.col("query") % 6)
    rows = truths.join(levels, "query").withColumn("method", method)
    return evaluate.accuracy_by_level(rows, by=["method"], exclude=["way0"])


ACCURACY_BY_LEVEL = f"""WITH {_GRAMS}, l AS (SELECT t.query, coalesce(min(CASE WHEN lower(trim(label)) = lower(trim(ref_match)) THEN rank END), 99) AS l FROM t LEFT JOIN h USING (query) GROUP BY t.query)
SELECT 'way' || (query % 6)::VARCHAR AS method, count(*) AS n, {', '.join(f'round(avg((l <= {k})::INT), 6) AS acc_at_{k}' for k in (1, 3, 5))} FROM l WHERE query % 6 <> 0 GROUP BY 1"""


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a guess that is wrong for a third of the documents."""
    return evaluate.crosstab(_classes(spark, sf_dir))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.select(F.col("quality").cast("string").alias("ref_match"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).otherwise(F.col("quality")).cast("string").alias("label"))


_CLASSES = "m AS (SELECT quality::VARCHAR AS truth, CASE WHEN doc_id % 3 = 0 THEN toxic ELSE quality END::VARCHAR AS found, count(*) AS n FROM labels GROUP BY ALL)"
CONFUSION_MATRIX = f"WITH {_CLASSES} SELECT * FROM m"


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(evaluate.crosstab(_classes(spark, sf_dir)))


MACRO_F1 = f"""WITH {_CLASSES}, t AS (SELECT truth AS c, sum(n) AS t FROM m GROUP BY 1), f AS (SELECT found AS c, sum(n) AS f FROM m GROUP BY 1), tp AS (SELECT truth AS c, n AS tp FROM m WHERE truth = found)
SELECT round(avg(2.0::DOUBLE * tp / (t + f)), 6) AS macro_f1, count(*) AS classes FROM t JOIN f USING (c) LEFT JOIN tp USING (c)"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two searches of the vectors, their hits named by class; the truth is a query's own class."""
    e = table(spark, sf_dir, "embeddings")
    names = e.select(F.col("vec_id").cast("string").alias("label"), F.col("label").cast("string").alias("class"))
    two = (h.join(names, "label").select(F.col("qid").alias("query"), "rank", F.col("class").alias("label"), "score") for h in _halves(spark, sf_dir))
    return *two, e.select(F.col("vec_id").alias("query"), F.col("label").cast("string").alias("ref_match"))


def _rank(name: str, source: str) -> str:
    return f"{name} AS (SELECT q.vec_id AS query, min(CASE WHEN c.label = q.label THEN rank END) AS r FROM embeddings q JOIN {source} ON qid = q.vec_id JOIN embeddings c ON c.vec_id::VARCHAR = {source}.label GROUP BY 1)"


def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mcnemar_counts(*_named(spark, sf_dir))


MCNEMAR_COUNTS = f"""WITH {_HALVES}, {_rank('a', 's2')}, {_rank('b', 's3')}
SELECT k::BIGINT AS k, count(*) FILTER (coalesce(a.r, 99) <= k AND coalesce(b.r, 99) > k) AS b, count(*) FILTER (coalesce(a.r, 99) > k AND coalesce(b.r, 99) <= k) AS c
FROM a JOIN b USING (query), (VALUES (1), (3), (5)) v(k) GROUP BY k"""


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second hits, whose names are wrong for nearly all."""
    results, truths = _found(spark, sf_dir)
    return evaluate.mismatches_by_score(results.filter("rank = 2").join(truths, "query"), [0.0, 0.25, 0.5, 0.75, 1.0])


SCORE_BINS = f"""WITH {_GRAMS} SELECT CASE WHEN score <= 0.25 THEN '(0.0, 0.25]' WHEN score <= 0.5 THEN '(0.25, 0.5]' WHEN score <= 0.75 THEN '(0.5, 0.75]' ELSE '(0.75, 1.0]' END AS bin, count(*) AS mismatches
FROM h JOIN t USING (query) WHERE rank = 2 AND label IS DISTINCT FROM ref_match AND score > 0 AND score <= 1 GROUP BY 1"""


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many first hits there are by way of writing and score, a column for each score."""
    results, _ = _found(spark, sf_dir)
    rows = results.filter("rank = 1").groupBy((F.col("query") % 6).alias("way"), F.when(F.col("score") >= 0.999, "same").when(F.col("score") >= 0.5, "near").otherwise("far").alias("how")).agg(F.count("*").alias("n"))
    return evaluate.comparison(rows, "way", "how", ["same", "near", "far"], "n")


COMPARISON_TABLE = f"""WITH {_GRAMS}, r AS (SELECT query % 6 AS way, CASE WHEN score >= 0.999 THEN 'same' WHEN score >= 0.5 THEN 'near' ELSE 'far' END AS how FROM h WHERE rank = 1)
SELECT way, {', '.join(f"nullif(count(*) FILTER (how = '{x}'), 0) AS {x}" for x in ('same', 'near', 'far'))} FROM r GROUP BY way"""


def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select(F.col("text").alias("ref_match"))
    return evaluate.missing_terms(asked, labels(spark, sf_dir))


MISSING_TERMS = f"WITH {LABELS}, {ASKED} SELECT text AS term, count(*) AS n FROM queries WHERE lower(trim(text)) NOT IN (SELECT lower(trim(label)) FROM labels) GROUP BY 1"


def truth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field matches with several truths, and both overrides: part types as fields, brands as columns."""
    results, truths = _fields(spark, sf_dir)
    levels = fusion.truth_levels(results, truths)
    return fusion.treatment_override(fusion.cancer_override(levels, results, truths), results, truths)


_FIELDS = ("disease", "treatment_dose", "age", "cancer_type", "treatment_name", "sex")


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    field = lambda n: F.element_at(F.array(*(F.lit(f) for f in _FIELDS)), (n % 6 + 1).cast("int"))
    results = p.select(F.col("p_partkey").alias("query"), F.posexplode(F.array(field(F.col("p_partkey")), field(F.col("p_size")), field(F.col("p_partkey") + F.col("p_size")))).alias("rank", "label")).withColumn("rank", (F.col("rank") + 1).cast("bigint"))
    return results, p.select(F.col("p_partkey").alias("query"), F.concat_ws("|", field(F.col("p_size") + 2), F.when(F.col("p_size") % 2 == 0, field(F.col("p_partkey") + 3))).alias("ref_match"))


_F = "([" + ", ".join(f"'{f}'" for f in _FIELDS) + "])[({}) % 6 + 1]"
_CANCER = ", ".join(f"'{c}'" for c in fusion.CANCER)
TRUTH_LEVELS = f"""WITH r AS (SELECT p_partkey AS query, [{_F.format('p_partkey')}, {_F.format('p_size')}, {_F.format('p_partkey + p_size')}] AS l, list_distinct([{_F.format('p_size + 2')}, CASE WHEN p_size % 2 = 0 THEN {_F.format('p_partkey + 3')} END]) AS t FROM part),
x AS (SELECT query, t, unnest(l) AS label, generate_subscripts(l, 1) AS rank FROM r),
y AS (SELECT query, coalesce(min(CASE WHEN list_contains(t, label) THEN rank END), 99) AS level, min(CASE WHEN label IN ({_CANCER}) THEN rank END) AS c, min(CASE WHEN starts_with(label, 'treatment_') THEN rank END) AS m,
  bool_or(len(list_filter(t, lambda z: z IN ({_CANCER}))) > 0) AS tc, bool_or(len(list_filter(t, lambda z: starts_with(z, 'treatment_'))) > 0) AS tm FROM x GROUP BY query)
SELECT query, (CASE WHEN level < 99 THEN level WHEN tc AND c IS NOT NULL THEN c WHEN tm AND m IS NOT NULL THEN m ELSE 99 END)::BIGINT AS match_level FROM y"""


def rematch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part names whose first hit is weak, as rows that a model should see again."""
    results, _ = _found(spark, sf_dir)
    rows = results.filter("rank = 1").select("query", F.when(F.col("query") % 2 == 0, "stage3").otherwise("stage2").alias("stage"), F.when(F.col("query") % 10 != 0, tx.score_text(F.col("score"))).alias("match1_score"))
    return rematch_rows(rows, 0.8, ["stage3"]).select("query", "stage")


REMATCH_FILTER = f"WITH {_GRAMS} SELECT query, 'stage3' AS stage FROM h WHERE rank = 1 AND query % 2 = 0 AND (query % 10 = 0 OR printf('%.4f', score)::DOUBLE < 0.8)"


def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid distances of part names, each with the vector of its least key's number."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code"), "embedding")
    items = labels(spark, sf_dir).select(F.col("label").alias("name"), "code").join(e, "code").select("name", "embedding")
    return clustering.pair_distances(items)


_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[-_.:]', ' ', 'g'), '\\s+'), lambda t: t <> ''))"
PAIR_DISTANCES = f"""WITH {LABELS}, i AS (SELECT labels.label AS name, embedding::DOUBLE[] AS e, {_TOK.format('labels.label')} AS t, regexp_replace(lower(labels.label), '[_ ]', '', 'g') AS w FROM labels JOIN embeddings ON vec_id = code)
SELECT x.name AS a, y.name AS b, round(0.6 * (1 - list_cosine_similarity(x.e, y.e)) / 2 + 0.2 * (1 - len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(list_concat(x.t, y.t)))) + 0.1 * levenshtein(x.w, y.w)::DOUBLE / greatest(length(x.w), length(y.w))
  + 0.1 * (1 - len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t))), 9) AS distance FROM i x, i y WHERE x.name < y.name"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("name"), "embedding")


def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.coherence(_members(spark, sf_dir)).withColumnRenamed("scs", "pairs").join(clustering.centroid_coherence(_members(spark, sf_dir)).select("cluster", F.col("scs").alias("centroid")), "cluster")
    return found.select("cluster", "n", F.round("pairs", 6).alias("pairs"), F.round("centroid", 6).alias("centroid"))


COHERENCE = """WITH e AS (SELECT label AS cluster, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.cluster, avg(list_cosine_similarity(a.e, b.e)) AS m FROM e a JOIN e b ON a.cluster = b.cluster AND a.vec_id < b.vec_id GROUP BY 1),
u AS (SELECT cluster, unnest(range(1, len(e) + 1)) AS d, unnest(e) / sqrt(list_dot_product(e, e)) AS x FROM e), s AS (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM u GROUP BY ALL), c AS (SELECT cluster, max(n) AS n, sqrt(sum(s * s)) / max(n) AS m FROM s GROUP BY 1)
SELECT cluster, n, round((p.m + 1) / 2, 6) AS pairs, round((c.m + 1) / 2, 6) AS centroid FROM c JOIN p USING (cluster)"""


def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with some values, for the encoder."""
    from .votes import cells

    c = cells(spark, sf_dir)
    return suggest.described(c.select("col").distinct(), c)


def _described() -> str:
    from .votes import CELLS, NUMERIC_COLUMNS

    return f"""WITH {CELLS}, num AS ({NUMERIC_COLUMNS}), v AS (SELECT DISTINCT col, substring(cell, 1, 30) AS v FROM cells WHERE cell IS NOT NULL AND col NOT IN (SELECT col FROM num WHERE is_numeric)),
l AS (SELECT col, string_agg(v, ', ' ORDER BY v) AS vs FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY col ORDER BY v) <= 5) GROUP BY col)
SELECT col, replace(col, '_', ' ') || coalesce(': ' || vs, '') AS text FROM (SELECT DISTINCT col FROM cells) LEFT JOIN l USING (col)"""


def suggested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New fields for the columns of all tables but the vectors, from their names and values; samples of values as JSON."""
    every = cells(spark, sf_dir)
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        every = every.unionByName(to_cells(table(spark, sf_dir, name)))
    every = written(every.filter("cell IS NOT NULL").groupBy("col", "cell").agg(F.min("row_id").alias("row_id")))  # each value once, where it is first
    found = suggest.suggest(every.select("col").distinct(), HashedGrams(), every, config=clustering.ClusterConfig(threshold=0.8, hybrid=True), split=True, samples=5)
    return found.withColumn("sample_values", F.to_json("sample_values"))


QUERIES = {
    "accuracy_at": (accuracy_at, ACCURACY_AT),
    "accuracy_by_level": (accuracy_by_level, ACCURACY_BY_LEVEL),
    "confusion_matrix": (confusion_matrix, CONFUSION_MATRIX),
    "macro_f1": (macro_f1, MACRO_F1),
    "mcnemar_counts": (mcnemar_counts, MCNEMAR_COUNTS),
    "score_bins": (score_bins, SCORE_BINS),
    "comparison_table": (comparison_table, COMPARISON_TABLE),
    "missing_terms": (missing_terms, MISSING_TERMS),
    "truth_levels": (truth_levels, TRUTH_LEVELS),
    "rematch_filter": (rematch_filter, REMATCH_FILTER),
    "pair_distances": (pair_distances, PAIR_DISTANCES),
    "coherence": (coherence, COHERENCE),
    "described_columns": (described_columns, _described()),
    "suggested_fields": (suggested_fields, ""),
}
