"""Queries of the joins, rankings and fusions, and of the ontology cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import exact, fusion, topk
from ..plans import ontology
from ..sources.settings import Settings
from ..storage import written
from .common import LABELS, QUERIES as ASKED, american, gram_pairs, indel_ratio, labels, norm, queries, sorted_tokens, sparse, table

K = 5


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_match(queries(spark, sf_dir), labels(spark, sf_dir))


EXACT_MATCH = f"WITH {LABELS}, {ASKED} SELECT qid, label, code FROM queries JOIN labels ON lower(trim(text)) = lower(trim(label))"


def residual_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    return exact.residual(q, exact_match(spark, sf_dir)).select("qid", "text")


RESIDUAL_ANTI = f"WITH {LABELS}, {ASKED} SELECT qid, text FROM queries WHERE lower(trim(text)) NOT IN (SELECT lower(trim(label)) FROM labels)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as aliases of the types they occur with."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("field_name"), F.col("p_partkey").alias("ord"))


def alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = queries(spark, sf_dir).select(F.col("text").alias("col")).distinct()
    return exact.alias_exact(cols, _aliases(spark, sf_dir))


ALIAS_EXACT = f"""WITH {ASKED}, a AS (SELECT {norm('p_name')} AS k, min_by(p_name, p_partkey) AS source FROM part GROUP BY 1), f AS (SELECT DISTINCT {norm('p_name')} AS k, p_type AS field FROM part)
SELECT DISTINCT text AS col, field, 1.0::DOUBLE AS score, source FROM queries JOIN a ON {norm('text')} = a.k JOIN f ON f.k = a.k"""


def standard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = queries(spark, sf_dir).select(F.col("text").alias("col")).distinct()
    schema = table(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise("")).alias("field_name"), F.col("p_partkey").alias("ord"))
    return exact.standard_exact(cols, schema)


STANDARD_EXACT = f"""WITH {ASKED}, f AS (SELECT {norm('p_name')} AS k, max_by(p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END, p_partkey) AS field FROM part GROUP BY 1)
SELECT DISTINCT text AS col, field, 1.0::DOUBLE AS score, '' AS source FROM queries JOIN f ON {norm('text')} = k"""


def token_sort_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select(F.lower("text").alias("qid")).distinct().withColumn("text", tx.normalize(F.col("qid")))
    return topk.token_topk(asked, labels(spark, sf_dir).select(F.col("label").alias("cid"), tx.normalize(F.col("label")).alias("text")), K, 92)


TOKEN_SORT_FUZZY = f"""WITH {LABELS}, {ASKED}, q AS (SELECT DISTINCT lower(text) AS qid, {sorted_tokens(norm('lower(text)'))} AS a FROM queries), c AS (SELECT label AS cid, {sorted_tokens(norm('label'))} AS b FROM labels),
p AS (SELECT qid, cid, round({indel_ratio('a', 'b')}, 6) AS score FROM q, c WHERE 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 92)
SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM p WHERE score >= 92 QUALIFY rank <= {K}"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk.vector_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("cid"), "embedding"), K, exclude_same=True)


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"
VECTOR_TOPK = f"""SELECT q.vec_id AS qid, c.vec_id AS cid, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id QUALIFY rank <= {K}"""


def synonym_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as synonyms of their labels: the k best synonyms, then the best of each label."""
    e = table(spark, sf_dir, "embeddings")
    hits = vector_topk(spark, sf_dir).join(e.select(F.col("vec_id").alias("cid"), F.col("label").cast("string").alias("label")), "cid")
    return fusion.max_merge(K, hits.select("qid", "rank", "label", "score"))


SYNONYM_TOPK = f"""WITH t AS ({VECTOR_TOPK}), b AS (SELECT qid, label::VARCHAR AS label, max(score) AS score, min(rank) AS r FROM t JOIN embeddings e ON e.vec_id = cid GROUP BY 1, 2)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r) AS rank, label, score FROM b"""


def ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir).select("qid", F.lower("text").alias("text"))
    return topk.gram_topk(asked, labels(spark, sf_dir).select(F.col("code").alias("cid"), F.lower("label").alias("text")), K)


_GRAMS = f"""{LABELS}, {ASKED}, q0 AS (SELECT qid, lower(text) AS text FROM queries), c0 AS (SELECT code AS cid, lower(label) AS text FROM labels),
{sparse('q', 'q0', 'qid')}, {sparse('c', 'c0', 'cid')}, {gram_pairs('q', 'c', 'h', K)}"""
NGRAM_TOPK = f"WITH {_GRAMS} SELECT qid, cid, score, rank FROM h"


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ngram_topk(spark, sf_dir).join(labels(spark, sf_dir).withColumnRenamed("code", "cid"), "cid").join(queries(spark, sf_dir).select("qid", "text"), "qid")
    return topk.rerank(hits, topk.token_overlap(F.col("text"), F.col("label")), 3).select("qid", "rank", "label", "similarity_score", "score")


_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[-_.:]', ' ', 'g'), '\\s+'), lambda t: t <> ''))"
RERANK_TOPK = f"""WITH {_GRAMS}, t AS (SELECT h.qid, label, score AS similarity_score, {_TOK.format('queries.text')} AS a, {_TOK.format('label')} AS b FROM h JOIN labels ON code = cid JOIN queries ON queries.qid = h.qid),
s AS (SELECT *, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS score FROM t)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank, label, similarity_score, score FROM s QUALIFY rank <= 3"""


def _search(spark: SparkSession, sf_dir: str, start: int, asked: DataFrame | None = None) -> DataFrame:
    """A search of the vectors by 32 dimensions from start; labels are ids as text. asked (qid): the queries, if not all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.slice("embedding", start, 32).alias("embedding"))
    hits = topk.vector_topk(v if asked is None else v.join(asked, "qid", "left_semi"), v.withColumnRenamed("qid", "cid"), K, exclude_same=True)
    return written(hits.select("qid", "rank", F.col("cid").cast("string").alias("label"), "score"))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two searches of the vectors: by their first and by their last 32 dimensions."""
    return [_search(spark, sf_dir, start) for start in (1, 33)]


def _weak_halves(spark: SparkSession, sf_dir: str, below: float) -> list[DataFrame]:
    """The same, the second for those queries alone whose first search found little."""
    a = _search(spark, sf_dir, 1)
    return [a, _search(spark, sf_dir, 33, fusion.low_confidence(a, below))]


def _half(name: str, start: int) -> str:
    s = f"round(list_cosine_similarity(q.embedding[{start}:{start + 31}]::DOUBLE[], c.embedding[{start}:{start + 31}]::DOUBLE[]), 6)"
    return f"{name} AS (SELECT q.vec_id AS qid, c.vec_id::VARCHAR AS label, {s} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id QUALIFY rank <= {K})"


_HALVES = f"{_half('s2', 1)}, {_half('s3', 33)}"


def max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.max_merge(K, *_halves(spark, sf_dir))


_MERGED = f"""m0 AS (SELECT qid, label, score, 0 AS part, rank FROM s2 UNION ALL SELECT qid, label, score, 1, rank FROM s3),
m1 AS (SELECT qid, label, max(score) AS score, min((part, rank)) AS f FROM m0 GROUP BY ALL),
merged AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, label) AS rank, label, score FROM m1 QUALIFY rank <= {K})"""
MAX_MERGE = f"WITH {_HALVES}, {_MERGED} SELECT qid, rank, label, score FROM merged"


def synonym_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _weak_halves(spark, sf_dir, 0.5)
    return fusion.synonym_boost(a, b, K, below=0.5)


SYNONYM_BOOST = f"""WITH {_HALVES}, low AS (SELECT qid, score AS top FROM s2 WHERE rank = 1 AND round(score, 4) < 0.5), s3l AS (SELECT * FROM s3 WHERE qid IN (SELECT qid FROM low)),
m0 AS (SELECT qid, label, score, 0 AS part, rank FROM s2 WHERE qid IN (SELECT qid FROM low) UNION ALL SELECT qid, label, score, 1, rank FROM s3l),
m1 AS (SELECT qid, label, max(score) AS score, min((part, rank)) AS f FROM m0 GROUP BY ALL),
merged AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, label) AS rank, label, score FROM m1 QUALIFY rank <= {K}),
b AS (SELECT merged.qid FROM merged JOIN low USING (qid) WHERE rank = 1 AND merged.score > round(top, 4))
SELECT qid, rank, label, score, 2.0::DOUBLE AS stage FROM s2 WHERE qid NOT IN (SELECT qid FROM b) UNION ALL SELECT qid, rank, label, score, 2.5::DOUBLE FROM merged WHERE qid IN (SELECT qid FROM b)"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_ranks(*_halves(spark, sf_dir), K)


RRF_FUSION = f"""WITH {_HALVES}, u AS (SELECT qid, label, rank, score AS a, NULL::DOUBLE AS b FROM s2 UNION ALL SELECT qid, label, rank, NULL, score FROM s3),
f AS (SELECT qid, label, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(a) AS a, max(b) AS b FROM u GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, label) AS rank, label, coalesce(a, b) AS score, rrf, 3.5::DOUBLE AS stage FROM f QUALIFY rank <= {K}"""


def cross_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    rows = a.withColumn("source", F.lit("front")).unionByName(b.withColumn("source", F.lit("back")))
    ref = F.when((F.col("qid") % 3 == 0) | (F.col("source") == "back"), F.concat(F.col("source"), F.col("qid").cast("string")))
    return fusion.merge_sources(K, rows.select(F.col("qid").alias("query"), "source", "label", "score", ref.alias("ref_match")))


CROSS_SOURCE_MERGE = f"""WITH {_HALVES}, u AS (SELECT qid AS query, 'front' AS source, label, score, CASE WHEN qid % 3 = 0 THEN 'front' || qid::VARCHAR END AS ref FROM s2 UNION ALL SELECT qid, 'back', label, score, 'back' || qid::VARCHAR FROM s3),
b AS (SELECT query, label, max(score) AS score, min_by(source, (-score, source)) AS source FROM u GROUP BY ALL), r AS (SELECT query, min_by(ref, source) AS ref_match FROM u WHERE ref IS NOT NULL GROUP BY 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank, label, score, source, ref_match FROM b LEFT JOIN r USING (query) QUALIFY rank <= {K}"""


def stage4_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten candidates of weak queries replace theirs, but for those that got nothing."""
    a, b = _weak_halves(spark, sf_dir, 0.5)
    weak = b.join(fusion.low_confidence(a, 0.5), "qid", "left_semi").withColumn("label", F.when((F.col("qid") % 4 == 0) & (F.col("rank") == 1), "N/A").otherwise(F.col("label")))
    return fusion.replace_by_stage(a.withColumn("stage", F.lit(2.0).cast("double")), weak, 4.0)


STAGE4_REPLACE = f"""WITH {_HALVES}, good AS (SELECT qid FROM s2 WHERE rank = 1 AND round(score, 4) < 0.5 AND qid % 4 <> 0)
SELECT qid, rank, label, score, 2.0::DOUBLE AS stage FROM s2 WHERE qid NOT IN (SELECT qid FROM good) UNION ALL SELECT qid, rank, label, score, 4.0::DOUBLE FROM s3 WHERE qid IN (SELECT qid FROM good)"""


def wide_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.wide(topk.padded(_search(spark, sf_dir, 1).filter(F.col("score") > 0.4), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid")), 3), 3)


WIDE_VIEW = f"""WITH {_half('s2', 1)}, g AS (SELECT * FROM s2 WHERE score > 0.4)
SELECT vec_id AS qid, {', '.join(f"max(CASE WHEN rank = {i} THEN g.label END) AS match{i}, coalesce(max(CASE WHEN rank = {i} THEN printf('%.4f', round(score, 4)) END), '0.0000') AS match{i}_score" for i in (1, 2, 3))} FROM embeddings LEFT JOIN g ON g.qid = vec_id GROUP BY vec_id"""


def ontology_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages 1, 2 and 2.5 (reversed names as synonyms), with match levels."""
    q, corpus = queries(spark, sf_dir), labels(spark, sf_dir)
    synonyms = corpus.withColumn("synonym", F.array_join(F.reverse(F.split("label", " ")), " "))
    mapper = ontology.OntologyMapper(corpus, ontology.gram_search(corpus), synonyms=ontology.gram_search(synonyms, "synonym"), settings=Settings(top_k=K), cut=written)
    results = mapper.run(q.select("qid", "text"))
    return results.join(topk.match_level(results, q.select("qid", "curated")), "qid").select("qid", "rank", "label", "score", "stage", "match_level")


ONTOLOGY_CASCADE = f"""WITH {LABELS}, {ASKED},
first AS (SELECT qid, label FROM queries JOIN labels ON lower(trim(text)) = lower(trim(label))),
rest AS (SELECT qid, text, {american('text')} AS n FROM queries WHERE qid NOT IN (SELECT qid FROM first)),
q0 AS (SELECT qid, lower(CASE WHEN l.label IS NOT NULL THEN left(n, length(n) - 1) ELSE n END) AS text FROM rest LEFT JOIN labels l ON right(lower(n), 1) = 's' AND length(n) > 3 AND lower(left(n, length(n) - 1)) = lower(trim(l.label))),
c0 AS (SELECT code AS cid, lower(label) AS text FROM labels),
{sparse('q', 'q0', 'qid')}, {sparse('c', 'c0', 'cid')}, {gram_pairs('q', 'c', 'h2', K)},
s2 AS (SELECT qid, rank, label, round(score, 4) AS score FROM h2 JOIN labels ON code = cid),
low AS (SELECT qid, coalesce(max(score) FILTER (rank = 1), 0) AS top FROM q0 LEFT JOIN s2 USING (qid) GROUP BY qid HAVING top < 0.9),
q1 AS (SELECT qid, lower(text) AS text FROM rest WHERE qid IN (SELECT qid FROM low)),
c1 AS (SELECT code AS cid, lower(array_to_string(list_reverse(string_split(label, ' ')), ' ')) AS text FROM labels),
{sparse('qs', 'q1', 'qid')}, {sparse('cs', 'c1', 'cid')}, {gram_pairs('qs', 'cs', 'h3', K)},
s3 AS (SELECT qid, rank, label, round(score, 4) AS score FROM h3 JOIN labels ON code = cid),
m0 AS (SELECT qid, label, score, 0 AS part, rank FROM s2 WHERE qid IN (SELECT qid FROM low) UNION ALL SELECT qid, label, score, 1, rank FROM s3),
m1 AS (SELECT qid, label, max(score) AS score, min((part, rank)) AS f FROM m0 GROUP BY ALL),
merged AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, label) AS rank, label, score FROM m1 QUALIFY rank <= {K}),
b AS (SELECT merged.qid FROM merged JOIN low USING (qid) WHERE rank = 1 AND score > top),
r AS (SELECT qid, 1 AS rank, label, 1.0::DOUBLE AS score, 1.0::DOUBLE AS stage FROM first
  UNION ALL SELECT qid, rank, label, score, 2.0 FROM s2 WHERE qid NOT IN (SELECT qid FROM b) UNION ALL SELECT qid, rank, label, score, 2.5 FROM merged WHERE qid IN (SELECT qid FROM b)),
lv AS (SELECT r.qid, coalesce(min(CASE WHEN lower(trim(label)) = lower(trim(curated)) THEN rank END), 99) AS match_level FROM r JOIN queries USING (qid) GROUP BY r.qid)
SELECT qid, rank, label, score, stage, match_level FROM r JOIN lv USING (qid)"""


def variant_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import evaluate

    variants = table(spark, sf_dir, "part").select(mutated_plain().alias("variant"), F.col("p_name").alias("canonical")).distinct()
    return evaluate.match_rate(exact.map_variants(queries(spark, sf_dir), variants, "text"))


def mutated_plain():
    return F.regexp_replace("p_name", " ", "_")


VARIANT_MAPPING = f"""WITH {ASKED}, v AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS k FROM part), m AS (SELECT k IS NOT NULL AS f FROM queries LEFT JOIN v ON lower(trim(text)) = k)
SELECT count(*) AS n, count(*) FILTER (f) AS found, round(avg(f::INT), 6) AS rate FROM m"""


QUERIES = {
    "exact_match": (exact_match, EXACT_MATCH),
    "residual_anti": (residual_anti, RESIDUAL_ANTI),
    "alias_exact": (alias_exact, ALIAS_EXACT),
    "standard_exact": (standard_exact, STANDARD_EXACT),
    "token_sort_fuzzy": (token_sort_fuzzy, TOKEN_SORT_FUZZY),
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "synonym_topk": (synonym_topk, SYNONYM_TOPK),
    "ngram_topk": (ngram_topk, NGRAM_TOPK),
    "rerank_topk": (rerank_topk, RERANK_TOPK),
    "max_merge": (max_merge, MAX_MERGE),
    "synonym_boost": (synonym_boost, SYNONYM_BOOST),
    "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "cross_source_merge": (cross_source_merge, CROSS_SOURCE_MERGE),
    "stage4_replace": (stage4_replace, STAGE4_REPLACE),
    "wide_view": (wide_view, WIDE_VIEW),
    "ontology_cascade": (ontology_cascade, ONTOLOGY_CASCADE),
    "variant_mapping": (variant_mapping, VARIANT_MAPPING),
}
