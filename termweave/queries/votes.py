"""Queries of value votes, column tests and the schema cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import votes
from ..plans import schema
from ..sources.tables import to_cells
from ..storage import written
from .common import gram_pairs, norm, sparse, table

#: Columns whose values vote: (table, column, key that orders the rows).
VOTERS = (("events", "event_type", "event_id"), ("orders", "o_orderpriority", "o_orderkey"), ("orders", "o_orderstatus", "o_orderkey"), ("customer", "c_mktsegment", "c_custkey"), ("part", "p_type", "p_partkey"), ("lineitem", "l_returnflag", "l_orderkey"), ("part", "p_name", "p_partkey"), ("part", "p_retailprice", "p_partkey"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, col, cell) of the voting columns, in one pass over each table."""
    out = None
    for name in dict.fromkeys(v[0] for v in VOTERS):
        mine = [v for v in VOTERS if v[0] == name]
        c = to_cells(table(spark, sf_dir, name).select(mine[0][2], *(F.format_string("%.2f", v[1]).alias(v[1]) if v[1] == "p_retailprice" else v[1] for v in mine)), mine[0][2])
        out = c if out is None else out.unionByName(c)
    return out


CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT {k} AS row_id, '{c}' AS col, {f'''printf('%.2f', {c})''' if c == 'p_retailprice' else c} AS cell FROM {t}" for t, c, k in VOTERS) + ")"
VALS = """parts AS (SELECT row_id, col, list_filter(list_transform(string_split_regex(cell, ';|<;>|::'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'na' AND x NOT IN ('<', '>')) AS v FROM cells),
vals AS (SELECT col, row_id, unnest(generate_series(1, len(v))) - 1 AS pos, unnest(v) AS value FROM parts WHERE len(v) > 0)"""
VALUES = f"{CELLS}, {VALS}"
_NOISE = ", ".join(f"'{x}'" for x in ("", *sorted(tx.NOISE)))


def _unique(of: str | None = None) -> str:
    return f"""nv AS (SELECT *, {norm('value')} AS normed FROM vals {f'WHERE col IN ({of})' if of else ''}),
uniq AS (SELECT col, normed, min_by(value, (row_id, pos)) AS value FROM nv WHERE normed NOT IN ({_NOISE}) GROUP BY ALL)"""


UNIQUE = f"{VALUES}, {_unique()}"
FREQ = "fr AS (SELECT col, value, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY col) AS freq FROM vals GROUP BY col, value)"
_WEIGHTS = """capped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY col) AS k FROM uniq) WHERE k <= 50),
wt AS (SELECT col, normed, value, w, sum(w) OVER (PARTITION BY col) AS total FROM (SELECT c.col, normed, c.value, ln(1 + coalesce(freq, 1.0 / k) * 10) AS w FROM capped c LEFT JOIN fr ON fr.col = c.col AND fr.value = c.value))"""
WEIGHTS = f"{UNIQUE}, {FREQ}, {_WEIGHTS}"


def weights_sql(of: str) -> str:
    """CTEs from vals to wt, the weights of the values of some columns (a query)."""
    return f"{_unique(of)}, {FREQ}, {_WEIGHTS}"


def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.unique_values(votes.cell_values(cells(spark, sf_dir)))


def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.frequencies(votes.cell_values(cells(spark, sf_dir))).withColumn("freq", F.round("freq", 9))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, value): two fields that share the order states, one of segments, one of part types."""
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    own = lambda df, col, field: df.select(F.lit(field).alias("field"), F.upper(col).alias("value")).distinct()
    return own(o, "o_orderstatus", "status").unionByName(own(o, "o_orderstatus", "state")).unionByName(own(o, "o_orderpriority", "state")).unionByName(own(c, "c_mktsegment", "segment")).unionByName(own(p, "p_type", "material"))


DICTIONARY = """dict AS (SELECT DISTINCT 'status' AS field, upper(o_orderstatus) AS value FROM orders UNION ALL SELECT DISTINCT 'state', upper(o_orderstatus) FROM orders UNION ALL SELECT DISTINCT 'state', upper(o_orderpriority) FROM orders
  UNION ALL SELECT DISTINCT 'segment', upper(c_mktsegment) FROM customer UNION ALL SELECT DISTINCT 'material', upper(p_type) FROM part)"""


def log_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = written(votes.weighted_of(votes.counted_cells(cells(spark, sf_dir))))
    d = dictionary(spark, sf_dir)
    hits = w.join(d.withColumnRenamed("value", "v"), F.upper("value") == F.col("v")).select("col", "value", "field", F.lit(1.0).cast("double").alias("sim"))
    return votes.dictionary_vote(w, hits)


LOG_WEIGHTED_VOTE = f"""WITH {WEIGHTS}, {DICTIONARY}, hits AS (SELECT DISTINCT col, wt.value, field, 1.0::DOUBLE AS sim FROM wt JOIN dict ON upper(wt.value) = dict.value),
v AS (SELECT col, field, round(sum(w) / max(total), 9) AS proportion, round(sum(w * sim) / greatest(sum(w), 1e-9), 9) AS avg_score, count(*) AS n, min_by(value, (-sim, value)) AS example FROM hits JOIN wt USING (col, value) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY col ORDER BY proportion DESC, avg_score DESC, n DESC, field) AS rank FROM v WHERE proportion >= 0.2"""


def ontology_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    w = votes.weighted(votes.cell_values(c))
    p = table(spark, sf_dir, "part")
    hits = p.select(F.col("p_type").alias("text"), F.lit("cancer_type").alias("field")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text"), F.lit("sector").alias("field"))).unionByName(p.select(F.lit("P_TYPE").alias("text"), F.lit("sector").alias("field"))).distinct()
    return votes.ontology_vote(w, c.select("col").distinct(), hits, 5)


ONTOLOGY_VOTE = f"""WITH {WEIGHTS}, hits AS (SELECT DISTINCT lower(trim(p_type)) AS t, 'cancer_type' AS field FROM part UNION ALL SELECT DISTINCT lower(trim(c_mktsegment)), 'sector' FROM customer UNION ALL SELECT 'p_type', 'sector'),
bv AS (SELECT col, field, sum(w) / max(total) AS share FROM wt JOIN hits ON lower(trim(value)) = t GROUP BY ALL), bn AS (SELECT DISTINCT col, field FROM cells JOIN hits ON lower(trim(col)) = t),
s AS (SELECT coalesce(bv.col, bn.col) AS col, coalesce(bv.field, bn.field) AS field, round(CASE WHEN bn.col IS NOT NULL THEN least(1.0, coalesce(share, 0) + 0.3) ELSE share END, 9) AS score FROM bv FULL JOIN bn ON bv.col = bn.col AND bv.field = bn.field),
top AS (SELECT col, field, score, row_number() OVER (PARTITION BY col ORDER BY score DESC, field) AS rank FROM s WHERE score > 0.2 AND col IN (SELECT col FROM wt) QUALIFY rank <= 5),
n AS (SELECT col, max(rank) AS n, max(score) FILTER (field = 'cancer_type') AS c, bool_or(field = 'disease') AS d FROM top GROUP BY col HAVING c IS NOT NULL)
SELECT col, field, score, rank FROM top UNION ALL SELECT col, 'disease', c, n + 1 FROM n WHERE n < 5 AND NOT d UNION ALL SELECT col, 'cancer_type_details', c, n + CASE WHEN d THEN 1 ELSE 2 END FROM n WHERE n + CASE WHEN d THEN 0 ELSE 1 END < 5"""


def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.numeric_columns(cells(spark, sf_dir))


NUMERIC_COLUMNS = f"""WITH {VALUES}, s AS (SELECT col, count(*) AS n, round(avg(regexp_matches(value, '{tx.NUMBER}')::INT), 9) AS share FROM vals GROUP BY col) SELECT *, share >= 0.9 AS is_numeric FROM s"""

STAGES = ("Stage IIIC", "pT2b", "stage: 4", "cN1", "M0", "Stage group II a", "none")


def invalid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of made-up clinical columns, one row for each part."""
    names = ("patient_id", "SampleCode", "sample_counts", "mutation-count", "tumor_grade", "ajcc_group", "tnm", "bid", "notes")
    p = table(spark, sf_dir, "part")
    cell = F.when(F.col("p_size") % 10 == 0, None).otherwise(F.element_at(F.array(*(F.lit(s) for s in STAGES)), (F.col("p_partkey") % 2 * 2 + 1).cast("int")))
    c = p.select(F.col("p_partkey").alias("row_id"), F.explode(F.array(*(F.lit(n) for n in names))).alias("col"), cell.alias("stage"), "p_type")
    return votes.invalid_columns(c.select("row_id", "col", F.when(F.col("col") == "tumor_grade", F.col("stage")).otherwise(F.col("p_type")).alias("cell")))


INVALID_COLUMNS = "SELECT * FROM (VALUES ('patient_id', 'id_column'), ('SampleCode', 'id_column'), ('sample_counts', NULL), ('mutation-count', NULL), ('tumor_grade', 'stage_column'), ('ajcc_group', 'stage_column'), ('tnm', 'stage_column'), ('bid', NULL), ('notes', NULL)) AS t(col, reason)"

def column_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 3 by itself: every part name as a column, against the part types and brands as fields."""
    p = table(spark, sf_dir, "part")
    fields = p.select(F.concat(F.lower("p_type"), F.lit(" treatment")).alias("field_name")).distinct().withColumns({"ord": F.lit(0), "is_numeric_field": F.lit("")})
    cols = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, " therapy").otherwise("")).alias("col")).distinct()
    return schema.similar_fields(fields, None, 3)(cols).select("col", "rank", "field", "score")


COLUMN_SIMILARITY = f"""WITH q0 AS (SELECT DISTINCT col AS qid, {norm('col')} AS text FROM (SELECT p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' therapy' ELSE '' END AS col FROM part)),
c0 AS (SELECT DISTINCT lower(p_type) || ' treatment' AS cid, {norm("lower(p_type) || ' treatment'")} AS text FROM part),
{sparse('q', 'q0', 'qid')}, {sparse('c', 'c0', 'cid')}, {gram_pairs('q', 'c', 'h', 9)},
b AS (SELECT qid AS col, cid AS field, round(score + CASE WHEN contains(qid, 'therapy') THEN 0.2 ELSE 0 END, 6) AS score FROM h)
SELECT col, row_number() OVER (PARTITION BY col ORDER BY score DESC, field) AS rank, field, score FROM b QUALIFY rank <= 3"""


QUERIES = {
    "unique_values": (unique_values, f"WITH {UNIQUE} SELECT * FROM uniq"),
    "value_frequencies": (value_frequencies, f"WITH {VALUES}, {FREQ} SELECT col, value, n, round(freq, 9) AS freq FROM fr"),
    "log_weighted_vote": (log_weighted_vote, LOG_WEIGHTED_VOTE),
    "ontology_vote": (ontology_vote, ONTOLOGY_VOTE),
    "numeric_columns": (numeric_columns, NUMERIC_COLUMNS),
    "invalid_columns": (invalid_columns, INVALID_COLUMNS),
    "column_similarity": (column_similarity, COLUMN_SIMILARITY),
}
