"""The schema cascade over the columns of all tables of figures, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import votes
from ..plans import schema
from ..sources.settings import Settings
from ..sources.tables import to_cells
from ..storage import written
from .common import gram_pairs, indel_ratio, norm, sorted_tokens, sparse, table
from .votes import DICTIONARY, VALS, dictionary, weights_sql
from .words import _has

K = 3
#: Tables, their keys, and all their columns.
TABLES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
FIELDS = (("retail_price", "yes"), ("order_date", ""), ("ship_date", ""), ("order_priority", ""), ("order_status", ""), ("market_segment", ""), ("part_type", ""), ("account_balance", "yes"), ("return_flag", ""), ("event_type", ""), ("treatment_dose", "yes"))
ALIASES = (("price", "retail_price", "yes"), ("p_retailprice", "retail_price", "yes"), ("mktsegment", "market_segment", ""), ("material kind", "part_type", ""), ("orderstatus", "order_status", ""), ("o orderpriorty", "order_priority", ""), ("acct bal", "account_balance", "yes"))
#: Ontology terms and the fields they speak for; l_linestatus is known by name alone.
CONCEPTS = (("R", "return_flag"), ("A", "return_flag"), ("l_linestatus", "cancer_type"), ("F", "cancer_type"), ("O", "cancer_type"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, col, cell) of all columns as text, in one pass over each table."""
    out = None
    for name, columns in TABLES.items():
        key = columns[0]
        rows = table(spark, sf_dir, name).select(F.col(key).alias("_key"), *(F.col(c).cast("string").alias(c) for c in columns))
        c = to_cells(rows, "_key")
        out = c if out is None else out.unionByName(c)
    return out


def schema_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns to a small schema by all strategies that need no model."""
    target = spark.createDataFrame([(*r, i) for i, r in enumerate(FIELDS)], "field_name string, is_numeric_field string, ord long")
    aliases = spark.createDataFrame([(*r, i) for i, r in enumerate(ALIASES)], "source string, field_name string, is_numeric_field string, ord long")
    concepts = spark.createDataFrame(list(CONCEPTS), "text string, field string")
    mapper = schema.SchemaMapper(target, aliases, values=dictionary(spark, sf_dir), concepts=concepts, settings=Settings(top_k=K), cut=written)
    counts = votes.counted_tables([(table(spark, sf_dir, name).select(*columns), columns[0]) for name, columns in TABLES.items()])
    return mapper.run(cells(spark, sf_dir), counts=counts)


# --- the same in SQL ------------------------------------------------------------


def _values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS t({names}))"


def _best(name: str, source: str, k: int | None, ties: str = "source") -> str:
    """CTE of (col, field, score, source, rank): one row for each field, ranked by score and field."""
    return f"""{name} AS (SELECT col, field, score, source, row_number() OVER (PARTITION BY col ORDER BY score DESC, field) AS rank FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY col, field ORDER BY score DESC, {ties}) = 1) {f'QUALIFY rank <= {k}' if k else ''})"""


def _fuzzy(name: str, left: str, names: str) -> str:
    """CTE of (col, cid, score, rank): the best of names (cid) by token-sort ratio of at least 92."""
    return f"""{name}_p AS (SELECT col, cid, round({indel_ratio('a', 'b')}, 6) AS score FROM (SELECT col, {sorted_tokens(norm('col'))} AS a FROM {left}), (SELECT cid, {sorted_tokens('cid')} AS b FROM {names}) WHERE 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 92),
{name} AS (SELECT col, cid, score, row_number() OVER (PARTITION BY col ORDER BY score DESC, cid) AS rank FROM {name}_p WHERE score >= 92 QUALIFY rank <= {K})"""


def _index(name: str, source: str) -> str:
    return f"{name} AS (SELECT {norm('source')} AS cid, min_by(source, ord) AS source, list_sort(list_distinct(list(field))) AS fields FROM {source} GROUP BY 1)"


def _similar(p: str, left: str, numeric: bool) -> str:
    """CTEs ending in {p}(col, field, score, source, rank): fields by the names of them and of their aliases."""
    keep = "WHERE num = 'yes'" if numeric else ""
    if numeric:
        keys = f"""{p}_n AS (SELECT col, {norm('col')} AS n FROM {left}), {p}_u AS (SELECT col, n, trim(regexp_replace(regexp_replace(n, '(?i){tx.UNITS}', ' ', 'g'), '\\s+', ' ', 'g')) AS clean, regexp_extract_all(n, '(?i)({tx.UNITS})', 1) AS t FROM {p}_n),
{p}_k AS (SELECT col AS qid, n, CASE WHEN clean <> '' THEN clean ELSE n END AS text, CASE WHEN len(list_filter(t, lambda x: regexp_matches(x, '{tx.DOSE_TAG}'))) > 0 OR regexp_matches(clean, '{tx.DOSE}') THEN 'dose' WHEN regexp_matches(clean, '{tx.AGE}') THEN 'age' WHEN regexp_matches(clean, '{tx.TIME}') THEN 'time' ELSE 'unknown' END AS family FROM {p}_u)"""
    else:
        keys = f"{p}_k AS (SELECT col AS qid, {norm('col')} AS n, {norm('col')} AS text, 'unknown' AS family FROM {left})"
    family = f"CASE {' '.join(f'''WHEN family = '{fam}' AND {_has('lower(field)', words)} THEN {bonus}''' for fam, rules in tx.FAMILIES.items() for words, bonus in rules)} ELSE 0 END" if numeric else "0"
    score = f"round(score + CASE WHEN (regexp_matches(n, '(^tx_|_tx$|_tx_)') OR {_has('n', tx.TREATMENT)}) AND contains(lower(field), 'treatment') THEN 0.2 ELSE 0 END + {family}, 6)"
    return f"""{keys}, {p}_c AS (SELECT DISTINCT field AS cid, {norm('field')} AS text FROM fields {keep}), {p}_al AS (SELECT * FROM aliases {keep}), {_index(f'{p}_ix', f'{p}_al')}, {p}_ac AS (SELECT cid, cid AS text FROM {p}_ix),
{sparse(f'{p}_q', f'{p}_k', 'qid')}, {sparse(f'{p}_cs', f'{p}_c', 'cid')}, {sparse(f'{p}_as', f'{p}_ac', 'cid')}, {gram_pairs(f'{p}_q', f'{p}_cs', f'{p}_h', 3 * K)}, {gram_pairs(f'{p}_q', f'{p}_as', f'{p}_ha', 3 * K)},
{p}_s AS (SELECT qid AS col, cid AS field, score, '' AS source FROM {p}_h), {p}_a AS (SELECT qid AS col, unnest(fields) AS field, score, source FROM {p}_ha JOIN {p}_ix USING (cid)),
{p}_sb AS (SELECT col, field, {score} AS score, source FROM {p}_s JOIN {p}_k ON qid = col), {p}_ab AS (SELECT col, field, {score} AS score, source FROM {p}_a JOIN {p}_k ON qid = col),
{_best(f'{p}_s3', f'{p}_sb', K)}, {_best(f'{p}_a3', f'{p}_ab', K)},
{p}_b AS (SELECT col, field, score, source, 0 AS part FROM {p}_s3 UNION ALL SELECT col, field, score, source, 1 FROM {p}_a3), {_best(p, f'{p}_b', K, 'part, source')}"""


def _but(name: str, source: str, found: str) -> str:
    return f"{name} AS (SELECT col FROM {source} WHERE col NOT IN (SELECT col FROM {found}))"


CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT {cs[0]} AS row_id, '{c}' AS col, CAST({c} AS VARCHAR) AS cell FROM {t}" for t, cs in TABLES.items() for c in cs) + ")"
SCHEMA_CASCADE = f"""WITH {CELLS}, {VALS},
fields AS (SELECT * FROM {_values([(*r, i) for i, r in enumerate(FIELDS)], 'field, num, ord')}), aliases AS (SELECT * FROM {_values([(*r, i) for i, r in enumerate(ALIASES)], 'source, field, num, ord')}), {DICTIONARY},
cols AS (SELECT DISTINCT col FROM cells),
numeric_ AS (SELECT col FROM vals GROUP BY col HAVING avg(regexp_matches(value, '{tx.NUMBER}')::INT) >= 0.9),
std AS (SELECT {norm('field')} AS cid, max_by(field, ord) AS field FROM fields GROUP BY 1), {_index('ix', 'aliases')},
a1 AS (SELECT col, 1 AS rank, field, 1.0::DOUBLE AS score, '' AS source, 'std_exact' AS method FROM cols JOIN std ON {norm('col')} = cid),
{_but('l1', 'cols', 'a1')}, a2r AS (SELECT col, unnest(fields) AS field, source FROM l1 JOIN ix ON {norm('col')} = cid),
a2 AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY field) AS rank, field, 1.0::DOUBLE AS score, source, 'alias_exact' AS method FROM a2r QUALIFY rank <= {K}),
{_but('l2', 'l1', 'a2')}, {_fuzzy('f3', 'l2', 'std')}, a3 AS (SELECT col, rank, field, round(score / 100, 4) AS score, '' AS source, 'std_fuzzy' AS method FROM f3 JOIN std USING (cid)),
{_but('l3', 'l2', 'a3')}, {_fuzzy('f4', 'l3', 'ix')}, f4r AS (SELECT col, unnest(fields) AS field, round(score / 100, 4) AS score, source FROM f4 JOIN ix USING (cid)), {_best('f4b', 'f4r', None)},
a4 AS (SELECT col, rank, field, score, source, 'alias_fuzzy' AS method FROM f4b), {_but('l4', 'l3', 'a4')},
texty AS (SELECT col FROM l4 WHERE col NOT IN (SELECT col FROM numeric_)), {weights_sql("SELECT col FROM texty")},
vq AS (SELECT DISTINCT value AS qid, lower(value) AS text FROM wt), vc AS (SELECT DISTINCT value AS cid, lower(value) AS text FROM dict),
{sparse('vqs', 'vq', 'qid')}, {sparse('vcs', 'vc', 'cid')}, {gram_pairs('vqs', 'vcs', 'vh', 10)},
vf AS (SELECT DISTINCT wt.col, wt.value, dict.field, max(vh.score) OVER (PARTITION BY wt.col, wt.value, dict.field) AS sim FROM wt JOIN vh ON vh.qid = wt.value AND vh.score >= 0.85 JOIN dict ON dict.value = vh.cid),
vv AS (SELECT col, field, round(sum(w) / max(total), 9) AS proportion, round(sum(w * sim) / greatest(sum(w), 1e-9), 9) AS avg_score, count(*) AS n, min_by(value, (-sim, value)) AS example FROM vf JOIN wt USING (col, value) GROUP BY ALL),
b1 AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY proportion DESC, avg_score DESC, n DESC, field) AS rank, field, proportion AS score, example AS source, 'value' AS method FROM vv WHERE proportion >= 0.2),
{_but('l5', 'texty', 'b1')}, concepts AS (SELECT DISTINCT lower(trim(text)) AS t, field FROM {_values(CONCEPTS, 'text, field')}),
ov AS (SELECT col, field, sum(w) / max(total) AS share FROM wt JOIN concepts ON lower(trim(value)) = t WHERE col IN (SELECT col FROM l5) GROUP BY ALL), oc AS (SELECT DISTINCT col, field FROM l5 JOIN concepts ON lower(trim(col)) = t),
os AS (SELECT coalesce(ov.col, oc.col) AS col, coalesce(ov.field, oc.field) AS field, round(CASE WHEN oc.col IS NOT NULL THEN least(1.0, coalesce(share, 0) + 0.3) ELSE share END, 9) AS score FROM ov FULL JOIN oc ON ov.col = oc.col AND ov.field = oc.field),
ot AS (SELECT col, field, score, row_number() OVER (PARTITION BY col ORDER BY score DESC, field) AS rank FROM os WHERE score > 0.2 AND col IN (SELECT col FROM wt) QUALIFY rank <= {K}),
og AS (SELECT col, max(rank) AS n, max(score) FILTER (field = 'cancer_type') AS c, bool_or(field = 'disease') AS d FROM ot GROUP BY col HAVING c IS NOT NULL),
b2 AS (SELECT col, rank, field, score, col AS source, 'ontology' AS method FROM (SELECT col, field, score, rank FROM ot UNION ALL SELECT col, 'disease', c, n + 1 FROM og WHERE n < {K} AND NOT d UNION ALL SELECT col, 'cancer_type_details', c, n + CASE WHEN d THEN 1 ELSE 2 END FROM og WHERE n + CASE WHEN d THEN 0 ELSE 1 END < {K})),
l6 AS (SELECT col FROM l4 WHERE col NOT IN (SELECT col FROM b1) AND col NOT IN (SELECT col FROM b2)), l6n AS (SELECT col FROM l6 WHERE col IN (SELECT col FROM numeric_)),
{_similar('sn', 'l6n', True)}, l7 AS (SELECT col FROM l6 WHERE col NOT IN (SELECT col FROM sn WHERE rank = 1 AND score >= 0.6)), {_similar('ss', 'l7', False)},
c0 AS (SELECT *, 0 AS i, 'numeric' AS method FROM sn UNION ALL SELECT *, 1, 'semantic' FROM ss), cb AS (SELECT col, i FROM c0 WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY col ORDER BY score DESC, i) = 1)
SELECT col, stage, method, rank, field, round(score, 4) AS score, source FROM (
  SELECT col, 'stage1' AS stage, method, rank, field, score, source FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4)
  UNION ALL SELECT col, 'stage2', method, rank, field, score, source FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
  UNION ALL SELECT col, 'stage3', method, rank, field, score, source FROM c0 JOIN cb USING (col, i))"""

QUERIES = {"schema_cascade": (schema_cascade, SCHEMA_CASCADE)}
