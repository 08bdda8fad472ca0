"""Queries of the text functions and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import exact
from ..operators.callables import parse_aliases, parse_fields
from ..sources import tables
from .common import american, labels, norm, table


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.normalize(F.col("c_name")).alias("normed"), tx.key(F.col("c_mktsegment")).alias("segment_key"), tx.clean_query(F.col("c_name")).alias("cleaned"))


NORMALIZE_NAMES = f"SELECT c_custkey AS id, {norm('c_name')} AS normed, lower(trim(c_mktsegment)) AS segment_key, CASE WHEN trim(c_name) NOT IN ('', 'nan', 'NaN', 'None') THEN trim(c_name) END AS cleaned FROM customer"


def split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cell = F.concat("o_orderstatus", F.lit(";"), "o_orderpriority", F.lit("<;>na::"), "o_orderstatus")
    return o.select(F.explode(tx.valid_values(cell)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


SPLIT_VALUES = """SELECT value, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split_regex(o_orderstatus || ';' || o_orderpriority || '<;>na::' || o_orderstatus, ';|<;>|::'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'na' AND x NOT IN ('<', '>'))) AS value FROM orders) GROUP BY value"""


def american_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat_ws("_", "p_name", F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int"))).alias("text"))
    extra = labels(spark, sf_dir).select(F.concat("label", F.lit(" tumor")).alias("label"))
    return exact.normalize_queries(p, extra)


WORDS = ("Tumours", "Leukaemia", "TUMOUR", "Anaemias", "haemoglobin", "bus", "gas")
AMERICAN_QUERIES = f"""WITH q AS (SELECT p_partkey AS qid, p_name || '_' || ([{', '.join(f"'{w}'" for w in WORDS)}])[p_partkey % {len(WORDS)} + 1] AS text FROM part),
n AS (SELECT qid, text, {american('text')} AS n FROM q),
c AS (SELECT DISTINCT lower(trim(p_name || ' tumor')) AS k FROM part)
SELECT qid, text, CASE WHEN c.k IS NOT NULL THEN left(n, length(n) - 1) ELSE n END AS normed FROM n LEFT JOIN c ON right(lower(n), 1) = 's' AND length(n) > 3 AND lower(left(n, length(n) - 1)) = c.k"""


def term_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = ("NCIT:C", "UBERON:", "EFO:", "MONDO_", "COB:", "C")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*(F.lit(x) for x in prefixes)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_partkey").cast("string")).alias("curie"))
    c = tx.clean_code(F.col("curie"))
    return p.select("p_partkey", "curie", c.alias("code"), tx.obo_id(c).alias("obo_id"), tx.ontology(c).alias("ontology"), tx.iri(c).alias("iri"))


TERM_CODES = f"""WITH p AS (SELECT p_partkey, (['NCIT:C', 'UBERON:', 'EFO:', 'MONDO_', 'COB:', 'C'])[p_partkey % 6 + 1] || p_partkey::VARCHAR AS curie FROM part),
c AS (SELECT *, CASE WHEN NOT contains(curie, ':') THEN curie WHEN upper(split_part(curie, ':', 1)) = 'NCIT' THEN split_part(curie, ':', 2) ELSE split_part(curie, ':', 1) || '_' || split_part(curie, ':', 2) END AS code FROM p),
o AS (SELECT *, CASE WHEN NOT contains(code, '_') THEN 'ncit' WHEN upper(split_part(code, '_', 1)) IN ({', '.join(f"'{k}'" for k in tx.ONTOLOGIES if k != 'NCIT')}) THEN lower(split_part(code, '_', 1)) END AS ontology FROM c)
SELECT p_partkey, curie, code, CASE WHEN contains(code, ':') THEN code ELSE regexp_replace(code, '^([^_:]+)_', '\\1:') END AS obo_id, ontology,
  CASE WHEN ontology = 'efo' THEN 'http://www.ebi.ac.uk/efo/' ELSE 'http://purl.obolibrary.org/obo/' END || CASE WHEN contains(code, '_') THEN code ELSE 'NCIT_' || code END AS iri FROM o"""


HEADERS = ("dose mg", "radiation_total_gy", "age at diagnosis", "start date", "auc5 iv", "tx_response", "survival months", "bid q3w x6 cycles", "sample volume")
FIELDS = ("treatment_dose", "patient_age", "treatment_start_date", "tumor_size")


def unit_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_type"), F.element_at(F.array(*(F.lit(x) for x in HEADERS)), (F.col("p_partkey") % len(HEADERS) + 1).cast("int"))).alias("header"), F.element_at(F.array(*(F.lit(x) for x in FIELDS)), (F.col("p_size") % 4 + 1).cast("int")).alias("field"))
    clean, tags = tx.without_units(F.col("header")), tx.unit_tags(F.col("header"))
    family = tx.numeric_family(clean, tags)
    return h.select("p_partkey", "header", "field", clean.alias("clean"), F.array_join(tags, "|").alias("tags"), family.alias("family"), tx.family_boost(F.col("field"), family).alias("family_boost"), tx.treatment_boost(F.col("field"), F.col("header")).alias("treatment_boost"))


def _has(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


UNIT_FAMILY = f"""WITH h AS (SELECT p_partkey, lower(p_type) || ' ' || ([{', '.join(f"'{x}'" for x in HEADERS)}])[p_partkey % {len(HEADERS)} + 1] AS header, ([{', '.join(f"'{x}'" for x in FIELDS)}])[p_size % 4 + 1] AS field FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(header, '(?i){tx.UNITS}', ' ', 'g'), '\\s+', ' ', 'g')) AS clean, list_sort(list_distinct(regexp_extract_all(header, '(?i)({tx.UNITS})', 1))) AS t FROM h),
f AS (SELECT *, CASE WHEN len(list_filter(t, lambda x: regexp_matches(x, '{tx.DOSE_TAG}'))) > 0 OR regexp_matches(clean, '{tx.DOSE}') THEN 'dose' WHEN regexp_matches(clean, '{tx.AGE}') THEN 'age' WHEN regexp_matches(clean, '{tx.TIME}') THEN 'time' ELSE 'unknown' END AS family FROM c)
SELECT p_partkey, header, field, clean, array_to_string(t, '|') AS tags, family,
  (CASE {' '.join(f"WHEN family = '{fam}' AND {_has('field', words)} THEN {bonus}" for fam, rules in tx.FAMILIES.items() for words, bonus in rules)} ELSE 0 END)::DOUBLE AS family_boost,
  (CASE WHEN (regexp_matches(header, '(^tx_|_tx$|_tx_)') OR {_has('header', tx.TREATMENT)}) AND contains(field, 'treatment') THEN 0.2 ELSE 0 END)::DOUBLE AS treatment_boost FROM f"""


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = labels(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    ta, tb = tx.tokens(a), tx.tokens(b)
    pairs = l.select(F.col("label").alias("a")).crossJoin(l.select(F.col("label").alias("b"))).filter("a < b")
    return pairs.select("a", "b", F.round(sim.edit_distance(a, b), 6).alias("edit"), F.round(sim.jaccard(ta, tb), 6).alias("jaccard"), F.round(sim.overlap(ta, tb), 6).alias("overlap"), F.round(sim.indel_ratio(sim.lcs(a, b, sim.letter_masks(b)), a, b), 6).alias("indel"))


def _tok(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[-_.:]', ' ', 'g'), '\\s+'), lambda t: t <> ''))"


def _text_similarity() -> str:
    from .common import indel_ratio

    return f"""WITH l AS (SELECT DISTINCT p_name AS label FROM part), p AS (SELECT x.label AS a, y.label AS b FROM l x, l y WHERE x.label < y.label),
t AS (SELECT a, b, {_tok('a')} AS ta, {_tok('b')} AS tb, regexp_replace(lower(a), '[_ ]', '', 'g') AS ca, regexp_replace(lower(b), '[_ ]', '', 'g') AS cb FROM p)
SELECT a, b, round(levenshtein(ca, cb)::DOUBLE / greatest(length(ca), length(cb)), 6) AS edit, round(len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard,
  round(len(list_intersect(ta, tb))::DOUBLE / least(len(ta), len(tb)), 6) AS overlap, round({indel_ratio('a', 'b')}, 6) AS indel FROM t"""


def abbrev_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), F.concat(F.lit("Country "), F.col("n_nationkey").cast("string")).alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" nation "), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment")).alias("text"))
    return exact.expand_abbreviations(c, n)


ABBREV_EXPAND = """WITH n AS (SELECT lower(replace(trim(n_name), '_', ' ')) AS k, max_by('Country ' || n_nationkey::VARCHAR, n_name) AS name FROM nation GROUP BY 1),
q AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN ' nation ' || c_nationkey::VARCHAR ELSE c_mktsegment END AS text FROM customer)
SELECT qid, text, coalesce(name, trim(text)) AS updated FROM q LEFT JOIN n ON lower(trim(text)) = k"""


def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("v")).select(F.to_json(F.create_map("p_brand", F.concat("v", F.array(F.lit(" "), F.lit("Unknown"))))).alias("value"))
    return tables.value_dictionary(rows)


VALUE_DICTIONARY = """SELECT p_brand AS field, p_type AS value, (row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1)::BIGINT AS ord FROM (SELECT DISTINCT p_brand, p_type FROM part)"""


def rich_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    term = F.struct(F.col("n_name").alias("label"), F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("obo_id"), F.array(F.concat(F.lit("A nation. "), F.col("r_name"), F.lit(".; "))).alias("definitions"), F.array("r_name", F.lower("n_name")).alias("synonyms"), F.array("r_name").alias("parents"))
    rows = n.groupBy("r_name").agg(F.to_json(F.struct(F.collect_list(term).alias("terms"))).alias("value"))
    t = tables.envelope_terms(rows)
    return t.select("label", tx.clean_code(F.col("obo_id")).alias("code"), F.array_join("synonyms", "|").alias("synonyms"), tx.rag_context(F.col("label"), F.col("definitions"), F.col("parents"), F.col("children")).alias("context"))


RICH_TERMS = """SELECT n_name AS label, 'N_' || n_nationkey::VARCHAR AS code, r_name || '|' || lower(n_name) AS synonyms,
  n_name || ': definitions: A nation. ' || r_name || '. parents: ' || r_name AS context FROM nation JOIN region ON n_regionkey = r_regionkey"""


def enrich_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    context = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("PART_BRAND", F.col("p_brand")), ("part_type", F.col("p_type")), ("NOTES", F.lit("nan")), ("size", F.col("p_size").cast("string")))))
    return p.select(F.col("p_partkey").alias("qid"), tx.enriched(F.col("p_name"), context, 60).alias("ctx_query"))


ENRICH_QUERY = """WITH s AS (SELECT p_partkey, trim(p_name) AS a, '; Part Brand: ' || trim(p_brand) AS b, '; Part Type: ' || trim(p_type) AS c, '; Size: ' || p_size::VARCHAR AS d FROM part)
SELECT p_partkey AS qid, CASE WHEN length(a || b) > 60 THEN a WHEN length(a || b || c) > 60 THEN a || b WHEN length(a || b || c || d) > 60 THEN a || b || c ELSE a || b || c || d END AS ctx_query FROM s"""


def parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model might give them, one for each part: fenced or not, with unknown fields and wrong confidences."""
    p = table(spark, sf_dir, "part")
    item = lambda f, c: F.concat(F.lit('{"field": "'), f, F.lit('", "confidence": '), c, F.lit("}"))
    body = F.concat(F.lit("["), F.concat_ws(", ", item(F.col("p_type"), F.concat(F.lit("0."), F.col("p_size").cast("string"))), item(F.col("p_brand"), F.lit("0.5")), item(F.lit("nothing"), F.lit("0.9")), item(F.col("p_brand"), F.lit("1.5"))), F.lit("]"))
    answers = p.select(F.col("p_partkey").alias("col"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 7 == 0, F.lit("I can't say.")).otherwise(body).alias("answer"))
    schema = p.select(F.col("p_type").alias("field_name")).unionByName(p.select(F.col("p_brand").alias("field_name")))
    return parse_fields(answers, schema, 2)


PARSE_LLM_JSON = """WITH r AS (SELECT p_partkey AS col, 0 AS pos, p_type AS field, ('0.' || p_size::VARCHAR)::DOUBLE AS score FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 <> 0
  UNION ALL SELECT p_partkey, 1, p_brand, 0.5 FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 7 <> 0)
SELECT col, row_number() OVER (PARTITION BY col ORDER BY score DESC, pos) AS rank, field, round(score, 4) AS score FROM r"""


def parse_alias_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    line = lambda n: F.concat(F.col("p_type"), F.lit(", "), n, F.lit(","), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no"))
    answers = p.select(F.concat(F.lit("```csv\n"), line(F.col("p_name")), F.lit("\n"), line(F.upper("p_name")), F.lit("\nnofield,x,yes\n```")).alias("answer"))
    return parse_aliases(answers, p.select(F.col("p_type").alias("field_name")))


PARSE_ALIAS_CSV = f"""WITH r AS (SELECT p_type AS field_name, p_name AS source, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE '' END AS n FROM part UNION ALL SELECT p_type, upper(p_name), CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE '' END FROM part)
SELECT field_name, min(source) AS source, max(n) AS is_numeric_field FROM r GROUP BY field_name, {norm('source')}"""


QUERIES = {
    "normalize_names": (normalize_names, NORMALIZE_NAMES),
    "split_values": (split_values, SPLIT_VALUES),
    "american_queries": (american_queries, AMERICAN_QUERIES),
    "term_codes": (term_codes, TERM_CODES),
    "unit_family": (unit_family, UNIT_FAMILY),
    "text_similarity": (text_similarity, _text_similarity()),
    "abbrev_expand": (abbrev_expand, ABBREV_EXPAND),
    "value_dictionary": (value_dictionary, VALUE_DICTIONARY),
    "rich_terms": (rich_terms, RICH_TERMS),
    "enrich_query": (enrich_query, ENRICH_QUERY),
    "parse_llm_json": (parse_llm_json, PARSE_LLM_JSON),
    "parse_alias_csv": (parse_alias_csv, PARSE_ALIAS_CSV),
}
