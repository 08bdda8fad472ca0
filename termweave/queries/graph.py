"""Queries of taxonomies, corpora, services and the knowledge base."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus, taxonomy
from ..operators.callables import parse_terms, searched_again
from ..operators.encoders import HashedGrams, encode_cached
from ..plans import ontology
from ..sources import remote, tables
from ..sources.knowledge import KnowledgeBase
from ..storage import shared_dir
from .common import labels, table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child): regions above nations above customers."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = n.select(F.format_string("R%d", "n_regionkey").alias("parent"), F.format_string("N%d", "n_nationkey").alias("child"))
    return up.unionByName(c.select(F.format_string("N%d", "c_nationkey").alias("parent"), F.format_string("C%d", "c_custkey").alias("child")))


EDGES = "edges AS (SELECT 'R' || n_regionkey::VARCHAR AS parent, 'N' || n_nationkey::VARCHAR AS child FROM nation UNION ALL SELECT 'N' || c_nationkey::VARCHAR, 'C' || c_custkey::VARCHAR FROM customer)"


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.descendants(edges(spark, sf_dir), table(spark, sf_dir, "region").select(F.format_string("R%d", "r_regionkey").alias("root")))


DESCENDANTS = f"""WITH RECURSIVE {EDGES}, below AS (SELECT 'R' || r_regionkey::VARCHAR AS root, 'R' || r_regionkey::VARCHAR AS code, 0 AS depth FROM region
  UNION ALL SELECT root, child, depth + 1 FROM below JOIN edges ON parent = code)
SELECT root, code, min(depth)::BIGINT AS depth FROM below GROUP BY root, code"""


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.ancestors(edges(spark, sf_dir), table(spark, sf_dir, "customer").select(F.format_string("C%d", "c_custkey").alias("code")))


ANCESTORS = f"""WITH RECURSIVE {EDGES}, up AS (SELECT 'C' || c_custkey::VARCHAR AS code, 'C' || c_custkey::VARCHAR AS ancestor, 0 AS hops FROM customer
  UNION ALL SELECT code, parent, hops + 1 FROM up JOIN edges ON child = ancestor WHERE hops < {taxonomy.HOPS})
SELECT code, ancestor, min(hops)::BIGINT AS hops FROM up GROUP BY code, ancestor"""


def concept_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the segments of their nation's list (even nations only), else by the region above them."""
    c, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    concepts = c.select(F.col("c_name").alias("value"), F.format_string("C%d", "c_custkey").alias("code"))
    members = c.filter("c_nationkey % 2 = 0").select(F.col("c_mktsegment").alias("category"), F.format_string("C%d", "c_custkey").alias("code"))
    return taxonomy.categories(concepts, members, edges(spark, sf_dir), r.select(F.col("r_name").alias("category"), F.format_string("R%d", "r_regionkey").alias("code")))


CONCEPT_CATEGORIES = """SELECT DISTINCT c_name AS value, c_mktsegment AS category FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT DISTINCT c_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_nationkey % 2 <> 0"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "region").select(F.format_string("R%d", "r_regionkey").alias("code"), F.col("r_name").alias("label")).unionByName(table(spark, sf_dir, "nation").select(F.format_string("N%d", "n_nationkey").alias("code"), F.col("n_name").alias("label")))
    found = taxonomy.term_neighbours(edges(spark, sf_dir), named)
    return found.select("code", "label", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"))


NEIGHBOURS = """SELECT 'R' || r_regionkey::VARCHAR AS code, r_name AS label, '' AS parents, string_agg(n_name, '|' ORDER BY n_name) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT 'N' || n_nationkey::VARCHAR, n_name, r_name, '' FROM nation JOIN region ON r_regionkey = n_regionkey"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus with labels and CURIEs of three ontologies, some obsolete: one term for each part."""
    p = table(spark, sf_dir, "part")
    prefix = F.element_at(F.array(F.lit("NCIT:C"), F.lit("UBERON:"), F.lit("COB:")), (F.col("p_partkey") % 3 + 1).cast("int"))
    label = F.when(F.col("p_size") == 1, F.concat(F.lit("obsolete_"), "p_name")).otherwise(F.col("p_name"))
    return p.select(label.alias("label"), F.concat(prefix, F.col("p_partkey").cast("string")).alias("obo_id"))


TERMS = "terms AS (SELECT CASE WHEN p_size = 1 THEN 'obsolete_' ELSE '' END || p_name AS label, (['NCIT:C', 'UBERON:', 'COB:'])[p_partkey % 3 + 1] || p_partkey::VARCHAR AS obo_id FROM part)"
_CORPUS = f"{TERMS}, corpus AS (SELECT DISTINCT label AS official_label, CASE WHEN starts_with(obo_id, 'NCIT:') THEN substring(obo_id, 6) ELSE replace(obo_id, ':', '_') END AS clean_code FROM terms WHERE NOT starts_with(label, 'obsolete_'))"


def corpus_by_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_ontology(corpus.normalize_corpus(terms(spark, sf_dir)))


CORPUS_BY_ONTOLOGY = f"WITH {_CORPUS} SELECT official_label, clean_code, CASE WHEN NOT contains(clean_code, '_') THEN 'ncit' WHEN starts_with(clean_code, 'UBERON_') THEN 'uberon' END AS ontology FROM corpus"


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_hash(corpus.normalize_corpus(terms(spark, sf_dir)))


CORPUS_HASH = f"WITH {_CORPUS} SELECT substring(sha256(string_agg(clean_code || chr(9) || official_label, chr(10) ORDER BY clean_code || chr(9) || official_label)), 1, 8) AS hash FROM corpus"


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of terms, the later ones with terms of the earlier."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("UBERON:"), F.col("p_partkey").cast("string"))
    a = p.filter("p_size <= 20").select("p_name", code.alias("obo_id")).withColumnRenamed("p_name", "label").withColumn("type", F.lit("class"))
    b = p.filter("p_size > 10").select(F.upper("p_name").alias("label"), code.alias("obo_id"))
    c = p.select(F.col("p_type").alias("label"), F.lit("").alias("obo_id"), F.when(F.col("p_size") > 40, F.concat(F.lit("http://x/"), "p_type")).alias("iri"))
    return corpus.union_terms(a, b, c)


CORPUS_UNION = """WITH u AS (SELECT 0 AS part, p_name AS label, 'UBERON:' || p_partkey::VARCHAR AS obo_id, '' AS iri, 'class' AS type FROM part WHERE p_size <= 20
  UNION ALL SELECT 1, upper(p_name), 'UBERON:' || p_partkey::VARCHAR, '', '' FROM part WHERE p_size > 10 UNION ALL SELECT 2, p_type, '', CASE WHEN p_size > 40 THEN 'http://x/' || p_type ELSE '' END, '' FROM part)
SELECT iri, '' AS ontology_name, '' AS ontology_prefix, '' AS short_form, '' AS description, label, obo_id, type FROM u
QUALIFY row_number() OVER (PARTITION BY CASE WHEN obo_id <> '' THEN obo_id WHEN iri <> '' THEN iri ELSE 'label::' || lower(label) END ORDER BY part, label, iri) = 1"""


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms (label, code, synonyms, definitions, parents, children): the nations in their regions."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    return n.select(F.col("n_name").alias("label"), F.format_string("N%d", "n_nationkey").alias("code"), F.array(F.lower("n_name"), "n_name", F.lit(" "), F.concat("n_name", F.lit(" of "), "r_name")).alias("synonyms"), F.array(F.concat(F.lit("In "), "r_name", F.lit("."))).alias("definitions"), F.array("r_name").alias("parents"), none.alias("children"))


def synonym_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synonym_rows(_rich(spark, sf_dir))


SYNONYM_TABLE = """WITH n AS (SELECT n_name, r_name, 'N' || n_nationkey::VARCHAR AS code FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_name AS synonym, n_name AS official_label, code FROM n UNION SELECT lower(n_name), n_name, code FROM n UNION SELECT n_name || ' of ' || r_name, n_name, code FROM n"""


def context_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.context_rows(_rich(spark, sf_dir))


CONTEXT_TABLE = "SELECT n_name AS term, 'N' || n_nationkey::VARCHAR AS code, n_name || ': definitions: In ' || r_name || '. parents: ' || r_name AS context FROM nation JOIN region ON r_regionkey = n_regionkey"


def schema_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of enumerated columns, one for each part."""
    p = table(spark, sf_dir, "part")
    registry = p.select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("col.name"),
        F.when(F.col("p_partkey") % 3 == 0, "^[0-9]+$").when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("| NA|"), "p_brand")).alias("allowedvalues"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("NCIT:C"), F.col("p_size").cast("string"))).alias("static.enum"),
        F.when(F.col("p_size") <= 5, F.lit("UBERON_0001|EFO:2")).alias("dynamic.enum"),
        F.when(F.col("p_size") <= 2, "children").alias("dynamic.enum.property"),
    )
    return corpus.schema_terms(corpus.has_corpus(registry))


SCHEMA_CORPUS = """WITH r AS (SELECT 'f' || p_partkey::VARCHAR AS field, * FROM part)
SELECT DISTINCT field, unnest([p_type, p_brand]) AS term, '' AS obo_id, 'value' AS kind FROM r WHERE p_partkey % 3 = 1
UNION ALL SELECT field, '', 'NCIT:C' || p_size::VARCHAR, 'static' FROM r WHERE p_size > 25
UNION ALL SELECT field, '', unnest(['UBERON:0001', 'EFO:2']), CASE WHEN p_size <= 2 THEN 'children' ELSE 'descendant' END FROM r WHERE p_size <= 5"""


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.label_lookup(_rich(spark, sf_dir))
    return found.select(F.array_join("labels", "|").alias("labels"), F.explode("synonym_lookup").alias("synonym", "label"))


LABEL_LOOKUP = """WITH n AS (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey), s AS (SELECT lower(n_name) AS synonym, n_name FROM n UNION SELECT lower(n_name || ' of ' || r_name), n_name FROM n)
SELECT (SELECT string_agg(n_name, '|' ORDER BY n_name) FROM nation) AS labels, synonym, min(n_name) AS label FROM s GROUP BY synonym"""


def official_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have another label than their code's."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").cast("string").alias("clean_code"), F.col("p_name").alias("official_label"))
    rows = p.select(F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.upper("p_name")).alias("label"))
    return corpus.official_labels(rows, own).groupBy("mismatch").agg(F.count("*").alias("n"), F.countDistinct("official_label").alias("labels"))


OFFICIAL_LABELS = "SELECT p_size % 5 = 0 AND lower(p_brand) <> lower(p_name) AS mismatch, count(*) AS n, count(DISTINCT p_name) AS labels FROM part GROUP BY 1"


def knowledge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms appended to a knowledge base twice, and its counts."""
    kb = KnowledgeBase(spark, f"{shared_dir(spark)}/kb-{uuid.uuid4().hex}")
    p = table(spark, sf_dir, "part")
    rows = p.select(F.lower("p_name").alias("synonym"), F.col("p_name").alias("official_label"), F.col("p_brand").alias("code"))
    kb.append("synonyms", "parts", rows.filter("p_size <= 20"))
    kb.append("synonyms", "parts", rows)
    return kb.stats("parts")


KNOWLEDGE_STATS = "SELECT count(*) AS total, count(DISTINCT p_name) AS labels, count(DISTINCT p_brand) AS codes FROM (SELECT DISTINCT p_name, p_brand FROM part)"


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus in a folder for each ontology, and a table of texts as CSV, both read again."""
    folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    tables.write_corpus(corpus_by_ontology(spark, sf_dir).filter("ontology IS NOT NULL"), f"{folder}/corpus")
    counts = spark.read.parquet(f"{folder}/corpus").groupBy("ontology").agg(F.count("*").alias("n"))
    tables.write_result(table(spark, sf_dir, "customer"), folder, "customer")
    cells = tables.to_cells(tables.read_text_table(spark, f"{folder}/customer").select("c_name", "c_mktsegment"))
    return counts.unionByName(cells.groupBy(F.col("col").alias("ontology")).agg(F.countDistinct("cell").alias("n")))


STORED_TABLES = f"""WITH {_CORPUS} SELECT CASE WHEN contains(clean_code, '_') THEN 'uberon' ELSE 'ncit' END AS ontology, count(*) AS n FROM corpus WHERE NOT starts_with(clean_code, 'COB_') GROUP BY 1
UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer"""


def service_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept payloads of a service's snapshot as context lines."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    payload = F.to_json(F.struct(F.col("n_name").alias("name"), F.array(F.struct(F.lower("n_name").alias("name"))).alias("synonyms"), F.array(F.struct(F.lit("A nation.").alias("definition"))).alias("definitions"), F.array(F.struct(F.col("r_name").alias("name"))).alias("parents")))
    snapshot = n.select(F.format_string("N%d", "n_nationkey").alias("key"), payload.alias("body"))
    asked = table(spark, sf_dir, "customer").select(F.format_string("N%d", "c_nationkey").alias("key"))
    return remote.concept_context(remote.concepts(remote.from_snapshot(asked, snapshot)))


SERVICE_CONCEPTS = """SELECT DISTINCT 'N' || n_nationkey::VARCHAR AS code, n_name AS label, 'synonyms: ' || lower(n_name) || '. definitions: A nation. parents: ' || r_name AS context
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


def encode_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encoded by way of a cache that has those of the small parts: vectors of each name, and rows that were new."""
    p = table(spark, sf_dir, "part")
    encoder = HashedGrams(64)
    _, cache = encode_cached(p.filter("p_size <= 10").select(F.col("p_name").alias("text")), None, encoder)
    texts, new = encode_cached(p.select(F.upper("p_name").alias("text")), cache, encoder)
    seen = texts.agg(F.count("*").alias("texts"), F.sum((F.size("embedding") == 64).cast("bigint")).alias("encoded"))
    return seen.crossJoin(new.agg(F.count("*").alias("new_rows")))


ENCODE_ONCE = "SELECT count(*) AS texts, count(*) AS encoded, (SELECT count(DISTINCT p_name) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 10)) AS new_rows FROM part"


def rewritten_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's suggestions for every part, each searched again: exact names come first."""
    p, known = table(spark, sf_dir, "part"), labels(spark, sf_dir)
    answers = p.select(F.col("p_partkey").alias("qid"), F.concat(F.lit('```json\n["'), "p_name", F.lit('", {"term": "'), F.upper("p_name"), F.lit('"}, "", "qqqq"]\n```')).alias("answer"))
    return searched_again(parse_terms(answers), lambda asked: ontology.gram_search(known)(asked, 1), 3)


REWRITTEN_TERMS = "SELECT p_partkey AS qid, 1::BIGINT AS rank, p_name AS label, 1.0::DOUBLE AS score FROM part"


def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth sets, flags, enumerations and count-like names, as counts of each outcome."""
    p = table(spark, sf_dir, "part")
    truths = F.array_join(tx.pipe_set(F.concat("p_brand", F.lit("|nan| "), "p_type")), ",")
    flag = tx.yes_flag(F.element_at(F.array(F.lit("True"), F.lit("no"), F.lit("1"), F.lit("YES")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return p.select(truths.alias("truths"), flag.alias("flag"), tx.is_pattern(F.when(F.col("p_size") > 9, "p_type").otherwise("^x{2}")).alias("pattern")).groupBy("truths", "flag", "pattern").agg(F.count("*").alias("n"))


TEXT_CODES = """SELECT array_to_string(list_sort([p_brand, p_type]), ',') AS truths, CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'yes' END AS flag, p_size <= 9 AS pattern, count(*) AS n FROM part GROUP BY ALL"""


QUERIES = {
    "descendants": (descendants, DESCENDANTS),
    "ancestors": (ancestors, ANCESTORS),
    "concept_categories": (concept_categories, CONCEPT_CATEGORIES),
    "term_neighbours": (neighbours, NEIGHBOURS),
    "corpus_by_ontology": (corpus_by_ontology, CORPUS_BY_ONTOLOGY),
    "corpus_hash": (corpus_hash, CORPUS_HASH),
    "corpus_union": (corpus_union, CORPUS_UNION),
    "synonym_table": (synonym_table, SYNONYM_TABLE),
    "context_table": (context_table, CONTEXT_TABLE),
    "schema_corpus": (schema_corpus, SCHEMA_CORPUS),
    "label_lookup": (label_lookup, LABEL_LOOKUP),
    "official_labels": (official_labels, OFFICIAL_LABELS),
    "knowledge_stats": (knowledge_stats, KNOWLEDGE_STATS),
    "stored_tables": (stored_tables, STORED_TABLES),
    "service_concepts": (service_concepts, SERVICE_CONCEPTS),
    "encode_once": (encode_once, ENCODE_ONCE),
    "rewritten_terms": (rewritten_terms, REWRITTEN_TERMS),
    "text_codes": (text_codes, TEXT_CODES),
}
