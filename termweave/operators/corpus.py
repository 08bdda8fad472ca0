"""Corpora: normalising, hashing, joining and splitting tables of ontology terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

TERM_COLUMNS = ("iri", "ontology_name", "ontology_prefix", "short_form", "description", "label", "obo_id", "type")


def require(df: DataFrame, *any_of: tuple[str, ...]) -> DataFrame:
    """df, if it has at least one column of each group."""
    for names in any_of:
        if not set(names) & set(df.columns):
            raise ValueError(f"one of the columns {', '.join(names)} is needed; there are {', '.join(df.columns)}")
    return df


def conform(terms: DataFrame) -> DataFrame:
    """The eight term columns in their order, missing ones empty."""
    return terms.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in terms.columns else F.lit("")).alias(c) for c in TERM_COLUMNS))


def normalize_corpus(terms: DataFrame, filter_obsolete: bool = True) -> DataFrame:
    """(official_label, clean_code) of any table with labels and codes, without nulls and repeats."""
    require(terms, ("official_label", "label"), ("clean_code", "obo_id", "short_form"))
    pick = lambda *names: F.coalesce(*(F.trim(F.col(n).cast("string")) for n in names if n in terms.columns))
    code = tx.clean_code(pick("obo_id")) if "obo_id" in terms.columns else None
    codes = [c for c in (F.col("clean_code").cast("string") if "clean_code" in terms.columns else None, code, F.col("short_form").cast("string") if "short_form" in terms.columns else None) if c is not None]
    out = terms.select(pick("official_label", "label").alias("official_label"), F.coalesce(*codes).alias("clean_code"))
    out = out.filter("official_label <> '' AND clean_code <> ''").distinct()
    return out.filter(~tx.key(F.col("official_label")).startswith("obsolete_")) if filter_obsolete else out


def corpus_hash(corpus: DataFrame, digits: int = 8) -> DataFrame:
    """One row: the first hex digits of the SHA-256 of the sorted code, tab, label lines.

    The lines are hashed on the way: a corpus has as many lines as an ontology terms.
    """
    line = F.concat("clean_code", F.lit("\t"), "official_label")
    text = F.array_join(F.array_sort(F.collect_set(line)), "\n")
    return corpus.agg(F.substring(F.sha2(text, 256), 1, digits).alias("hash"))


def union_terms(*parts: DataFrame) -> DataFrame:
    """Term tables in order of precedence, one row for each obo_id, else IRI, else label; the first wins."""
    all_ = None
    for i, p in enumerate(parts):
        part = conform(p).withColumn("_part", F.lit(i))
        all_ = part if all_ is None else all_.unionByName(part)
    k = F.when(F.col("obo_id") != "", F.col("obo_id")).when(F.col("iri") != "", F.col("iri")).otherwise(F.concat(F.lit("label::"), F.lower("label")))
    first = Window.partitionBy("_k").orderBy("_part", "label", "iri")
    return all_.withColumn("_k", k).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(*TERM_COLUMNS)


def with_ontology(codes: DataFrame, column: str = "clean_code") -> DataFrame:
    """Codes with their ontology; unknown prefixes have null and are left out of builds."""
    return codes.withColumn("ontology", tx.ontology(F.col(column)))


def single_source(codes: DataFrame, column: str = "clean_code") -> str:
    """The one ontology of a corpus; an error if there are several (or none)."""
    found = [r[0] for r in with_ontology(codes, column).filter("ontology IS NOT NULL").select("ontology").distinct().limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"the corpus must be of one ontology, not {sorted(found)}")
    return found[0]


def synonym_rows(terms: DataFrame) -> DataFrame:
    """terms (label, code, synonyms) -> (synonym, official_label, code): each label is its own synonym."""
    all_ = F.array_distinct(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    rows = terms.select(F.explode(F.filter(all_, lambda s: s.isNotNull() & (F.trim(s) != ""))).alias("synonym"), F.col("label").alias("official_label"), "code")
    return rows.distinct()


def context_rows(terms: DataFrame) -> DataFrame:
    """terms (label, code, definitions, parents, children) -> (term, code, context), one row for each code."""
    best = Window.partitionBy("code").orderBy("label")
    ctx = tx.rag_context(F.col("label"), F.col("definitions"), F.col("parents"), F.col("children"))
    return terms.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(F.col("label").alias("term"), "code", ctx.alias("context"))


def schema_terms(registry: DataFrame) -> DataFrame:
    """Registry rows (col.name, allowedvalues, static.enum, dynamic.enum, dynamic.enum.property, corpus.type)
    -> (field, term, obo_id, kind): enumerated values that aren't a pattern, static terms, roots of dynamic ones."""
    name = F.col("`col.name`").alias("field")
    allowed = registry.filter(~F.coalesce(tx.is_pattern(F.col("allowedvalues")), F.lit(False))).select(name, F.explode(tx.enum_values(F.col("allowedvalues"))).alias("term"), F.lit("").alias("obo_id"), F.lit("value").alias("kind"))
    static = registry.select(name, F.explode(tx.enum_values(F.col("`static.enum`"))).alias("t")).select("field", F.lit("").alias("term"), tx.obo_id(F.col("t")).alias("obo_id"), F.lit("static").alias("kind"))
    how = tx.enum_values(F.col("`dynamic.enum.property`"))
    roots = registry.select(name, F.posexplode(tx.enum_values(F.col("`dynamic.enum`"))).alias("p", "t"), how.alias("how"))
    dynamic = roots.select("field", F.lit("").alias("term"), tx.obo_id(F.col("t")).alias("obo_id"), F.coalesce(F.try_element_at("how", F.col("p") + 1), F.try_element_at("how", F.lit(1)), F.lit("descendant")).alias("kind"))
    return allowed.unionByName(static).unionByName(dynamic).distinct()


def has_corpus(registry: DataFrame) -> DataFrame:
    """Registry rows with any enumeration."""
    filled = [F.coalesce(F.size(tx.enum_values(F.col(f"`{c}`"))), F.lit(0)) > 0 for c in ("dynamic.enum", "allowedvalues", "static.enum")]
    return registry.filter(filled[0] | filled[1] | filled[2])


def label_lookup(terms: DataFrame) -> DataFrame:
    """terms (label, synonyms) -> (labels, synonym_lookup): all labels, and a map of each lower-case synonym to its label."""
    rows = synonym_rows(terms.withColumn("code", F.lit(""))).groupBy(F.lower("synonym").alias("k")).agg(F.min("official_label").alias("v"))
    lookup = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("synonym_lookup"))
    return terms.agg(F.array_sort(F.collect_set("label")).alias("labels")).crossJoin(lookup)


def table_stats(rows: DataFrame) -> DataFrame:
    """Rows, distinct labels and distinct codes of a table (…, official_label, code)."""
    return rows.agg(F.count("*").alias("total"), F.countDistinct("official_label").alias("labels"), F.countDistinct("code").alias("codes"))


def official_labels(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """rows (…, code, label) with the official label of their code and whether it differs."""
    labels = corpus.groupBy(F.col("clean_code").alias("_c")).agg(F.min("official_label").alias("official_label"))
    joined = rows.join(labels, F.col("code") == F.col("_c"), "left").drop("_c")
    return joined.withColumn("mismatch", F.coalesce(tx.key(F.col("label")) != tx.key(F.col("official_label")), F.lit(False)))
