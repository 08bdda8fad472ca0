"""Where a corpus of terms comes from, and how one is built from a taxonomy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..sources.tables import exists

#: Categories and the ontologies they can be had of.
REGISTRY = {"disease": ("ncit", "mondo"), "bodysite": ("ncit", "uberon"), "treatment": ("ncit", "chebi")}
#: Ontologies whose corpora aren't built, only given.
STATIC = frozenset(("chebi",))


def resolve(spark: SparkSession, category: str, ontology: str, provided: DataFrame | None = None, cached: str | None = None, build: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """(corpus, where it is from): what is provided, else the cached CSV, else what build gives, which is cached.

    Only pairs of the registry, unless the corpus is provided; static ones are never built.
    """
    if provided is not None:
        return provided, "provided"
    if ontology not in REGISTRY.get(category, ()):
        raise ValueError(f"there is no corpus of {category} in {ontology}")
    if cached and exists(spark, cached):
        return spark.read.csv(cached, header=True, escape='"'), "cached"
    if ontology in STATIC:
        raise ValueError(f"the corpus of {category} in {ontology} must be given")
    if build is None:
        raise ValueError("nothing can build the corpus")
    built = build()
    if cached:
        built.write.csv(cached, header=True, escape='"')
        built = spark.read.csv(cached, header=True, escape='"')
    return built, "built"


def branch(edges: DataFrame, labels: DataFrame, roots: DataFrame, reach: str = "descendant") -> DataFrame:
    """(code, label, parents, children) of all below the roots (root), which are left out themselves.

    edges (parent, child), labels (code, label); reach: descendant, or children only. A code below
    several roots is there once, one without a label not at all.
    """
    if reach not in ("descendant", "children"):
        raise ValueError(reach)
    below = taxonomy.descendants(edges, roots, 1 if reach == "children" else None).filter("depth > 0").select("code").distinct()
    below = below.join(roots.select(F.col("root").alias("code")), "code", "left_anti")
    return taxonomy.term_neighbours(edges, labels).join(below, "code", "left_semi")


def routed(codes: DataFrame) -> DataFrame:
    """codes (code) with the service that has them: nci for NCIt codes, ols for other known prefixes, null for the rest."""
    from ..functions import text as tx

    found = tx.ontology(tx.clean_code(F.col("code")))
    return codes.select("code", F.when(found == "ncit", "nci").when(found.isNotNull(), "ols").alias("service"))
