"""The corpus pipeline: documents through five of the operators, in order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
What it returns is written as Parquet and read again as the next stage's docs.

Defined cases, of all stages: rows with a null id stay (packed as null), as they are in
no group of copies; null texts are rejected by the quality rules, and pass the other
stages untouched (length 0 in the packing); empty texts likewise, one of them for exact
dedup; texts of any length are read whole; rows with one id and text are copies of each
other; ties go to the least id; other columns stay as they are, whatever their names
(all but the packing); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bestfit_packing, chunk_dedup, repetition, simhash_dedup, suffix_dedup, token_counts
from termweave.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much, or have no word (null and empty texts), go."""
    return docs.filter(repetition.keeps(F.col("text")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the least id (null only if all are); null texts stay."""
    return chunk_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id; null ids and texts without words stay."""
    return simhash_dedup.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in their first place (by id) only; documents that are nothing else go; null ids, null and short texts stay."""
    return suffix_dedup.drop_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of tokens that the documents are packed into; texts without a token take no room."""
    return bestfit_packing.pack_documents(docs, length=token_counts.tokens(F.col("text")))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("passage dedup", passage_dedup),
    ("packing", packing),
]

#: SQL can't express SimHash, content-defined chunks or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
