"""Readers and writers of tables, dictionaries and corpora."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

SCHEMA_FIELDS = "field_name string, is_numeric_field string"
ALIASES = "field_name string, source string, is_numeric_field string"
ABBREVIATIONS = "code string, name string"
TERMS = "array<struct<iri:string,label:string,obo_id:string,description:string,definitions:array<string>,synonyms:array<string>,parents:array<string>,children:array<string>,roles:array<struct<type:string,related_name:string,related_code:string>>,type:string>>"
_NAME = re.compile(r"[a-z0-9_]+")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A clinical table: .tsv by tabs, anything else by commas; all columns are text."""
    return spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file by column names, with the types of schema; columns it lacks are null."""
    raw, kinds = read_text_table(spark, path), T.StructType.fromDDL(schema)
    return raw.select(*((F.col(f"`{k.name}`").try_cast(k.dataType) if k.name in raw.columns else F.lit(None).cast(k.dataType)).alias(k.name) for k in kinds))


def to_cells(table: DataFrame, row_id: str | None = None) -> DataFrame:
    """(row_id, col, cell): a wide table of texts made long, in one pass.

    Without a column that numbers the rows, they are numbered in the order of the
    partitions read.
    """
    names = [c for c in table.columns if c != row_id]
    rid = F.col(f"`{row_id}`").cast("long") if row_id else F.monotonically_increasing_id()
    cells = F.array(*(F.struct(F.lit(n).alias("col"), F.col(f"`{n}`").cast("string").alias("cell")) for n in names))
    return table.select(rid.alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.col", "c.cell")


def value_dictionary(json_rows: DataFrame, fields: DataFrame | None = None, column: str = "value") -> DataFrame:
    """(field, value, ord) of JSON texts {field: [values]}; fields (field_name) limits it to a schema."""
    maps = json_rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("field", "vs"))
    out = maps.select("field", F.posexplode("vs").alias("ord", "value")).select("field", F.trim("value").alias("value"), F.col("ord").cast("bigint").alias("ord"))
    out = out.filter((F.col("value") != "") & ~tx.normalize(F.col("value")).isin("", *sorted(tx.NOISE)))
    return out if fields is None else out.join(fields.select(F.col("field_name").alias("field")), "field", "left_semi")


def read_value_dictionary(spark: SparkSession, path: str, fields: DataFrame | None = None) -> DataFrame | None:
    """The dictionary of a JSON file; none for an empty path, a missing file, or no field of the schema."""
    if not path or not exists(spark, path):
        return None
    out = value_dictionary(spark.read.text(path, wholetext=True), fields)
    return None if out.isEmpty() else out


def envelope_terms(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """The terms of JSON envelopes {metadata, terms: [...]}."""
    return json_rows.select(F.inline(F.from_json(column, f"struct<terms:{TERMS}>")["terms"]))


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    return envelope_terms(spark.read.text(path, wholetext=True))


def write_envelope(terms: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Terms as one JSON line for each, with a metadata file beside them."""
    spark = terms.sparkSession
    terms.write.mode("overwrite").json(f"{path}/terms")
    spark.createDataFrame([metadata]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def descendants(json_rows: DataFrame, roots: list[str], column: str = "value") -> DataFrame:
    """(root, code) of JSON texts {root: [codes]}, for these roots; each root is in its own set, even if it is missing."""
    spark = json_rows.sparkSession
    maps = json_rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("root", "codes"))
    found = maps.filter(F.col("root").isin(roots)).select("root", F.explode("codes").alias("code"))
    own = spark.createDataFrame([(r, r) for r in roots], "root string, code string")
    return found.unionByName(own).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def resolve(name: str, user: str | None, bundled: str) -> str:
    """A data file in the user's folder, else among those that came with the package."""
    for folder in filter(None, (user, bundled)):
        if (found := Path(folder) / name).exists():
            return str(found)
    raise FileNotFoundError(f"{name} is neither in {user} nor in {bundled}")


def identifier(name: str) -> str:
    """name, if it can be part of a table or file name."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} has other characters than a-z, 0-9 and _")
    return name


def corpus_path(folder: str, category: str, ontology: str, suffix: str = "") -> str:
    if suffix and not re.fullmatch(r"_[a-z0-9]+", suffix):
        raise ValueError(f"bad suffix {suffix!r}")
    return f"{folder}/{identifier(ontology)}_{identifier(category)}_corpus{suffix}"


def write_result(results: DataFrame, folder: str, name: str, form: str = "csv") -> str:
    """Results as one CSV folder (or Parquet) named for the run."""
    path = f"{folder}/{name}"
    writer = results.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
    return path


def write_corpus(terms: DataFrame, path: str, by: str = "ontology") -> None:
    """A corpus in one folder for each ontology."""
    terms.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
