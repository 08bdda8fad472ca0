"""Language models and other judges as user functions: prompts, parsing, and calls in bounded parallelism.

A model is ``prompt -> text``, made in the worker by a loader; nothing here knows a
provider. Any failure of a call is an empty answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.remote import back_off

Load = Callable[[], Callable[[str], str]]


def call(prompts: DataFrame, load: Load, parallel: int = 4, tries: int = 3) -> DataFrame:
    """prompts (prompt, …) with answer; each distinct prompt is asked once, by at most parallel workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                answer = None
                for n in range(tries):
                    try:
                        answer = model(p)
                        break
                    except Exception as e:  # noqa: BLE001 - a model may fail in any way; the row goes on without an answer
                        if n + 1 < tries:
                            time.sleep(back_off(n, getattr(e, "retry_after", None), busy=getattr(e, "status", None) == 429 or "429" in str(e)))
                out.append(answer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["prompt", "answer"])

    asked = prompts.select("prompt").distinct().repartition(parallel).mapInArrow(run, "prompt string, answer string")
    return prompts.join(asked, "prompt", "left")


def json_list(answer: Column) -> Column:
    """The JSON list in an answer, with or without a code fence."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)(\[.*\])", 1)


def parse_fields(answers: DataFrame, schema: DataFrame, k: int) -> DataFrame:
    """answers (col, answer) of [{field, confidence, …}] -> (col, rank, field, score): known fields, confidence in [0, 1]."""
    items = F.from_json(json_list(F.col("answer")), "array<struct<field:string,confidence:string>>")
    rows = answers.select("col", F.posexplode(items).alias("pos", "x")).select("col", "pos", F.trim("x.field").alias("field"), F.col("x.confidence").try_cast("double").alias("score"))
    good = rows.filter(F.col("score").between(0, 1)).join(schema.select(F.col("field_name").alias("field")).distinct(), "field", "left_semi")
    order = Window.partitionBy("col").orderBy(F.desc("score"), "pos")
    return good.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("col", "rank", "field", F.round("score", 4).alias("score"))


def parse_terms(answers: DataFrame) -> DataFrame:
    """answers (qid, answer) of [term or {term}] -> (qid, pos, term), without blanks; what isn't a list gives none."""
    parts = F.from_json(json_list(F.col("answer")), "array<string>")
    rows = answers.select("qid", F.posexplode(parts).alias("pos", "x"))
    term = F.trim(F.when(F.col("x").startswith("{"), F.coalesce(F.get_json_object("x", "$.term"), F.get_json_object("x", "$.name"))).otherwise(F.col("x")))
    return rows.select("qid", F.col("pos").cast("bigint").alias("pos"), term.alias("term")).filter("term <> ''")


def parse_number(answer: Column) -> Column:
    """The first number in [0, 1] of an answer, else 0."""
    return F.coalesce(F.regexp_extract(answer, r"\b(0(?:\.\d+)?|1(?:\.0+)?)\b", 1).try_cast("double"), F.lit(0.0))


def parse_aliases(answers: DataFrame, schema: DataFrame) -> DataFrame:
    """answers (answer) of CSV lines field,alias,numeric -> (field_name, source, is_numeric_field), each normalised pair once."""
    from ..functions import text as tx

    lines = answers.select(F.explode(F.split(F.regexp_replace("answer", r"```[a-zA-Z]*", ""), r"\r?\n")).alias("line")).select(F.from_csv("line", F.lit("f string, s string, n string")).alias("r")).select("r.*")
    rows = lines.select(F.trim("f").alias("field_name"), F.trim("s").alias("source"), tx.yes_flag(F.col("n")).alias("is_numeric_field")).filter("field_name <> '' AND source <> ''")
    rows = rows.join(schema.select("field_name").distinct(), "field_name", "left_semi")
    return rows.groupBy("field_name", tx.normalize(F.col("source")).alias("k")).agg(F.min("source").alias("source"), F.max("is_numeric_field").alias("is_numeric_field")).drop("k")


def field_prompt(column: Column, values: Column, fields: list[str], most: int = 100) -> Column:
    """What a model is asked for one column."""
    choices = ", ".join(fields[:most])
    return F.concat(F.lit("Which of these fields does the column hold? Fields: " + choices + ". Column: "), column, F.lit(". Values: "), F.array_join(F.slice(values, 1, 10), ", "), F.lit('. Answer with a JSON list of {"field": name, "confidence": number from 0 to 1}, best first.'))


def rewrite_prompt(term: Column, most: int = 5) -> Column:
    return F.concat(F.lit(f"Give up to {most} standard clinical terms, as a JSON list of texts, for: "), term)


def searched_again(terms: DataFrame, search: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Suggested terms (qid, pos, term) each by its best hit: search takes (qid, text), gives (qid, label, score, rank).

    Labels once for each query, in the order of the suggestions.
    """
    asked = terms.select(F.xxhash64("term").alias("tid"), "term").distinct()
    hits = search(asked.select(F.col("tid").alias("qid"), F.col("term").alias("text"))).filter("rank = 1").select(F.col("qid").alias("tid"), "label", "score")
    found = terms.withColumn("tid", F.xxhash64("term")).join(hits, "tid").groupBy("qid", "label").agg(F.min(F.struct("pos", F.col("score"))).alias("p"))
    order = Window.partitionBy("qid").orderBy("p.pos", "label")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("qid", "rank", "label", F.col("p.score").alias("score"))


def rematch_rows(results: DataFrame, below: float, stages: list[str]) -> DataFrame:
    """The results (stage, match1_score) that a model should see again."""
    score = F.col("match1_score").try_cast("double")
    return results.filter(F.col("stage").isin(stages) & (score.isNull() | (score < below)))
