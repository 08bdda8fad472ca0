"""What a language model is asked for, end to end: prompt, call, parsing, and what becomes of the answer.

A model is ``prompt -> text``, made by a loader in the worker (or, where one question is
asked in all, on the driver). A call that fails, or an answer that can't be read, is no
answer: the rows it was for stay as they were.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import callables, exact

Load = callables.Load
#: Words in the names of columns that hold answers, and must not be shown.
ANSWERS = ("official_label", "curated", "ref_match", "ontology_term_id")
#: What an alias dictionary is asked for, one pass after the other.
PASSES = {
    "synonyms": "Give other names that data sets use for each of these fields.",
    "abbreviations": "Give abbreviations and acronyms of each of these fields.",
    "values": "Give names of columns that hold one value of each of these fields (yes/no columns).",
    "composites": "Give names of columns that combine each of these fields with a unit, time or site.",
    "institutions": "Give names that registries and institutions use for each of these fields.",
}


def schema_model(schema: DataFrame, load: Load, k: int, cells: DataFrame | None = None, parallel: int = 4) -> Callable[[DataFrame], DataFrame]:
    """The model stage of a schema cascade: columns (col) -> (col, rank, field, score).

    The prompt has the first 100 fields by ord, and, with cells, ten values of the column.
    """
    fields = [r["field_name"] for r in schema.groupBy("field_name").agg(F.min("ord").alias("o")).orderBy("o", "field_name").limit(100).collect()]

    def run(columns: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        asked = columns.select("col").distinct()
        if cells is None:
            asked = asked.withColumn("vs", none)
        else:
            # ten of each column's values leave each task
            values = cells.join(asked, "col", "left_semi").filter("cell IS NOT NULL").groupBy("col", "cell").agg(F.lit(1).alias("one"))
            few = exact.first_rows(values, ["col"], ["cell"], 10).groupBy("col").agg(F.array_sort(F.collect_list("cell")).alias("vs"))
            asked = asked.join(few, "col", "left").select("col", F.coalesce("vs", none).alias("vs"))
        prompts = asked.select("col", callables.field_prompt(F.col("col"), F.col("vs"), fields).alias("prompt"))
        return callables.parse_fields(callables.call(prompts, load, parallel).select("col", "answer"), schema, k)

    return run


def rematch(results: DataFrame, model: Callable[[DataFrame], DataFrame], below: float, stages: list[str] | None = None, merge: bool = True) -> DataFrame:
    """Long results (col, stage, method, rank, field, score, source) seen again by a model where the best score is null or low.

    Columns without an answer get one row of the method llm_no_match. merge: with the rows that weren't asked about.
    """
    top = results.groupBy("col").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.min("stage").alias("stage"))
    weak = top.filter(F.col("top").isNull() | (F.col("top") < below))
    weak = weak.filter(F.col("stage").isin(stages)) if stages is not None else weak
    said = model(weak.select("col"))
    found = said.select("col", F.lit("stage4").alias("stage"), F.lit("llm").alias("method"), "rank", "field", "score", F.lit("").alias("source"))
    lost = weak.select("col").join(said.select("col"), "col", "left_anti").select("col", F.lit("stage4").alias("stage"), F.lit("llm_no_match").alias("method"), F.lit(1).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("score"), F.lit("").alias("source"))
    new = found.unionByName(lost)
    return exact.replace_rows(results, new, "col") if merge else new


def rewriter(search: Callable[[DataFrame, int], DataFrame], load: Load, k: int, parallel: int = 5, tries: int = 5) -> Callable[[DataFrame], DataFrame]:
    """The model stage of an ontology cascade: (qid, text) -> (qid, rank, label, score) of the terms it suggests, each searched again."""

    def run(queries: DataFrame) -> DataFrame:
        prompts = queries.select("qid", callables.rewrite_prompt(F.col("text")).alias("prompt"))
        terms = callables.parse_terms(callables.call(prompts, load, parallel, tries).select("qid", "answer"))
        return callables.searched_again(terms, lambda q: search(q, 1), k)

    return run


def context_columns(df: DataFrame, model: Callable[[str], str], tries: int = 3) -> list[str]:
    """Columns that tell apart what a name may mean, as a model chooses; all of them if it gives no list of columns there are.

    Columns that hold answers are never among them. The prompt shows three rows.
    """
    open_ = [c for c in df.columns if not any(word in c.lower() for word in ANSWERS)]
    rows = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in open_)).limit(3).collect()
    shown = {c: [r[c] for r in rows] for c in open_}
    prompt = "Which of these columns help to tell what a disease name means (type, histology, site, tissue; not ids, dates, numbers)? Answer with a JSON list of names.\n" + json.dumps(shown)
    for _ in range(tries):
        try:
            answer = model(prompt)
            said = json.loads(answer[answer.index("[") : answer.rindex("]") + 1])
            if all(c in df.columns for c in said if isinstance(c, str)):
                return [c for c in said if isinstance(c, str) and c in open_]
        except Exception:  # noqa: BLE001 - a model may fail in any way
            continue
    return open_


def alias_dictionary(fields: DataFrame, load: Load, passes: dict[str, str] | None = None, batch: int = 80, parallel: int = 4) -> DataFrame:
    """fields (field_name, ord) -> (field_name, source, is_numeric_field), each normalised pair once.

    Every pass asks for batch fields at a time. Failing answers are left out; an error if nothing is left.
    """
    listed = fields.select("field_name", "ord").filter("field_name IS NOT NULL").groupBy("field_name").agg(F.min("ord").alias("ord"))
    parts = listed.withColumn("part", F.floor(F.col("ord") / batch)).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field_name"))), lambda x: x["field_name"]), "\n").alias("names"))
    asked = parts.select(F.explode(F.array(*(F.lit(p) for p in (passes or PASSES).values()))).alias("ask"), "names")
    prompts = asked.select(F.concat("ask", F.lit(" Answer with CSV lines field_name,source,is_numeric_field.\n"), "names").alias("prompt"))
    found = callables.parse_aliases(callables.call(prompts, load, parallel).select("answer").filter("answer IS NOT NULL"), fields)
    if found.isEmpty():
        raise ValueError("no answer holds an alias of these fields")
    return found


def variants(terms: DataFrame, load: Load, batch: int = 50, parallel: int = 4) -> DataFrame:
    """terms (canonical, ord) -> (variant, canonical): other spellings, as the model gives them in {term: [variant]}."""
    parts = terms.withColumn("part", F.floor(F.col("ord") / batch)).groupBy("part").agg(F.to_json(F.array_sort(F.collect_set("canonical"))).alias("names"))
    prompts = parts.select(F.concat(F.lit("Give other spellings of each term as a JSON object of lists: "), "names").alias("prompt"))
    said = callables.call(prompts, load, parallel)
    body = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "map<string,array<string>>")
    rows = said.select(F.explode(body).alias("canonical", "vs")).select("canonical", F.explode("vs").alias("variant"))
    return rows.join(terms.select("canonical").distinct(), "canonical", "left_semi").select(F.trim("variant").alias("variant"), "canonical").filter("variant <> ''").distinct()


def mode_of(df: DataFrame, truth: str = "curated_ontology") -> str:
    """test if there is a column of truths with any value, else prod."""
    return "test" if truth in df.columns and not df.filter(F.col(truth).isNotNull()).isEmpty() else "prod"


def model_coherence(load: Load) -> Callable[[list[str]], float]:
    """A judge of clusters: how alike these names are, from 0 to 1, as a model says; 0 if it doesn't."""
    def judge(names: list[str]) -> float:
        try:
            said = re.search(r"\b(0(?:\.\d+)?|1(?:\.0+)?)\b", load()("How coherent is this group of column names, from 0 to 1? " + ", ".join(names)) or "")
        except Exception:  # noqa: BLE001
            return 0.0
        return float(said[1]) if said else 0.0

    return judge


def model_veto(load: Load, names: list[str]) -> Callable[[list[int], list[int]], bool]:
    """A judge of splits: forbids one of which the model says that both halves belong together."""

    def veto(a: list[int], b: list[int]) -> bool:
        try:
            said = load()(f"Do these two groups of columns describe different things? Answer yes or no. A: {', '.join(names[i] for i in a)}. B: {', '.join(names[i] for i in b)}")
        except Exception:  # noqa: BLE001
            return False
        return (said or "").strip().lower().startswith("no")

    return veto
