"""Column names to standard fields: a cascade of strategies over all columns at once.

Inside a stage, strategies run in order on the columns that none has settled (best
score at its threshold); a column that none settles keeps the best it got. A stage
sees the columns that the stages before gave nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import exact, fusion, topk, votes
from ..sources.settings import Settings

COLUMNS = ["col", "rank", "field", "score", "source"]


@dataclass(frozen=True)
class Strategy:
    """run takes columns (col), gives (col, rank, field, score, source); settled at threshold."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    threshold: float


def cascade(columns: DataFrame, strategies: list[Strategy], cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(col, rank, field, score, source, method): of the strategies up to the first that settles a column, the best (the earlier for equal scores)."""
    left, found = columns.select("col").distinct(), None
    for i, s in enumerate(strategies):
        one = cut(s.run(left).select(*COLUMNS)).withColumns({"method": F.lit(s.name), "_i": F.lit(i)})
        found = one if found is None else found.unionByName(one)
        if i + 1 < len(strategies):  # cut off, so that no strategy runs those before it again
            left = cut(left.join(one.filter((F.col("rank") == 1) & (F.col("score") >= s.threshold)).select("col"), "col", "left_anti"))
    top = Window.partitionBy("col").orderBy(F.desc("score"), "_i")
    best = found.filter("rank = 1").withColumn("_r", F.row_number().over(top)).filter("_r = 1").select("col", "_i")
    return found.join(best, ["col", "_i"]).drop("_i")


def fuzzy_standard(schema: DataFrame, k: int, at_least: float) -> Callable[[DataFrame], DataFrame]:
    names = schema.groupBy(tx.normalize(F.col("field_name")).alias("cid")).agg(F.max_by("field_name", "ord").alias("field"))

    def run(columns: DataFrame) -> DataFrame:
        hits = topk.token_topk(columns.select(F.col("col").alias("qid"), tx.normalize(F.col("col")).alias("text")), names.select("cid", F.col("cid").alias("text")), k, at_least)
        return hits.join(names, "cid").select(F.col("qid").alias("col"), "rank", "field", F.round(F.col("score") / 100, 4).alias("score"), F.lit("").alias("source"))

    return run


def fuzzy_alias(aliases: DataFrame, k: int, at_least: float) -> Callable[[DataFrame], DataFrame]:
    """The k best aliases, then their fields, each by its best alias."""
    index = exact.alias_index(aliases)

    def run(columns: DataFrame) -> DataFrame:
        hits = topk.token_topk(columns.select(F.col("col").alias("qid"), tx.normalize(F.col("col")).alias("text")), index.select(F.col("k").alias("cid"), F.col("k").alias("text")), k, at_least)
        rows = hits.join(index, F.col("cid") == F.col("k")).select(F.col("qid").alias("col"), F.explode("fields").alias("field"), F.round(F.col("score") / 100, 4).alias("score"), "source")
        return _best(rows, None)

    return run


def _best(rows: DataFrame, k: int | None) -> DataFrame:
    one = Window.partitionBy("col", "field").orderBy(F.desc("score"), "source")
    return topk.ranked(rows.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r"), k, "col", ties=["field"]).select(*COLUMNS)


def _bonus(family: bool):
    """What is added to a similarity: the treatment boost, and for numeric columns the family's."""
    c = F.col("col_normed")
    bonus = tx.treatment_boost(F.col("field"), c)
    return bonus + tx.family_boost(F.col("field"), F.col("family")) if family else bonus


def _keys(columns: DataFrame, numeric: bool) -> DataFrame:
    n = columns.select("col", tx.normalize(F.col("col")).alias("col_normed"))
    if not numeric:
        return n.withColumns({"text": F.col("col_normed"), "family": F.lit("unknown")})
    clean = n.withColumns({"_c": tx.without_units(F.col("col_normed")), "_t": tx.unit_tags(F.col("col_normed"))})
    return clean.select("col", "col_normed", F.when(F.col("_c") != "", F.col("_c")).otherwise(F.col("col_normed")).alias("text"), tx.numeric_family(F.col("_c"), F.col("_t")).alias("family"))


def similar_fields(schema: DataFrame, aliases: DataFrame | None, k: int, numeric: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Fields by the similarity of their names, and of their aliases', to the column's; 3k of each are weighed."""
    if numeric:
        schema = schema.filter("is_numeric_field = 'yes'")
        aliases = aliases.filter("is_numeric_field = 'yes'") if aliases is not None else None
    names = schema.groupBy("field_name").agg(F.min("ord").alias("ord")).select(F.col("field_name").alias("cid"), tx.normalize(F.col("field_name")).alias("text"))

    def run(columns: DataFrame) -> DataFrame:
        keys = _keys(columns, numeric)
        asked = keys.select(F.col("col").alias("qid"), "text")
        std = topk.gram_topk(asked, names, 3 * k).select(F.col("qid").alias("col"), F.col("cid").alias("field"), "score", F.lit("").alias("source"))
        bonus = lambda df: df.join(keys.select("col", "col_normed", "family"), "col").withColumn("score", F.round(F.col("score") + _bonus(numeric), 6))
        std = _best(bonus(std), k)
        if aliases is None:
            return std
        index = exact.alias_index(aliases)
        hits = topk.gram_topk(asked, index.select(F.col("k").alias("cid"), F.col("k").alias("text")), 3 * k)
        rows = hits.join(index, F.col("cid") == F.col("k")).select(F.col("qid").alias("col"), F.explode("fields").alias("field"), "score", "source")
        return fusion.best_per_field(std, _best(bonus(rows), k), k)

    return run


@dataclass
class SchemaMapper:
    """schema (field_name, is_numeric_field, ord), aliases (source, field_name, is_numeric_field, ord),
    values (field, value), concepts (text, field), llm: columns (col) -> (col, rank, field, score)."""

    schema: DataFrame
    aliases: DataFrame | None = None
    values: DataFrame | None = None
    concepts: DataFrame | None = None
    llm: Callable[[DataFrame], DataFrame] | None = None
    settings: Settings = Settings()
    drop_invalid: bool = False
    cut: Callable[[DataFrame], DataFrame] = staticmethod(lambda df: df)

    def run(self, cells: DataFrame, columns: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
        """(col, stage, method, rank, field, score, source) for cells (row_id, col, cell).

        columns: all names, if some have no cell. counts: the cells counted (votes.counted_tables), if that is had for less.
        """
        s, k = self.settings, self.settings.top_k
        counts = self.cut(votes.counted_cells(cells) if counts is None else counts)  # all that the stages ask of the cells
        columns = self.cut((counts if columns is None else columns).select("col").distinct())
        out: list[DataFrame] = []
        if self.drop_invalid:
            bad = self.cut(votes.invalid_columns(cells).filter("reason IS NOT NULL"))
            out.append(bad.select("col", F.lit("invalid").alias("stage"), F.col("reason").alias("method"), F.lit(1).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("score"), F.lit("").alias("source")))
            columns = self.cut(columns.join(bad.select("col"), "col", "left_anti"))
        numeric = self.cut(votes.numeric_of(counts).filter("is_numeric").select("col"))
        left = columns
        for stage, make in self._stages(counts, numeric):
            steps = make(left)
            if steps:
                found = self.cut(cascade(left, steps, self.cut)).withColumn("stage", F.lit(stage))
                out.append(found.select("col", "stage", "method", "rank", "field", "score", "source"))
                left = self.cut(left.join(found.select("col"), "col", "left_anti"))
        results = out[0]
        for part in out[1:]:
            results = results.unionByName(part)
        if self.llm:
            weak = results.filter((F.col("stage") == "stage3") & (F.col("rank") == 1) & (F.col("score") < s.llm_threshold)).select("col", F.col("score").alias("was"))
            said = self.cut(self.llm(weak.select("col").unionByName(left)))
            better = said.filter("rank = 1").select("col", F.col("score").alias("now")).join(weak, "col", "left").filter("was IS NULL OR now > was").select("col")
            new = said.join(better, "col", "left_semi").select("col", F.lit("stage4").alias("stage"), F.lit("llm").alias("method"), "rank", "field", "score", F.lit("").alias("source"))
            results = exact.replace_rows(results, new, "col")
        return results.withColumn("score", F.round("score", 4))

    def _stages(self, counts: DataFrame, numeric: DataFrame) -> list[tuple[str, Callable[[DataFrame], list[Strategy]]]]:
        """Each stage's name, and its strategies for the columns that are left when it begins."""
        s, k = self.settings, self.settings.top_k
        ranks = lambda df: topk.ranked(df, k, "col", ties=["field"]).select(*COLUMNS)
        one = [Strategy("std_exact", lambda c: ranks(exact.standard_exact(c, self.schema)), 1.0)]
        if self.aliases is not None:
            one.append(Strategy("alias_exact", lambda c: ranks(exact.alias_exact(c, self.aliases)), 1.0))
        one.append(Strategy("std_fuzzy", fuzzy_standard(self.schema, k, s.fuzzy_thresh), 0.92))
        if self.aliases is not None:
            one.append(Strategy("alias_fuzzy", fuzzy_alias(self.aliases, k, s.fuzzy_thresh), 0.92))

        def two(left: DataFrame) -> list[Strategy]:
            out: list[Strategy] = []
            if self.values is None and self.concepts is None:
                return out
            texty = self.cut(left.join(numeric, "col", "left_anti"))
            own = self.cut(counts.join(F.broadcast(texty), "col", "left_semi"))  # cut off, else all values are normalised before the join
            weights = self.cut(votes.weighted_of(own, s.value_unique_cap))
            of = lambda c: weights.join(c, "col", "left_semi")
            if self.values is not None:
                out.append(Strategy("value", lambda c: self._value_votes(of(c)), s.value_percentage_thresh))
            if self.concepts is not None:
                out.append(Strategy("ontology", lambda c: votes.ontology_vote(of(c), texty.join(c, "col", "left_semi"), self.concepts, k, s.value_percentage_thresh).select("col", "rank", "field", "score", F.col("col").alias("source")), s.value_percentage_thresh))
            return out

        three = [
            Strategy("numeric", lambda c: similar_fields(self.schema, self.aliases, k, True)(c.join(numeric, "col", "left_semi")), s.numeric_thresh),
            Strategy("semantic", similar_fields(self.schema, self.aliases, k), s.field_alias_thresh),
        ]
        return [("stage1", lambda left: one), ("stage2", two), ("stage3", lambda left: three)]

    def _value_votes(self, weights: DataFrame) -> DataFrame:
        asked = weights.select("value").distinct()
        base = self.values.select("value").distinct()
        hits = topk.gram_topk(asked.select(F.col("value").alias("qid"), F.lower("value").alias("text")), base.select(F.col("value").alias("cid"), F.lower("value").alias("text")), 10)
        near = hits.filter(F.col("score") >= self.settings.value_dict_thresh).select("qid", "cid", "score")
        fields = near.join(self.values.select(F.col("value").alias("cid"), "field"), "cid").select(F.col("qid").alias("value"), "field", F.col("score").alias("sim"))
        found = votes.dictionary_vote(weights, weights.select("col", "value").join(fields, "value"), self.settings.value_percentage_thresh)
        return found.select("col", "rank", "field", F.col("proportion").alias("score"), F.col("example").alias("source"))


def dictionaries(spark, schema: str | None = None, aliases: str | None = None, values: str | None = None, preset: tuple[str, str, str] | None = None) -> dict[str, str | None]:
    """Paths of the three dictionaries: argument, else preset, else a sibling of the schema (<stem>.alias.csv, <stem>.values.json)."""
    from ..sources.tables import exists

    schema = schema or (preset[0] if preset else None)
    if not schema:
        raise ValueError("a target schema is needed")
    stem = schema[:-4] if schema.endswith(".csv") else schema
    beside = {"aliases": f"{stem}.alias.csv", "values": f"{stem}.values.json"}
    out: dict[str, str | None] = {"schema": schema}
    for i, (name, given) in enumerate((("aliases", aliases), ("values", values)), 1):
        found = given if given is not None else (preset[i] if preset and schema == preset[0] else None)
        out[name] = found if found is not None else beside[name] if exists(spark, beside[name]) else None
    return out


def wide(results: DataFrame, k: int) -> DataFrame:
    """query, stage, method, match1, match1_score, match1_source, …; columns without a match are absent."""
    cols = []
    for i in range(1, k + 1):
        at = F.col("rank") == i
        cols += [F.max(F.when(at, F.col(a))).alias(b) for a, b in (("field", f"match{i}"), ("score", f"match{i}_score"), ("source", f"match{i}_source"))]
    return results.groupBy(F.col("col").alias("query"), "stage", "method").agg(*cols)


