"""Votes of a column's values for fields. Cells are long: (row_id, col, cell)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..storage import written
from .topk import ranked

UNIQUE_CAP, AT_LEAST, NAME_BONUS, NUMERIC_SHARE, STAGE_SHARE = 50, 0.2, 0.3, 0.9, 0.8


def cell_values(cells: DataFrame) -> DataFrame:
    """(col, row_id, pos, value): the valid values of every cell."""
    return cells.select("col", "row_id", F.posexplode(tx.valid_values(F.col("cell"))).alias("pos", "value"))


def counted(values: DataFrame) -> DataFrame:
    """(col, value, n, first): each raw value of a column, how often it occurs, and where first. Combined before the shuffle."""
    return values.groupBy("col", "value").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "pos")).alias("first"))


def counted_cells(cells: DataFrame) -> DataFrame:
    """The same from cells, in one pass over them: each distinct cell is split once. A column without values has one row, with a null one."""
    return _split(cells.groupBy("col", "cell").agg(F.count("*").alias("k"), F.min("row_id").alias("row_id")))


def counted_table(table: DataFrame, row_id: str) -> DataFrame:
    """(col, cell, k, row_id) of a wide table's columns (row_id is one of them): how often a cell occurs and where first. Each is grouped by its own type: only distinct values become text."""
    out = None
    for f in table.schema:
        c, keys = F.col(f"`{f.name}`"), {}
        if f.dataType.typeName() in ("float", "double"):
            # Groups don't tell -0.0 from 0.0, texts do.
            keys = {"v": c, "zero": F.when(c == 0, c.cast("string"))}
            cell = F.coalesce("zero", F.col("v").cast("string"))
        else:
            keys = {"v": c if isinstance(f.dataType, T.AtomicType) else c.cast("string")}
            cell = F.col("v").cast("string")
        once = table.groupBy(*(x.alias(n) for n, x in keys.items())).agg(F.count("*").alias("k"), F.min(F.col(f"`{row_id}`").cast("long")).alias("row_id"))
        once = once.select(F.lit(f.name).alias("col"), cell.alias("cell"), "k", "row_id")
        out = once if out is None else out.unionByName(once)
    return out


def counted_tables(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """counted_cells of the columns of wide tables, each with the column that numbers its rows."""
    return _split(reduce(DataFrame.unionByName, (counted_table(t, row_id) for t, row_id in tables)))


def _split(once: DataFrame) -> DataFrame:
    """(col, value, n, first) of cells (col, cell, k, row_id) that occur k times, first in row_id."""
    values = once.select("col", "k", "row_id", F.posexplode_outer(tx.valid_values(F.col("cell"))).alias("pos", "value"))
    return values.groupBy("col", "value").agg(F.sum("k").alias("n"), F.min(F.struct("row_id", "pos")).alias("first"))


def numeric_of(counts: DataFrame) -> DataFrame:
    """numeric_columns from counted values."""
    filled = F.col("value").isNotNull()
    n = F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0))
    hits = F.coalesce(F.sum(F.when(filled & tx.is_number(F.col("value")), F.col("n"))), F.lit(0))
    stats = counts.groupBy("col").agg(n.alias("n"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 9).alias("share"))
    return stats.withColumn("is_numeric", (F.col("n") > 0) & (F.col("share") >= NUMERIC_SHARE))


def _shares(counts: DataFrame) -> DataFrame:
    # A window over a column's values, or a join by the column's hash, would be one task for each column, however many values it has.
    totals = counts.groupBy("col").agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(totals), "col").select("col", "value", "n", (F.col("n") / F.col("all")).alias("freq"))


def frequencies(values: DataFrame) -> DataFrame:
    """(col, value, n, freq): shares of raw values."""
    return _shares(counted(values))


def unique_values(values: DataFrame) -> DataFrame:
    """(col, normed, value): the normalised values that aren't noise, each with the first raw value."""
    return _unique(counted(values))


def _normed(counts: DataFrame) -> DataFrame:
    return counts.withColumn("normed", tx.normalize(F.col("value"))).filter(~F.col("normed").isin("", *sorted(tx.NOISE)))


def _unique(counts: DataFrame) -> DataFrame:
    return _normed(counts).groupBy("col", "normed").agg(F.min_by("value", "first").alias("value"))


def weighted(values: DataFrame, cap: int = UNIQUE_CAP) -> DataFrame:
    """(col, normed, value, w, total): log weights of the unique values of columns that have at most cap of them."""
    return weighted_of(counted(values), cap)


def weighted_of(counts: DataFrame, cap: int = UNIQUE_CAP) -> DataFrame:
    """weighted from counted values."""
    counts = counts.filter("value IS NOT NULL")
    few = written(_normed(counts).select("col", "normed").distinct().groupBy("col").agg(F.count("*").alias("k")).filter(F.col("k") <= cap))
    counts = written(counts.join(F.broadcast(few), "col"))  # written, else what follows is done for all values before the join
    unique = _unique(counts)
    freq = _shares(counts).select("col", "value", "freq")
    w = unique.join(few, "col").join(freq, ["col", "value"], "left").withColumn("w", tx.log_weight(F.coalesce("freq", 1 / F.col("k"))))
    return w.select("col", "normed", "value", "w", F.sum("w").over(Window.partitionBy("col")).alias("total"))  # at most cap rows a column


def dictionary_vote(weights: DataFrame, hits: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """hits (col, value, field, sim) of weighted values -> (col, field, proportion, avg_score, n, example, rank)."""
    best = hits.groupBy("col", "value", "field").agg(F.max("sim").alias("sim"))
    joined = weights.join(best, ["col", "value"])
    votes = joined.groupBy("col", "field").agg(
        F.round(F.sum("w") / F.max("total"), 9).alias("proportion"), F.round(F.sum(F.col("w") * F.col("sim")) / F.greatest(F.sum("w"), F.lit(1e-9)), 9).alias("avg_score"), F.count("*").alias("n"), F.min_by("value", F.struct(-F.col("sim"), F.col("value"))).alias("example")
    )
    order = Window.partitionBy("col").orderBy(F.desc("proportion"), F.desc("avg_score"), F.desc("n"), "field")
    return votes.filter(F.col("proportion") >= at_least).withColumn("rank", F.row_number().over(order).cast("bigint"))


def ontology_vote(weights: DataFrame, columns: DataFrame, hits: DataFrame, k: int, above: float = AT_LEAST) -> DataFrame:
    """hits (text, field): fields of texts (values or column names) -> (col, field, score, rank).

    A column whose own name is a hit gains NAME_BONUS. cancer_type stands for disease
    and cancer_type_details, too, while there is room.
    """
    known = hits.select(tx.key(F.col("text")).alias("t"), "field").distinct()
    by_value = weights.join(known, tx.key(F.col("value")) == F.col("t")).groupBy("col", "field").agg((F.sum("w") / F.max("total")).alias("share"))
    by_name = columns.join(known, tx.key(F.col("col")) == F.col("t")).select("col", "field", F.lit(NAME_BONUS).alias("bonus"))
    scored = by_value.join(by_name, ["col", "field"], "full").select("col", "field", F.when(F.col("bonus").isNotNull(), F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)) + F.col("bonus"))).otherwise(F.col("share")).alias("score"))
    # A name alone (0.3) passes as well; columns above the cap have no weights and no vote.
    scored = scored.join(weights.select("col").distinct(), "col", "left_semi").withColumn("score", F.round("score", 9)).filter(F.col("score") > above)
    top = ranked(scored, k, "col", ties=["field"]).select("col", "field", "score", "rank")
    n = top.groupBy("col").agg(F.max("rank").alias("n"), F.max(F.when(F.col("field") == "cancer_type", F.col("score"))).alias("c"), F.max(F.col("field") == "disease").alias("d")).filter("c IS NOT NULL")
    disease = n.filter((F.col("n") < k) & ~F.col("d")).select("col", F.lit("disease").alias("field"), F.col("c").alias("score"), (F.col("n") + 1).alias("rank"))
    used = F.col("n") + F.when(F.col("d"), 0).otherwise(1)
    details = n.filter(used < k).select("col", F.lit("cancer_type_details").alias("field"), F.col("c").alias("score"), (used + 1).cast("bigint").alias("rank"))
    return top.unionByName(disease).unionByName(details)


def numeric_columns(cells: DataFrame) -> DataFrame:
    """(col, n, share, is_numeric) over all values of all cells; a column without values isn't numeric."""
    values = cells.select("col", F.explode_outer(tx.valid_values(F.col("cell"))).alias("value"))
    stats = values.groupBy("col").agg(F.count("value").alias("n"), F.round(F.coalesce(F.avg(F.when(F.col("value").isNotNull(), tx.is_number(F.col("value")).cast("int"))), F.lit(0.0)), 9).alias("share"))
    return stats.withColumn("is_numeric", (F.col("n") > 0) & (F.col("share") >= NUMERIC_SHARE))


STAGE_NAMES = "stage|ajcc|tnm|figo|ann arbor"
STAGE_GROUP = r"(?i)\bstage\s*(?:group\s*)?[-:]?\s*(?:[0-4]|iv|i{1,3}v?)\s*[a-c]?\b"
TNM = r"(?i)^[cp]?(?:m(?:[01][a-c]?|x)|n(?:[0-3][a-c]?|x)|t(?:[0-4][a-e]?|is|x))$"


def stage_columns(cells: DataFrame) -> DataFrame:
    """(col, is_stage): by name, or as at least 80 % of the cells read like stages."""
    filled = F.col("cell").isNotNull()
    group = F.avg(F.when(filled, F.trim("cell").rlike(STAGE_GROUP).cast("int")))
    tnm = F.avg(F.when(filled, F.regexp_replace("cell", r"\s+", "").rlike(TNM).cast("int")))
    shares = cells.groupBy("col").agg(F.greatest(F.coalesce(group, F.lit(0.0)), F.coalesce(tnm, F.lit(0.0))).alias("share"))
    return shares.select("col", (F.lower(F.trim("col")).rlike(STAGE_NAMES) | (F.col("share") >= STAGE_SHARE)).alias("is_stage"))


ID_WORDS = "id|identifier|code|mrn|uid|uuid|guid|accession"
ID_OWNERS = "patient|study|sample|subject|case|participant|enrollment|specimen|trial|record|medical|accession"


def id_column(col):
    """Whether a column name reads like an identifier."""
    name = F.lower(F.trim(col))
    packed = F.regexp_replace(name, r"[._\s-]", "")
    return name.rlike(f"^({ID_WORDS})$") | (packed.rlike(f"^({ID_OWNERS})") & packed.rlike(f"({ID_WORDS})$")) | name.rlike(r"(^|[\s_.-])id$")


def count_column(col):
    """Whether a column name holds sample count or mutation count, or nearly."""
    from ..functions.similarity import partial_ratio

    name = F.lower(col)
    return (partial_ratio("sample count", name) >= 95) | (partial_ratio("mutation count", name) >= 95)


def invalid_columns(cells: DataFrame) -> DataFrame:
    """(col, reason): id_column, count_column, stage_column or null, in that order."""
    c = F.col("col")
    return stage_columns(cells).select("col", F.when(id_column(c), "id_column").when(count_column(c), "count_column").when(F.col("is_stage"), "stage_column").alias("reason"))
