"""New standard fields for the columns that nothing matched."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clustering, votes
from ..operators.encoders import Encoder

STOPWORDS = frozenset(
    "a an and are as at be but by code date did do for from had has have he her him id if in is it its me my name no not num number of on or our she so that the their them they this to type us value was we with yes your".split()
)
EMBEDDING, ENTITIES, COHESION, SIZE = 0.35, 0.30, 0.20, 0.15


def unmapped(columns: DataFrame, results: DataFrame, below: float = 0.5) -> DataFrame:
    """columns (col) with a best score below (or none), and those that have no result; invalid ones aside."""
    top = results.filter("rank = 1 OR stage = 'invalid'").groupBy("col").agg(F.max("score").alias("score"), F.max(F.col("stage") == "invalid").alias("bad"))
    weak = top.filter(~F.col("bad") & (F.col("score").isNull() | (F.col("score") < below))).select("col")
    return weak.unionByName(columns.select("col").join(top, "col", "left_anti").select("col")).distinct()


def described(columns: DataFrame, cells: DataFrame | None, top: int = 5) -> DataFrame:
    """(col, text): the words of a name, with some of its values unless they are numbers."""
    if cells is None or top <= 0:
        return columns.select("col", tx.column_text(F.col("col")).alias("text"))
    numeric = votes.numeric_columns(cells).filter("is_numeric").select("col")
    # Clipped before anything is sent. The numeric columns, a row for each, go to every task: a join by hash would send all values of a column to one.
    values = cells.filter("cell IS NOT NULL").select("col", F.substring("cell", 1, 30).alias("v")).join(F.broadcast(numeric), "col", "left_anti").distinct()
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("v"))).filter(F.col("r") <= top)
    lists = first.groupBy("col").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    none = F.array().cast("array<string>")
    return columns.join(lists, "col", "left").select("col", tx.embed_text(F.col("col"), F.coalesce("vs", none), top).alias("text"))


def words(name: str) -> list[str]:
    return name.lower().translate(str.maketrans("_-.:", "    ")).split()


def field_name(columns: list[str], entity: str = "") -> str:
    """A name from the most frequent words of the columns (ties by first place), led by an entity if there is one."""
    counts = Counter(w for c in columns for w in words(c))
    said = [w for w, _ in counts.most_common() if w not in STOPWORDS and len(w) > 1]
    if entity:
        lead = words(entity)
        return "_".join((lead + [w for w in said if w not in lead][:2])[:4])
    return "_".join(said[:3]) or "unknown_field"


def confidence(n_clusters: int, signatures: list[tuple[str, ...]], cohesion: float, n: int, tagged: bool) -> float:
    said = {s for s in signatures if s}
    entities = 1 / len(said) if tagged and said else 0.5
    return float(np.clip(EMBEDDING / max(1, n_clusters) + ENTITIES * entities + COHESION * cohesion + SIZE * min(1.0, n / 8), 0, 1))


def suggest(columns: DataFrame, encoder: Encoder, cells: DataFrame | None = None, tagger: Callable[[list[str]], list[list[str]]] | None = None, config: clustering.ClusterConfig = clustering.ClusterConfig(), split: bool = False, merge_at: float = 0.75, samples: int = 50, judge: Callable[[list[str]], float] | None = None, veto: Callable[[list[str]], Callable[[list[int], list[int]], bool]] | None = None) -> DataFrame:
    """(suggested_field, source_columns, ner_entities, confidence, sample_values), best first by confidence.

    Names and vectors of all columns go to one group; linkage can't be spread. judge and veto
    (made of the names) let a model say what is coherent, and what isn't to be split.
    """
    vectors = encoder.encode(described(columns.select("col").distinct(), cells), "text").select("col", "embedding")

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("col")
        names, v = rows["col"].tolist(), np.array(rows["embedding"].tolist(), float)
        clusters = clustering.coherent_clusters(names, v, config, judge)
        if split:
            clusters = clustering.refine(clusters, v, veto=veto(names) if veto else None)
        of = {i: c for c, members in enumerate(clusters) for i in members}
        tags = [sorted(set(t)) for t in tagger(names)] if tagger else [[] for _ in names]
        groups = clustering.merge_by_entity(clusters, tags, v, merge_at) if tagger else clusters
        cos, out, used = clustering.cosine_matrix(v), [], Counter()
        for g in groups:
            if len(g) < config.min_size:
                continue
            mine = [names[i] for i in g]
            ents = Counter(t for i in g for t in tags[i])
            score = confidence(len({of[i] for i in g}), [tuple(tags[i]) for i in g], clustering.mean_cosine(cos, g) if len(g) > 1 else 0.5, len(g), bool(tagger))
            name = field_name(mine, min(ents, key=lambda t: (-ents[t], t)) if ents else "")
            used[name] += 1
            out.append((name if used[name] == 1 else f"{name}_{used[name]}", sorted(mine), sorted(ents), round(score, 4)))
        return pd.DataFrame(out, columns=["suggested_field", "source_columns", "ner_entities", "confidence"])

    found = vectors.groupBy(F.lit(0).alias("one")).applyInPandas(group, "suggested_field string, source_columns array<string>, ner_entities array<string>, confidence double")
    if cells is None:
        return found.withColumn("sample_values", F.lit(None).cast("map<string,array<string>>")).orderBy(F.desc("confidence"), "suggested_field")
    seen = cells.filter("cell IS NOT NULL").groupBy("col", "cell").agg(F.min("row_id").alias("first"))
    first = seen.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("first", "cell"))).filter(F.col("r") <= samples)
    values = first.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell"))), lambda x: x["cell"]).alias("vs"))
    shown = found.select("suggested_field", F.explode("source_columns").alias("col")).join(values, "col").groupBy("suggested_field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "vs")))).alias("sample_values"))
    return found.join(shown, "suggested_field", "left").orderBy(F.desc("confidence"), "suggested_field")


def suggest_from_results(columns: DataFrame, results: DataFrame, encoder: Encoder, below: float = 0.5, **more) -> DataFrame:
    return suggest(unmapped(columns, results, below), encoder, **more)
