"""Ontology graphs as edge tables (parent, child)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

HOPS = 5
#: Levels after which what was seen is written as one table.
LEVELS = 16


def _levels(edges: DataFrame, start: DataFrame, above: str, below: str, most: int | None) -> DataFrame:
    """(root, code, depth): what can be reached from start (root), at its least depth, level by level.

    A level holds each (root, code) once, however many paths lead there, and none that was
    seen before, so diamonds and cycles cost nothing. Each level is written: that cuts the
    plan, and says when there is none left.
    """
    steps = written(edges.select(F.col(above).alias("code"), F.col(below).alias("next")).filter("code IS NOT NULL AND next IS NOT NULL").distinct())
    now = written(start.select("root", F.col("root").alias("code"), F.lit(0).cast("long").alias("depth")).filter("root IS NOT NULL").distinct())
    seen, depth = [now], 0
    while most is None or depth < most:
        depth += 1
        ahead = now.join(steps, "code").select("root", F.col("next").alias("code")).distinct()
        before = reduce(DataFrame.unionAll, seen)
        now = written(ahead.join(before.select("root", "code"), ["root", "code"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if now.isEmpty():
            break
        seen.append(now)
        if len(seen) > LEVELS:
            seen = [written(reduce(DataFrame.unionAll, seen))]
    return reduce(DataFrame.unionAll, seen)


def descendants(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, code, depth) of all that is below the roots (root), the root itself at depth 0; the least depth of each.

    most: so many levels; None: all there are.
    """
    return _levels(edges, roots, "parent", "child", most)


def ancestors(edges: DataFrame, codes: DataFrame, hops: int = HOPS) -> DataFrame:
    """(code, ancestor, hops) within so many steps up from codes (code)."""
    found = _levels(edges, codes.select(F.col("code").alias("root")), "child", "parent", hops)
    return found.select(F.col("root").alias("code"), F.col("code").alias("ancestor"), F.col("depth").alias("hops"))


def categories(concepts: DataFrame, members: DataFrame, edges: DataFrame, roots: DataFrame, hops: int = HOPS) -> DataFrame:
    """(value, category) of concepts (value, code): every category whose members (category, code) hold the code;
    of those in none, the categories whose root (category, code) is an ancestor within hops."""
    direct = concepts.join(members, "code").select("value", "category").distinct()
    rest = concepts.join(direct.select("value"), "value", "left_anti")
    up = ancestors(edges, rest, hops).join(roots.select("category", F.col("code").alias("ancestor")), "ancestor").select("code", "category")
    return direct.unionByName(rest.join(up, "code").select("value", "category").distinct())


def term_neighbours(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(code, label, parents, children): labels (code, label) with the sorted labels around each."""
    named = labels.select("code", "label")
    parents = edges.join(named.select(F.col("code").alias("parent"), "label"), "parent").groupBy(F.col("child").alias("code")).agg(F.array_sort(F.collect_set("label")).alias("parents"))
    children = edges.join(named.select(F.col("code").alias("child"), "label"), "child").groupBy(F.col("parent").alias("code")).agg(F.array_sort(F.collect_set("label")).alias("children"))
    none = F.array().cast("array<string>")
    return named.join(parents, "code", "left").join(children, "code", "left").select("code", "label", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))
