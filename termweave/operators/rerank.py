"""Rerankers as user models: scores of pairs in batches, and lists put in order.

A pair model is made in the worker by a loader and takes a list of (query, label); a list
model takes a query and labels, and answers with their numbers, best first, as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import DIGITS, ranked

Pairs = Callable[[list[tuple[str, str]]], Sequence[float]]
Order = Callable[[str, list[str]], str]
#: Labels that a list model sees at once, and how many of each such part go on to the last round.
SHOWN, ONWARD = 20, 5


def true_share(true: Sequence[float], false: Sequence[float]) -> np.ndarray:
    """Probability of the first of two logits: what a model that answers true or false says of a pair."""
    return 1 / (1 + np.exp(np.asarray(false, float) - np.asarray(true, float)))


def by_pairs(candidates: DataFrame, load: Callable[[], Pairs], k: int, batch: int = 32) -> DataFrame:
    """candidates (qid, query, label, score) -> (qid, rank, label, similarity_score, score) by a model of pairs.

    Each distinct pair is scored once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                scores = np.asarray(model(list(zip(*(c.to_pylist() for c in part.columns)))), float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(scores, DIGITS) + 0.0)], ["query", "label", "said"])

    asked = candidates.select("query", "label").filter("query IS NOT NULL AND label IS NOT NULL").distinct()
    scored = candidates.join(asked.mapInArrow(run, "query string, label string, said double"), ["query", "label"])
    return ranked(scored.select("qid", "label", F.col("score").alias("similarity_score"), F.col("said").alias("score")), k, "qid").select("qid", "rank", "label", "similarity_score", "score")


def parse_order(answer: str | None, n: int) -> list[int]:
    """The numbers below n of an answer, each once, then the others as they were."""
    said = [int(x) for x in re.findall(r"\d+", answer or "") if len(x) < 10]
    first = list(dict.fromkeys(i for i in said if i < n))
    return first + [i for i in range(n) if i not in set(first)]


def put_in_order(model: Order, query: str, labels: list[str], shown: int = SHOWN, onward: int = ONWARD) -> list[str]:
    """All labels, best first. More than are shown at once go in parts; the first few of each part meet again."""

    def once(some: list[str]) -> list[str]:
        return [some[i] for i in parse_order(model(query, some), len(some))]

    if len(labels) <= shown:
        return once(labels)
    ahead = [x for i in range(0, len(labels), shown) for x in once(labels[i : i + shown])[:onward]]
    ahead = once(ahead) if len(ahead) > shown else ahead
    return ahead + [x for x in labels if x not in set(ahead)]


def by_lists(candidates: DataFrame, load: Callable[[], Order], k: int, shown: int = SHOWN, onward: int = ONWARD) -> DataFrame:
    """candidates (qid, query, rank, label, score) -> (qid, rank, label, similarity_score, score) by a model of lists.

    The score falls from 1 by equal steps. The candidates of one query are a pool of bounded size, a row to the model's worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            at, rank, said, was, scores = [], [], [], [], []
            for i, (query, some) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())):
                own: dict[str, float] = {}
                for x in some:
                    own.setdefault(x["label"], x["score"])
                order = put_in_order(model, query, list(own), shown, onward)
                first = order[:k]
                at += [i] * len(first)
                rank += range(1, len(first) + 1)
                said += first
                was += [own[x] for x in first]
                scores += [round(1 - n / len(order), DIGITS) for n in range(len(first))]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int64()), pa.array(said, pa.string()), pa.array(was, pa.float64()), pa.array(scores, pa.float64())], ["qid", "rank", "label", "similarity_score", "score"])

    kind = candidates.schema["qid"].dataType.simpleString()
    own = candidates.select("qid", "query", "rank", "label", "score").filter("query IS NOT NULL AND label IS NOT NULL")
    lists = own.groupBy("qid").agg(F.min_by("query", "rank").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("some"))
    return lists.mapInArrow(run, f"qid {kind}, rank long, label string, similarity_score double, score double")
