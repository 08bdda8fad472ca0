"""Terminology services as tables, by way of snapshots or a user's transport.

A service answers for one key (a code, or a search text) with a JSON text or
nothing. Keys are spread over a fixed number of partitions, each of which keeps
its share of the service's rate, so the rate holds whatever the cluster's size.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Service:
    """rate: requests a second over all partitions. Fetch returns (status, body, seconds to wait or None)."""

    name: str
    rate: float
    partitions: int = 4
    tries: int = 3
    batch: int = 50


NCI, OLS, UMLS, SEARCH = Service("nci", 18), Service("ols", 10), Service("umls", 18), Service("ncit_search", 8, partitions=1)
Fetch = Callable[[str], tuple[int, str | None, float | None]]


def back_off(n: int, wait: float | None = None, busy: bool = True) -> float:
    """Seconds before another try after n failures: what the service says, else doubling if it is busy, and soon if not."""
    return wait if wait is not None else 2.0**n * (0.5 + random.random() / 2) if busy else 0.0


def attempt(fetch: Fetch, key: str, tries: int, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body, after as many tries as 429 and 5xx need; other failures are None at once."""
    for n in range(tries):
        try:
            status, body, wait = fetch(key)
        except OSError:
            status, body, wait = 599, None, None
        if status == 200:
            return body
        if status != 429 and status < 500:
            return None
        if n + 1 < tries:
            sleep(back_off(n, wait))
    return None


class Pace:
    """Keeps calls at a rate that falls on errors and recovers up to most."""

    def __init__(self, rate: float, most: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.most, self.clock, self.sleep, self.next = rate, most or rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + 1 / self.rate

    def failed(self) -> None:
        self.rate = max(0.1, self.rate * 0.7)

    def went_well(self) -> None:
        self.rate = min(self.most, self.rate * 1.05)


def fetch_all(keys: DataFrame, service: Service, load: Callable[[], Fetch]) -> DataFrame:
    """keys (key) -> (key, body): each distinct key asked once. load makes the transport in the worker."""
    share, tries = service.rate / service.partitions, service.tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, pace = load(), Pace(share)
        for batch in batches:
            bodies = []
            for k in batch.column(0).to_pylist():
                pace.wait()
                bodies.append(attempt(fetch, k, tries))
                pace.went_well() if bodies[-1] is not None else pace.failed()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["key", "body"])

    asked = keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    return asked.repartition(service.partitions, "key").mapInArrow(run, "key string, body string")


def from_snapshot(keys: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The same from a table (key, body) saved before; the default, as it needs no network."""
    return keys.select(F.col("key").cast("string").alias("key")).distinct().join(snapshot.select("key", "body"), "key", "left")


CONCEPT = "struct<code:string,name:string,synonyms:array<struct<name:string>>,definitions:array<struct<definition:string>>,parents:array<struct<name:string,code:string>>,children:array<struct<name:string,code:string>>,roles:array<struct<type:string,relatedName:string,relatedCode:string>>>"


def concepts(bodies: DataFrame, most: int = 10) -> DataFrame:
    """NCI concept payloads (key, body) -> (code, label, definitions, synonyms, parents, children, roles)."""
    c = F.from_json("body", CONCEPT)
    names = lambda part: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c[part], F.array().cast("array<struct<name:string,code:string>>") if part in ("parents", "children") else F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda n: n.isNotNull() & (n != ""))))
    definitions = tx.concept_definitions(F.transform(F.coalesce(c["definitions"], F.array().cast("array<struct<definition:string>>")), lambda d: F.coalesce(d["definition"], F.lit(""))))
    roles = F.filter(F.transform(F.coalesce(c["roles"], F.array().cast("array<struct<type:string,relatedName:string,relatedCode:string>>")), lambda r: F.struct(tx.role_name(r["type"]).alias("role"), r["relatedName"].alias("target"))), lambda r: r["role"].isNotNull() & r["target"].isNotNull())
    return bodies.filter("body IS NOT NULL").select(
        F.col("key").alias("code"), c["name"].alias("label"), definitions.alias("definitions"), names("synonyms").alias("synonyms"), F.slice(names("parents"), 1, most).alias("parents"), F.slice(names("children"), 1, most).alias("children"), F.slice(roles, 1, most).alias("roles")
    )


def concept_context(rows: DataFrame, most: int = 10) -> DataFrame:
    """(code, label, context) of concepts: synonyms, definitions, parents, children and roles, each ``part: a; b``."""

    def part(name: str, items) -> F.Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, "; ")))

    kinds = F.array_sort(F.array_distinct(F.transform("roles", lambda r: r["role"])))
    said = F.transform(kinds, lambda k: F.concat(k, F.lit(": "), F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(F.filter("roles", lambda r: r["role"] == k), lambda r: r["target"]))), 1, most), "; ")))
    text = F.concat_ws(". ", part("synonyms", F.col("synonyms")), part("definitions", F.col("definitions")), part("parents", F.col("parents")), part("children", F.col("children")), part("roles", said))
    return rows.select("code", "label", text.alias("context"))


# --- the lookup service of the OBO ontologies, and the metathesaurus -----------------


def lookup_key(code: F.Column) -> F.Column:
    """ontology/iri of a code, the IRI encoded twice, as the lookup service wants it; null for unknown prefixes."""
    ontology = tx.ontology(code)
    iri = tx.iri(code)
    twice = F.url_encode(F.url_encode(iri))
    return F.when(ontology.isNotNull() & iri.isNotNull(), F.concat(ontology, F.lit("/"), twice))


TERM = "struct<label:string,obo_id:string,synonyms:array<string>,description:array<string>,obo_synonym:map<string,array<string>>,annotation:map<string,array<string>>,_links:struct<parents:struct<href:string>,children:struct<href:string>>>"


def lookup_terms(bodies: DataFrame) -> DataFrame:
    """Term payloads (key, body) -> (key, label, synonyms, definitions, parents_href, children_href); texts sorted, each once."""
    t = F.from_json("body", TERM)
    none = F.array().cast("array<string>")
    more = [F.flatten(F.map_values(F.coalesce(t[c], F.from_json(F.lit("{}"), "map<string,array<string>>")))) for c in ("obo_synonym", "annotation")]
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    return bodies.filter("body IS NOT NULL").select(
        "key", t["label"].alias("label"), tidy(F.concat(F.coalesce(t["synonyms"], none), *more)).alias("synonyms"), F.filter(F.coalesce(t["description"], none), lambda x: x != "").alias("definitions"), t["_links"]["parents"]["href"].alias("parents_href"), t["_links"]["children"]["href"].alias("children_href")
    )


PAGE = "struct<_embedded:struct<terms:array<struct<label:string,obo_id:string>>>,_links:struct<next:struct<href:string>>>"


def page_terms(pages: DataFrame) -> DataFrame:
    """Pages of terms (key, body) -> (key, obo_id, label): neighbours or descendants; a page that can't be read has none."""
    return pages.select("key", F.explode(F.from_json("body", PAGE)["_embedded"]["terms"]).alias("t")).select("key", "t.obo_id", "t.label").filter("label <> ''")


def fetch_pages(keys: DataFrame, service: Service, load: Callable[[], Fetch]) -> DataFrame:
    """keys (key) -> (key, page, body): each key's first page, and on from each page to the next it names.

    A page that can't be had is an error: a part of a taxonomy is worse than none.
    """
    rate, tries = service.rate / service.partitions, service.tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, pace = load(), Pace(rate)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                at, page = key, 0
                while at:
                    pace.wait()
                    body = attempt(fetch, at, tries)
                    if body is None:
                        raise OSError(f"page {page} of {key} can't be had")
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([page], pa.int64()), pa.array([body])], ["key", "page", "body"])
                    at, page = ((json.loads(body).get("_links") or {}).get("next") or {}).get("href"), page + 1

    asked = keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    return asked.repartition(service.partitions, "key").mapInArrow(run, "key string, page long, body string")


def ontology_versions(bodies: DataFrame) -> DataFrame:
    """Metadata payloads (key, body) -> (ontology, title, version, version_iri): version, else that of the release in the IRI."""
    m = F.from_json("body", "struct<version:string,config:struct<title:string,version:string,versionIri:string>>")
    iri = m["config"]["versionIri"]
    release = F.nullif(F.regexp_extract(iri, "/releases/([^/]+)/", 1), F.lit(""))
    said = F.coalesce(F.nullif(m["version"], F.lit("")), F.nullif(m["config"]["version"], F.lit("")), release)
    return bodies.select(F.col("key").alias("ontology"), m["config"]["title"].alias("title"), said.alias("version"), iri.alias("version_iri"))


def metathesaurus_codes(bodies: DataFrame, source: str = "NCI") -> DataFrame:
    """Search payloads (key, body) of exact terms -> (term, pos, code) of one source, in the order of the results."""
    hits = F.from_json("body", "struct<result:struct<results:array<struct<ui:string,rootSource:string>>>>")["result"]["results"]
    own = F.filter(hits, lambda h: h["rootSource"] == source)
    return bodies.select(F.col("key").alias("term"), F.posexplode(own).alias("pos", "h")).select("term", F.col("pos").cast("bigint").alias("pos"), F.col("h.ui").alias("code"))


def first_hits(bodies: DataFrame) -> DataFrame:
    """Search payloads (key, body) -> (term, code, label): the first concept found; null if there is none."""
    first = F.get(F.from_json("body", "struct<concepts:array<struct<code:string,name:string>>>")["concepts"], F.lit(0))
    return bodies.select(F.col("key").alias("term"), first["code"].alias("code"), first["name"].alias("label"))
