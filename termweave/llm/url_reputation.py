"""URL filter by empirical-Bayes host reputation.

Labelled pages are good or bad. Counts of each are kept for suffix, registered
domain and host. Down the levels, a beta-binomial prior is fitted to the children
of all parents (method of moments on their bad rates about their parents' means,
its strength between LEAST and MOST pseudo-counts), and every node's rate is
shrunk towards its parent's posterior mean. A host's page stays if the upper
bound of the posterior bad rate, mean + Z standard deviations, is at most BOUND.
Hosts with few labels lean on their domain, domains on their suffix. Suffixes are
those of the public suffix list; a registered domain is a suffix and one label. An
address (four numbers, or one in brackets) is its own domain and suffix.

The label of a page is that of the document its URL names (the last number of the
path); it is bad if the document is toxic or of low quality.

Defined cases: a null or unparsable URL has null host, domain and suffix, its rate
is that of all labels, and it is judged like any other; without labels the prior
is uniform (1, 1); null outcomes are no labels; repeated rows count as often as
they occur; rows with a null id are judged too; a URL of any length is read whole;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import public_suffix
from .common import small_batches, written

LEAST, MOST, Z, BOUND = 2.0, 200.0, 1.645, 0.35
#: Public suffixes of two labels in the SQL, where all others are the last label; these don't rule what runs in Spark.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.%]+\]|[^/?#:@]+)"
#: Hosts that are addresses: four numbers, or anything in brackets.
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*)$"
_NUMBER = r"^[^?#]*?/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$"


def _suffix(rules: tuple[str, ...] | None):
    def run(hosts: pa.Array) -> pa.Array:
        return public_suffix.suffixes(hosts, rules)

    return F.arrow_udf(run, "string")


def parts(url: Column, suffixes: tuple[str, ...] | None = None) -> tuple[Column, Column, Column]:
    """(host, registered domain, suffix) of a URL, by rules as in the public suffix list; None: that list."""
    host = F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))
    address = host.rlike(_ADDRESS)
    suffix = F.when(address, host).otherwise(_suffix(suffixes)(host))
    labels = F.size(F.split(suffix, r"\.")) + 1
    domain = F.when(address, host).otherwise(F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), labels)), F.lit(1), labels), "."))
    return host, domain, suffix


def _moments(nodes: DataFrame) -> DataFrame:
    """One row: strength of the prior about the parents' means (column m), from nodes (n, bad, m)."""
    d = nodes.agg(
        F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("m")) * (F.col("bad") / F.col("n") - F.col("m"))).alias("ss"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("mm")
    )
    # E[ss] = mm / total * (k + rho * (total - k)) for an intra-class correlation rho; strength = 1 / rho - 1
    rho = (F.col("ss") * F.col("total") / F.col("mm") - F.col("k")) / (F.col("total") - F.col("k"))
    strength = F.when((F.col("mm") > 0) & (F.col("total") > F.col("k")) & (rho > 0), 1 / rho - 1).when(F.col("k") > 0, F.lit(MOST)).otherwise(F.lit(LEAST))
    return d.select(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), strength)).alias("strength"))


def reputations(pages: DataFrame, labels: DataFrame, url_col: str = "url", suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(host, domain, suffix, n_labels, n_bad, alpha, beta) for every host among the pages."""
    small_batches(pages.sparkSession)
    host, domain, suffix = parts(F.col(url_col).cast("string"), suffixes)
    named = F.regexp_extract(F.col(url_col).cast("string"), _NUMBER, 1)
    own = pages.select(host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.when(named != "", named.cast("long")).alias("k"))
    bad = ((F.col("toxic").cast("int") == 1) | (F.col("quality").cast("int") == 0)).cast("long")
    outcomes = labels.select(F.col("doc_id").cast("long").alias("k"), bad.alias("bad")).filter("k IS NOT NULL AND bad IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    # Labels of a URL's document; URLs are counted as often as they occur.
    # Those that name no document take no part in the join: they would all be one key.
    found = own.filter("k IS NOT NULL").join(outcomes, "k", "left").select("host", "domain", "suffix", "n", "bad")
    none = own.filter("k IS NULL").select("host", "domain", "suffix", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("bad"))
    seen = found.unionAll(none).groupBy("host", "domain", "suffix").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    seen = written(seen)  # one row for each host, read at every level
    all_ = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad0")).select(((F.col("bad0") + 1) / (F.col("n0") + 2)).alias("m0"))
    level = seen.crossJoin(all_).withColumn("m", F.col("m0"))
    keys: list[str] = []
    for key in ("suffix", "domain", "host"):
        keys.append(key)
        nodes = level.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("m").alias("m"))
        nodes = written(nodes)
        nodes = nodes.crossJoin(_moments(nodes.filter("n > 0 AND suffix IS NOT NULL")))
        nodes = nodes.withColumns({"alpha": F.col("strength") * F.col("m") + F.col("bad"), "beta": F.col("strength") * (1 - F.col("m")) + F.col("n") - F.col("bad")})
        if key != "host":
            here = nodes.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("up"))
            match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            level = level.join(here, match, "left").withColumn("m", F.col("up")).drop("up", *(f"_{k}" for k in keys))
    return nodes.select("host", "domain", "suffix", F.col("n").alias("n_labels"), F.col("bad").alias("n_bad"), "alpha", "beta")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] | None = None, z: float = Z, bound: float = BOUND) -> DataFrame:
    """(page_id, host, domain, suffix, n_labels, n_bad, bad_rate, bad_bound, keep) of every page."""
    s = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / s
    upper = F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (s + 1)))
    hosts = reputations(pages, labels, url_col, suffixes).withColumns({"bad_rate": F.round(mean, 9), "bad_bound": F.round(upper, 9)})
    hosts = hosts.select(F.col("host").alias("h"), "domain", "suffix", "n_labels", "n_bad", "bad_rate", "bad_bound", (F.col("bad_bound") <= bound).alias("keep"))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), parts(F.col(url_col).cast("string"), suffixes)[0].alias("host"))
    return own.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").select("page_id", "host", "domain", "suffix", "n_labels", "n_bad", "bad_rate", "bad_bound", "keep")


def _level(key: str, keys: str, source: str) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    up = f"SELECT a.*, b.m2 FROM {source} a JOIN p_{key} b ON {on}" if key != "host" else ""
    nodes = f"""n_{key} AS (SELECT {keys}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, first(m) AS m FROM {source} GROUP BY {keys}),
d_{key} AS (SELECT sum(n) AS total, count(*) AS k, sum(n * (bad / n - m) * (bad / n - m)) AS ss, sum(n * m * (1 - m)) AS mm FROM n_{key} WHERE n > 0 AND suffix IS NOT NULL),
s_{key} AS (SELECT least({MOST}, greatest({LEAST}, CASE WHEN mm > 0 AND total > k AND (ss * total / mm - k) / (total - k) > 0 THEN 1 / ((ss * total / mm - k) / (total - k)) - 1 WHEN k > 0 THEN {MOST} ELSE {LEAST} END)) AS strength FROM d_{key}),
p_{key} AS (SELECT {keys}, n, bad, strength * m + bad AS alpha, strength * (1 - m) + n - bad AS beta, (strength * m + bad) / (strength + n) AS m2 FROM n_{key}, s_{key})"""
    return nodes + (f",\nl_{key} AS (SELECT * EXCLUDE (m, m2), m2 AS m FROM ({up}))" if up else "")


SQL = f"""
WITH u AS (SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host, try_cast(nullif(regexp_extract(url, '{_NUMBER}', 1), '') AS BIGINT) AS k FROM pages),
v AS (SELECT *, string_split(host, '.') AS l FROM u),
w AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({', '.join(f"'{s}'" for s in SUFFIXES)}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM v),
x AS (SELECT *, array_to_string(l[-(len(string_split(suffix, '.')) + 1):], '.') AS domain FROM w),
o AS (SELECT doc_id AS k, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1),
seen AS (SELECT host, domain, suffix, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM x LEFT JOIN o USING (k) GROUP BY ALL),
l_all AS (SELECT *, (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) FROM seen) AS m FROM seen),
{_level('suffix', 'suffix', 'l_all')},
{_level('domain', 'suffix, domain', 'l_suffix')},
{_level('host', 'suffix, domain, host', 'l_domain')},
h AS (SELECT *, alpha / (alpha + beta) AS mean FROM p_host),
j AS (SELECT *, round(mean, 9) AS bad_rate, round(least(1.0, mean + {Z} * sqrt(mean * (1 - mean) / (alpha + beta + 1))), 9) AS bad_bound FROM h)
SELECT page_id, x.host, x.domain, x.suffix, j.n::BIGINT AS n_labels, j.bad::BIGINT AS n_bad, bad_rate, bad_bound, bad_bound <= {BOUND} AS keep
FROM x LEFT JOIN j ON x.host IS NOT DISTINCT FROM j.host"""
