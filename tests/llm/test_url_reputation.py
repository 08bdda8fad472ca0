"""Host reputation against SQL and plain arithmetic."""

from __future__ import annotations

import holding
import pytest
from pyspark.sql import functions as F

from termweave.llm import queries, url_reputation


def test_query_agrees_with_sql(spark, duck, small):
    df = queries.op1_url_reputation(spark, small)
    names, wanted = holding.of_sql(duck, url_reputation.SQL)
    assert sorted(df.columns) == names
    found = holding.of(df)
    assert len(found) == len(wanted) > 0
    for a, b in zip(found, wanted):
        assert a == pytest.approx(b, abs=2e-9)


@pytest.mark.parametrize(
    ("url", "parts"),
    [
        ("https://www.News.example.co.uk:80/a/1?x#y", ("www.news.example.co.uk", "example.co.uk", "co.uk")),
        ("http://user:pw@a.b.com./x", ("a.b.com", "b.com", "com")),
        ("ftp://localhost/x", ("localhost", "localhost", "localhost")),
        ("no url", (None, None, None)),
        (None, (None, None, None)),
        ("https://co.uk/", ("co.uk", "co.uk", "co.uk")),
    ],
)
def test_parts(spark, url, parts):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(*(p.alias(f"p{i}") for i, p in enumerate(url_reputation.parts(F.col("url"))))).first()) == parts


def test_few_labels_lean_on_the_domain(spark):
    """One good label on a host of a bad domain doesn't clear it; many good labels do."""
    pages, labels, n = [], [], 0

    def add(host: str, bad: int, good: int) -> None:
        nonlocal n
        for i in range(bad + good):
            n += 1
            pages.append((n, f"https://{host}/{n}"))
            labels.append((n, int(i >= bad), 0))

    add("a.bad.com", 40, 2)
    add("b.bad.com", 38, 1)
    add("c.bad.com", 0, 1)
    add("a.good.com", 1, 60)
    add("b.good.com", 0, 50)
    add("c.good.com", 0, 1)
    pages.append((10_000, "https://d.good.com/none"))
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["host"]: r for r in url_reputation.judge(p, l).collect()}
    assert found["c.bad.com"]["bad_rate"] > 0.3 and not found["c.bad.com"]["keep"] and not found["a.bad.com"]["keep"]
    assert found["a.good.com"]["keep"] and found["b.good.com"]["keep"] and found["c.good.com"]["bad_rate"] < 0.2
    assert found["d.good.com"]["n_labels"] == 0 and found["d.good.com"]["bad_bound"] >= found["b.good.com"]["bad_bound"]


@pytest.mark.parametrize("suffix", ["com", "com.sg", "com.hk", "co.id", "com.ar", "co.il", "edu.au", "github.io", "x.ck", "x.kawasaki.jp"])
def test_few_labels_lean_on_the_domain_under_any_suffix(spark, suffix):
    """As under .com: one good label on a host of a bad domain doesn't clear it, however good its neighbours are."""
    pages, labels, n = [], [], 0
    for host, bad, good in (("a.bad", 40, 2), ("b.bad", 38, 1), ("c.bad", 0, 1), ("a.good", 1, 60), ("b.good", 0, 50), ("c.good", 0, 1), ("a.fine", 0, 90), ("a.best", 0, 90)):
        for i in range(bad + good):
            n += 1
            pages.append((n, f"https://{host}.{suffix}/{n}"))
            labels.append((n, int(i >= bad), 0))
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["host"].removesuffix(f".{suffix}"): r for r in url_reputation.judge(p, l).collect()}
    assert {r["domain"] for r in found.values()} == {f"{d}.{suffix}" for d in ("bad", "good", "fine", "best")}
    assert found["c.bad"]["bad_rate"] > 0.3 and not found["c.bad"]["keep"] and not found["a.bad"]["keep"]
    assert found["a.good"]["keep"] and found["b.good"]["keep"] and found["c.good"]["bad_rate"] < 0.2


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [
        ("a.b.shop.com.sg", "shop.com.sg", "com.sg"),
        ("user.github.io", "user.github.io", "github.io"),
        ("github.io", "github.io", "github.io"),
        ("a.b.c.ck", "b.c.ck", "c.ck"),
        ("a.www.ck", "www.ck", "ck"),
        ("ck", "ck", "ck"),
        ("x.city.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp"),
        ("x.y.other.kawasaki.jp", "y.other.kawasaki.jp", "other.kawasaki.jp"),
        ("a.b.公司.cn", "b.公司.cn", "公司.cn"),
        ("a.b.xn--55qx5d.cn", "b.xn--55qx5d.cn", "xn--55qx5d.cn"),
        ("a.b.nosuchsuffix", "b.nosuchsuffix", "nosuchsuffix"),
    ],
)
def test_rules_of_the_public_suffix_list(spark, host, domain, suffix):
    df = spark.createDataFrame([(f"https://{host}/1",)], "url string")
    assert tuple(df.select(*(p.alias(f"p{i}") for i, p in enumerate(url_reputation.parts(F.col("url"))))).first()) == (host, domain, suffix)


def test_addresses_are_their_own_domains(spark):
    urls = ["http://10.0.0.7/a/1", "http://[2001:db8::1]:8080/x", "http://10.0.0.example.com/2", "https://user@[::1]/3"]
    host, domain, suffix = url_reputation.parts(F.col("url"))
    found = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), domain.alias("d"), suffix.alias("s")).collect()
    assert {r["url"]: r[1:] for r in found} == {
        urls[0]: ("10.0.0.7",) * 3,
        urls[1]: ("[2001:db8::1]",) * 3,
        urls[2]: ("10.0.0.example.com", "example.com", "com"),
        urls[3]: ("[::1]",) * 3,
    }
