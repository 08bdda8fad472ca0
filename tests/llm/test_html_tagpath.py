"""Content of pages, and ratios against a plain version."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest

from termweave.llm import html_tagpath, queries

PAGE = """<!doctype html><html><head><title>T</title><style>p > a {}</style><script>if (a < b) "</p>"</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href='/b>'>News</a></ul></nav><div class=main><h1>Head &amp; line</h1>
<p>First paragraph, with <b>bold</b> words, commas, and more; it goes on for a while.<p>Second one, as long as the first: it has marks, too. And so on.
<!-- <p>not this</p> --></div><div class=side><span>Ad</span><span>Buy</span></div><footer><p>Imprint, contact, terms, and so on; a long line of words, here.</p></footer></body></html>"""


def test_content():
    content, nodes, kept = html_tagpath.extract(PAGE)
    assert content.split("\n")[-2:] == ["First paragraph, with bold words, commas, and more; it goes on for a while.", "Second one, as long as the first: it has marks, too. And so on."]
    for gone in ("Home", "News", "Imprint", "not this", "a <"):
        assert gone not in content
    assert kept <= nodes


@pytest.mark.parametrize(("page", "content"), [("", ""), ("plain text", "plain text"), ("<p>open", "open"), ("<!-- never closed <p>x</p>", ""), ("<script>x", ""), ("<a <b>", ""), ("x<b y", "x"), ("<a title='never closed>x</a>", ""), ('<a rel"odd">x</a>', "x"), ("a < b", "a < b"), ("<nav>x</nav>", ""), ("&lt;p&gt;", "<p>")])
def test_broken_markup(page, content):
    assert html_tagpath.extract(page)[0] == content


def test_ratios_against_plain_version():
    paths, texts, _ = html_tagpath.nodes(PAGE)
    fused, least = html_tagpath.ratios(paths, texts)

    def by_path(values):
        return {p: np.mean([v for q, v in zip(paths, values) if q == p]) for p in set(paths)}

    def smooth(values):
        first = by_path(values)
        node = [first[p] for p in paths]
        mixed = [0.1 * node[max(0, i - 1)] + 0.8 * x + 0.1 * node[min(len(node) - 1, i + 1)] for i, x in enumerate(node)]
        return by_path(mixed)

    length = smooth([len(t.strip()) for t in texts])
    marks = smooth([len(re.findall(r"[!\"#%&'()*,\-./:;?@\[\\\]_{}]", t)) for t in texts])
    wanted = {p: length[p] * (1 + marks[p]) for p in paths}
    assert fused == pytest.approx(wanted)
    assert least == pytest.approx(html_tagpath.THRESHOLD * np.std([wanted[p] for p in paths]))


def test_query_against_pages_one_by_one(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op10_html_extraction(spark, small).collect()
    assert {r["page_id"]: (r["content"], r["n_nodes"], r["n_content_nodes"]) for r in rows} == {i: html_tagpath.extract(p) for i, p in pages.items()}
    assert sum(bool(r["content"]) for r in rows) > 0.9 * len(rows)
    assert not any(re.search(r"</?[a-z]+>", r["content"]) for r in rows)


def test_long_hostile_pages_end_soon():
    began = time.perf_counter()
    for page in ("<" * 200_000, "<a " * 60_000, "<div>" * 20_000 + "x", '<a b="' * 30_001, "<!" * 90_000, "<script " * 30_000, "<!--" * 60_000, "</b " * 60_000):
        html_tagpath.extract(page)
    assert time.perf_counter() - began < 10


BODY = "".join(f"<p>Paragraph {i} of the article, with commas, and a full stop; it goes on for a while.</p>" for i in range(5))
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id=aspnetForm><input type=hidden>{MENU}<div class=main>{BODY}</div><select><option>One<option>Two</select></form></body>',
        f"<body>{MENU}<aside>{BODY}</aside></body>",
        f"<body><div>Skip to content</div>{MENU[:-6]}<div class=main>{BODY}</div></body>",
        f"<body><div>Skip to content</div><aside><a href=/>Ad</a><div class=main>{BODY}</div></body>",
        f"<body><nav><ul><li><a>Home</a></ul>{BODY}</nav></body>",
        f"<body><footer>{BODY}</footer></body>",
    ],
)
def test_articles_in_forms_and_unclosed_or_sole_furniture(page):
    content = html_tagpath.extract(page)[0]
    assert content.split("\n") == re.findall("<p>(.*?)</p>", BODY)


def test_closed_furniture_beside_an_article_goes():
    for tag in ("nav", "menu", "footer", "button", "select", "textarea"):
        content = html_tagpath.extract(f"<body><form>{BODY}<{tag}>Imprint, contact, terms, and so on; a long line of words, here, and there.</{tag}></form></body>")[0]
        assert "Paragraph 4" in content and "Imprint" not in content, tag
