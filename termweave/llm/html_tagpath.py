"""Content extraction from HTML by tag-path ratios.

The text nodes of a page are grouped by their tag path from the root. Each path
has two ratios: characters per node and punctuation marks per node. Both are
smoothed over the page (a node's value is mixed with its neighbours'), averaged
again by path, and fused: length * (1 + punctuation). Paths whose fused ratio is
at least THRESHOLD standard deviations (over the nodes of the page) hold content,
and so do inline tags (bold, links) right inside them.
Punctuation is that of any script. What lies in a nav, menu, footer, button, select or textarea
that its own end tag closes is boilerplate whatever its ratio, and takes no part in
the threshold; where such a tag isn't closed, or where nothing else is left, the
ratios decide there, too (in the latter case, on paths with any punctuation).

Defined cases: a null page has null content and zeros; an empty one, or one
without text, has empty content; broken markup is read as far as it goes (an
unclosed comment, script, style or tag reaches to the end); a page of any length or depth
is read whole, in time in proportion to its length; repeated rows give repeated results; a null id stays null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

THRESHOLD = 0.3
KERNEL = (0.1, 0.8, 0.1)

#: What follows a tag's name: a quote counts after = only; what isn't closed reaches to the end.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)"""
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|svg|title)\b{_REST}.*?(?:</\1\s*+>|\Z)
    |<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-z][a-z0-9:-]*+){_REST}""",
    re.I | re.S | re.X,
)
_SPACE = re.compile(r"\s+")
#: Every character of a category of punctuation.
_PUNCTUATION = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x11000)) if unicodedata.category(c)[0] == "P") + "]")
_MARKS = b"!\"#%&'()*,-./:;?@[\\]_{}"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a new tag closes, and what bounds the search for them.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES |= dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), ("p",))
_BOUNDS = {"p": frozenset("article aside body div footer header main nav section td th li table blockquote".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))}
_TABLE = frozenset(("table",))
_FURNITURE = frozenset("button footer menu nav select textarea".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code em font i kbd mark q s samp small span strong sub sup time tt u var wbr img".split())


class _Paths:
    """Tag paths as numbers: each is that of its parent and one tag, so that depth costs nothing."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.block = [-1], [""], [0]

    def child(self, parent: int, tag: str) -> int:
        n = self.number.get((parent, tag))
        if n is None:
            n = self.number[parent, tag] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            #: the path without the inline tags at its end
            self.block.append(self.block[parent] if tag in _INLINE else n)
        return n

    def name(self, n: int) -> str:
        tags = []
        while n:
            tags.append(self.tag[n])
            n = self.parent[n]
        return "/".join(reversed(tags))


def _scan(page: str) -> tuple[_Paths, list[int], list[str], list[bool], list[bool]]:
    """Paths, and (path, text, does it begin a new block, is it in closed furniture) of every text node that isn't blank."""
    known = _Paths()
    paths, texts, breaks, inner = [], [], [], []
    stack: list[str] = []
    trail = [0]  # the path of each depth
    depths: dict[str, list[int]] = {}  # where in the stack each tag is
    #: Furniture: the one around each and whether it was closed, by number; those open now, with their depth.
    around, closed = [-1], [False]
    open_: list[tuple[int, int]] = [(-1, 0)]
    at, fresh = 0, True

    def cut(k: int) -> None:
        for tag in stack[k:]:
            depths[tag].pop()
        del stack[k:], trail[k + 1 :]
        while open_[-1][0] >= k:
            open_.pop()

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def add(raw: str) -> None:
        nonlocal fresh
        text = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw)
        if text.strip():
            paths.append(trail[-1])
            texts.append(text)
            breaks.append(fresh)
            inner.append(open_[-1][1])
            fresh = False

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            fresh = True
        if m[2]:
            if depths.get(tag):
                k = depths[tag][-1]
                if tag in _FURNITURE:
                    closed[next(n for depth, n in reversed(open_) if depth == k)] = True
                cut(k)
            continue
        if closes := _CLOSES.get(tag):
            k = deepest(closes)
            if k > deepest(_BOUNDS.get(closes[0], _TABLE)):
                cut(k)
        if tag not in _VOID and not m[0].endswith("/>"):
            if tag in _FURNITURE:
                around.append(open_[-1][1])
                closed.append(False)
                open_.append((len(stack), len(closed) - 1))
            depths.setdefault(tag, []).append(len(stack))
            trail.append(known.child(trail[-1], tag))
            stack.append(tag)
    if at < len(page):
        add(page[at:])
    for n in range(1, len(closed)):
        closed[n] |= closed[around[n]]
    return known, paths, texts, breaks, [closed[n] for n in inner]


def nodes(page: str) -> tuple[list[str], list[str], list[bool]]:
    """(path, text, does it begin a new block) of every text node that isn't blank."""
    known, paths, texts, breaks, _ = _scan(page)
    names = {p: known.name(p) for p in set(paths)}
    return [names[p] for p in paths], texts, breaks


def marks(text: str) -> int:
    """How many punctuation marks a text has, those of any script."""
    if text.isascii():
        return len(text) - len(text.encode().translate(None, _MARKS))
    return len(_PUNCTUATION.findall(text))


def ratios(paths: list, texts: list[str]) -> tuple[dict, float]:
    """(fused ratio of each path, threshold)."""
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([number[p] for p in paths])
    size = np.bincount(of)

    def smooth(amount: list[int]) -> np.ndarray:
        node = (np.bincount(of, weights=amount) / size)[of]
        padded = np.pad(node, 1, mode="edge")
        mixed = KERNEL[0] * padded[:-2] + KERNEL[1] * padded[1:-1] + KERNEL[2] * padded[2:]
        return np.bincount(of, weights=mixed) / size

    fused = smooth([len(t.strip()) for t in texts]) * (1 + smooth([marks(t) for t in texts]))
    return dict(zip(number, fused.tolist())), THRESHOLD * float(fused[of].std())


def extract(page: str) -> tuple[str, int, int]:
    """(content, text nodes, content nodes) of a page."""
    known, paths, texts, breaks, furniture = _scan(page)
    if not texts:
        return "", 0, 0
    own = [i for i, inside in enumerate(furniture) if not inside]
    if rest := not own:
        own = list(range(len(texts)))
    fused, least = ratios([paths[i] for i in own], [texts[i] for i in own])
    if rest:
        marked = {p for p, t in zip(paths, texts) if marks(t)}
        fused = {p: f if p in marked or known.block[p] in marked else -1.0 for p, f in fused.items()}
    out: list[str] = []
    count, pending = 0, False
    chosen = {p: fused[p] >= least or fused.get(known.block[p], -1.0) >= least for p in fused}
    for path, text, fresh, inside in zip(paths, texts, breaks, furniture):
        pending |= fresh
        if (rest or not inside) and chosen[path]:
            out.append("\n" + text if out and pending else text)
            pending = False
            count += 1
    content = "".join(out)
    return "\n".join(line.strip() for line in content.split("\n")), len(texts), count


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = [(None, 0, 0) if p is None else extract(p) for p in part.column(1).to_pylist()]
            content, count, kept = zip(*found)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.string()), pa.array(count, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "content", "n_nodes", "n_content_nodes"])
    tidy()


def extract_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, content, n_nodes, n_content_nodes) of every page. One pass, no shuffle."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(_run, "page_id long, content string, n_nodes long, n_content_nodes long")
