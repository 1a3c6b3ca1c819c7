"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into flat blocks (text between block-level tags).  A block is described by its
word count and link density, those of the blocks before and after it, and where it stands:
inside an article, inside a navigation-like element, under a class or id that names page
furniture, in a heading, on a page that marks its article at all.  A decision tree (CART,
Gini), fitted to the small labelled table ``LABELLED``, says which blocks are main text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title|textarea|iframe|svg|select|object|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input button".split())
_KEPT_OPEN = frozenset("article main nav header footer aside form section div ul ol dl table blockquote figure fieldset dialog menu details body".split())
_FURNITURE = frozenset("nav header footer aside form fieldset dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or id that name page furniture.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright "
    "dialog disclaimer discussion disqus feedback footer gdpr header legal links login masthead menu meta modal nav navbar navigation newsletter notice "
    "notices overlay paging pagination popup privacy promo promoted promotion recommended related replies reply respond rail search share sharing "
    "sidebar signup skip skyscraper social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets alert".split()
)
_SPLIT = re.compile(r"[^a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_furniture", "hinted", "heading", "article_on_page")

#: The labelled table: FEATURES of a block, then 1 for main text.  Drawn up by hand from typical pages.
LABELLED = (
    # pages that mark their article: what is inside, however short
    (6, 0.0, 8, 0.0, 40, 0.0, 1, 0, 0, 1, 1, 1), (42, 0.0, 6, 0.0, 60, 0.0, 1, 0, 0, 0, 1, 1), (120, 0.02, 42, 0.0, 80, 0.0, 1, 0, 0, 0, 1, 1),
    (3, 0.0, 120, 0.0, 60, 0.0, 1, 0, 0, 0, 1, 1), (1, 0.0, 30, 0.0, 25, 0.0, 1, 0, 0, 0, 1, 1), (15, 0.4, 60, 0.0, 70, 0.1, 1, 0, 0, 0, 1, 1),
    (9, 1.0, 60, 0.0, 70, 0.1, 1, 0, 0, 0, 1, 1), (12, 0.0, 60, 0.0, 12, 0.1, 1, 0, 0, 0, 1, 1), (5, 0.0, 60, 0.0, 55, 0.0, 1, 0, 0, 1, 1, 1),
    (200, 0.01, 90, 0.0, 9, 0.0, 1, 0, 0, 0, 1, 1), (8, 0.0, 1, 1.0, 33, 0.0, 1, 0, 0, 0, 1, 1), (25, 0.1, 4, 0.0, 4, 0.0, 1, 0, 0, 0, 1, 1),
    (4, 0.0, 80, 0.0, 11, 0.1, 1, 0, 0, 0, 1, 1), (66, 0.0, 66, 0.0, 66, 0.0, 1, 0, 0, 0, 1, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0, 1, 1),
    (50, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 0, 1, 1), (12, 0.0, 60, 0.0, 2, 1.0, 1, 0, 0, 0, 1, 1), (5, 0.0, 40, 0.0, 4, 1.0, 1, 0, 0, 1, 1, 1),
    (120, 0.05, 30, 0.0, 20, 0.5, 1, 0, 0, 0, 1, 1), (8, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 1, 1), (24, 0.3, 9, 1.0, 9, 1.0, 1, 0, 0, 0, 1, 1),
    (2, 1.0, 12, 0.0, 2, 1.0, 1, 0, 0, 0, 1, 1), (70, 0.0, 50, 0.0, 6, 0.7, 1, 0, 0, 0, 1, 1), (31, 0.0, 4, 1.0, 4, 0.3, 1, 0, 0, 0, 1, 1),
    # furniture inside an article: adverts, notices, comments, share bars, forms, asides
    (14, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 0, 1, 0), (45, 0.0, 60, 0.0, 30, 0.0, 1, 0, 1, 0, 1, 0), (5, 1.0, 60, 0.0, 4, 1.0, 1, 0, 1, 0, 1, 0),
    (30, 0.0, 12, 0.0, 25, 0.0, 1, 0, 1, 0, 1, 0), (80, 0.0, 30, 0.0, 60, 0.0, 1, 0, 1, 0, 1, 0), (2, 0.0, 90, 0.0, 40, 0.0, 1, 0, 1, 1, 1, 0),
    (18, 0.1, 90, 0.0, 60, 0.0, 1, 1, 0, 0, 1, 0), (6, 0.0, 90, 0.0, 6, 0.0, 1, 1, 0, 0, 1, 0), (40, 0.2, 60, 0.0, 60, 0.0, 1, 1, 0, 0, 1, 0),
    (3, 0.0, 40, 0.0, 20, 0.0, 1, 1, 0, 1, 1, 0), (12, 0.0, 30, 0.0, 44, 0.0, 1, 1, 1, 0, 1, 0), (70, 0.0, 20, 0.0, 35, 0.0, 1, 1, 1, 0, 1, 0),
    # what stands outside the marked article
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0, 1, 0),
    (8, 0.0, 1, 1.0, 6, 0.0, 0, 0, 1, 0, 1, 0), (22, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 0, 1, 0), (55, 0.0, 2, 1.0, 10, 0.0, 0, 0, 1, 0, 1, 0),
    (9, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 1, 0), (14, 0.1, 70, 0.0, 3, 1.0, 0, 1, 0, 0, 1, 0), (20, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0),
    (34, 0.0, 90, 0.0, 60, 0.0, 0, 0, 0, 0, 1, 0), (60, 0.0, 40, 0.0, 30, 0.0, 0, 1, 0, 0, 1, 0), (4, 0.0, 20, 0.0, 30, 0.0, 0, 0, 0, 1, 1, 0),
    (75, 0.0, 10, 0.0, 60, 0.0, 0, 0, 0, 0, 1, 0), (12, 0.0, 0, 0.0, 9, 0.0, 0, 0, 0, 0, 1, 0), (90, 0.0, 50, 0.0, 44, 0.0, 0, 0, 1, 0, 1, 0),
    (7, 0.5, 7, 0.5, 7, 0.5, 0, 0, 0, 0, 1, 0), (16, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1, 1, 1, 0), (28, 0.1, 4, 0.0, 50, 0.0, 0, 1, 1, 0, 1, 0),
    # pages without a marked article: long runs of plain text and what leads to them
    (40, 0.0, 5, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1), (80, 0.05, 40, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1),
    (18, 0.0, 70, 0.0, 8, 0.0, 0, 0, 0, 0, 0, 1), (150, 0.1, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (12, 0.0, 33, 0.0, 52, 0.0, 0, 0, 0, 0, 0, 1),
    (6, 0.0, 50, 0.0, 48, 0.0, 0, 0, 0, 0, 0, 1), (5, 0.0, 1, 1.0, 44, 0.0, 0, 0, 0, 1, 0, 1), (4, 0.0, 66, 0.0, 30, 0.0, 0, 0, 0, 1, 0, 1),
    (8, 0.0, 2, 0.0, 90, 0.0, 0, 0, 0, 1, 0, 1), (2, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1), (30, 0.2, 25, 0.0, 20, 0.0, 0, 0, 0, 0, 0, 1),
    (22, 0.0, 20, 0.0, 5, 0.6, 0, 0, 0, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (17, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (60, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (35, 0.05, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (100, 0.0, 2, 1.0, 4, 0.9, 0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0), (6, 0.8, 4, 0.9, 5, 1.0, 0, 0, 0, 0, 0, 0),
    (20, 0.9, 30, 0.0, 22, 0.9, 0, 0, 0, 0, 0, 0), (4, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0, 0),
    (30, 0.6, 40, 0.0, 5, 1.0, 0, 0, 0, 0, 0, 0), (5, 0.4, 6, 0.5, 0, 0.0, 0, 0, 0, 0, 0, 0), (2, 0.0, 3, 0.3, 3, 0.2, 0, 0, 0, 0, 0, 0),
    (12, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1, 0, 0, 0), (50, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1, 0, 0, 0), (90, 0.0, 40, 0.0, 30, 0.0, 0, 0, 1, 0, 0, 0),
    (10, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0), (40, 0.0, 60, 0.0, 5, 0.0, 0, 1, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 9, 0.0, 0, 1, 0, 0, 0, 0),
    (3, 0.0, 44, 0.0, 60, 0.0, 0, 1, 0, 1, 0, 0), (70, 0.0, 44, 0.0, 60, 0.0, 0, 1, 1, 0, 0, 0), (5, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1, 1, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A tree of (feature, cut, at or below, above); a leaf is 0 or 1."""
    share = y.mean()
    if depth == 0 or share in (0, 1):
        return int(share >= 0.5)
    best = (len(y) * 2 * share * (1 - share) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if cost < best[0] - 1e-9:
                best = (cost, (f, float(cut), low))
    if best[1] is None:
        return int(share >= 0.5)
    f, cut, low = best[1]
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree, x) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


@lru_cache(maxsize=1)
def fitted(table: tuple = LABELLED):
    t = np.array(table, float)
    return grow(t[:, :-1], t[:, -1])


def _furnished(tag: str, attrs: str, inside_article: bool) -> tuple[int, int]:
    """Whether an element is furniture by its kind, and by its names."""
    kind = tag in _FURNITURE and not (tag == "header" and inside_article)
    hint = False
    if attrs:
        for name, value in _NAMED.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                kind = kind or value in _ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hint = True
            elif name in ("class", "id"):
                words = _HINTS.intersection(_SPLIT.split(value))
                hint = hint or bool(words - {"header"} if inside_article else words)
    return int(kind), int(hint)


def blocks(html: str) -> list[list]:
    """Flat text blocks in page order: [text, words, link density, in_article, in_furniture, hinted, heading]."""
    out: list[list] = []
    parts: list[str] = []
    linked = 0  # words inside links, of the block so far
    anchor = 0
    # open elements: (tag, in_article, in_furniture, hinted)
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    loose = (0, 0)  # of a paragraph-like element, which ends with the next block tag
    heading = 0
    at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            _, art, fur, hint = stack[-1]
            out.append([text, n, min(1.0, linked / n), art, max(fur, loose[0]), max(hint, loose[1]), heading])
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if anchor:
                linked += len(text.split())

    for m in _MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            anchor = 0 if m["close"] else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _INLINE:
            continue
        flush()
        anchor = 0
        loose, heading = (0, 0), 0
        if tag in _KEPT_OPEN:
            if m["close"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                _, art, fur, hint = stack[-1]
                if tag in ("article", "main"):
                    stack.append((tag, 1, *_furnished("", m["attrs"], True)))  # what holds the article says nothing of it
                else:
                    own = _furnished(tag, m["attrs"], bool(art))
                    stack.append((tag, art, max(fur, own[0]), max(hint, own[1])))
        elif not m["close"]:
            loose = _furnished(tag, m["attrs"], bool(stack[-1][1]))
            heading = int(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
    add(html[at:])
    flush()
    return out


def main_text(html: str | None, tree=None) -> str:
    """The main text of a page; empty if there is none."""
    tree = fitted() if tree is None else tree
    found = blocks(html or "")
    marked = int(any(b[3] for b in found))
    kept = []
    for i, (text, words, links, art, fur, hint, head) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if decide(tree, (words, links, *before, *after, art, fur, hint, head, marked)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main text and its length in code points.

    Null and empty pages give the empty text; each row is taken for itself, so repeated rows
    and null ids stay; an empty table stays empty.
    """
    if {text, n_chars} & (set(pages.columns) - {html}):
        raise ValueError("pages has a column of the result's name")
    arrow_batches(pages.sparkSession)
    at = pages.columns.index(html)
    rest = [f for f in pages.schema if f.name != html]

    def run(batches):
        tree = fitted()
        for batch in batches:
            found = [main_text(t.as_py(), tree) for t in batch.column(at)]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*[f.name for f in rest], text, n_chars])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return pages.mapInArrow(run, ", ".join([*kinds, f"`{text}` string", f"`{n_chars}` long"]))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
