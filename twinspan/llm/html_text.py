"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as a flat row of text blocks, broken at every tag that isn't inline. Each block has its
number of words and the density of its linked words, the same of the blocks before and after it, and
what its surroundings say: whether it lies in a part that is named as no content (navigation, asides,
forms and the like, by tag, role or a whole class or id), whether in an article, and whether in one whose class or id has a word
that only hints at no content; what share of its words is of phrases that notices have; and whether it lies beside an article that has most of the page's words. Classes and ids of articles and headings are not looked at. A decision tree, grown on the
small labelled table below, tells content from the rest. Kept blocks are joined in page order.

Each page is read once, in time in proportion to its length, by the task that has it; nothing is
shuffled. Null and empty html give the empty text. Broken markup is read as far as it goes: an end tag
without a start is passed over, an open element ends with its parent, a tag that the page's end cuts off
is dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinspan.plans.scratch import bounded_batches
from twinspan.sources.tables import table


class Block(NamedTuple):
    text: str
    words: int
    links: float  # share of the words that are within links
    aside: bool  # in a part that is named as no content
    article: bool  # in an article or main element
    vague: bool  # in a part whose name hints at no content
    cues: float = 0.0  # share of the words that are of phrases of notices


# Element names.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe svg canvas select textarea button title math".split())
ASIDE = frozenset("nav header footer aside dialog menu".split())
VAGUE = frozenset("form fieldset".split())  # also around whole pages
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset("option optgroup".split())}
#: Whole class or id tokens that name no content on any page.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense adsbygoogle adbox ad-banner ad-container ad-slot ad-wrapper banner-ad sponsored sponsored-content "
    "breadcrumb breadcrumbs comments comment-list commentlist comments-area comment-respond disqus_thread sidebar navbar nav nav-menu main-menu masthead pagination pager "
    "cookie-banner cookie-bar cookie-consent cookie-notice gdpr-banner site-header site-footer page-footer skip-link share-buttons social-share social-links related-posts "
    "related-articles newsletter-signup newsletter-form login-form search-form paywall".split()
)
#: Words of class or id tokens that name no content on some pages and content on others; a feature of the tree.
VAGUE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup "
    "promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar "
    "tracking widget widgets alert alerts reply replies respond responses discussion feedback search copyright legal disclaimer paywall".split()
)
#: Elements whose class and id say nothing: they are the content, or head it.
UNNAMED = frozenset("article main h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Phrases of notices; those of licences aren't among them, as they belong to the text.
_CUES = re.compile(
    r"\b(?:we use cookies|(?:accept|allow)(?: all)? cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|(?:subscribe|sign up)(?: (?:to|for) (?:our|the))?(?: newsletter)?|newsletter|"
    r"share (?:this|on)|follow us|log in|sign in|advertisement|sponsored(?: content)?|skip to (?:main )?content|click here|read more|related (?:articles|posts|stories)|leave a (?:comment|reply)|"
    r"werbung|anzeige|publicité)\b",
    re.I,
)
_PARTS = re.compile(r"[a-z]+")


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no content by its attributes, and whether its class or id only hints at that."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c).lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or found.get("itemprop") == "comment":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, False
    if tag in UNNAMED:
        return False, False
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    if not ASIDE_NAMES.isdisjoint(names):
        return True, False
    parts = [{*_PARTS.findall(x)} for x in names]
    return False, any(not VAGUE_NAMES.isdisjoint(x) and not {"has", "no", "with"} & x for x in parts)  # of a part, not of the page around one


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in its order, with character references decoded and white space made one space."""
    out: list[Block] = []
    open_: list[tuple[str, int, bool, bool, bool]] = []  # tag; and of what it lies in: skipped, no content, article, hinted at
    skip, aside, article, vague, link = 0, False, False, False, 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                share = len(html.unescape("".join(linked)).split()) / n if linked else 0.0
                heads = bool(open_) and open_[-1][0] in UNNAMED and open_[-1][0] not in ("article", "main")
                cues = sum(x.count(" ") + 1 for x in _CUES.findall(text)) / n if n <= 60 and not heads else 0.0
                out.append(Block(text, n, min(1.0, share), aside, article, vague, cues))
            parts.clear()
            linked.clear()

    def leave(k: int) -> None:
        nonlocal skip, aside, article, vague
        flush()
        skip, aside, article, vague = open_[k][1:]
        del open_[k:]

    at, page = 0, page or ""
    for m in _TAG.finditer(page):
        if m.start() > at and not skip:
            parts.append(page[at : m.start()])
            if link:
                linked.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and not skip:
                flush()
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = 0
                if linked:
                    linked.append(" ")
            elif tag not in INLINE:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == tag:
                        leave(k)
                        break
                else:
                    flush()
            elif any(x[0] == tag for x in open_):
                leave(max(k for k, x in enumerate(open_) if x[0] == tag))
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = 1
            elif tag not in VOID and m[4] and _named(tag, m[4])[0]:
                flush()
                open_.append((tag, skip, aside, article, vague))
                aside = True
            continue
        while open_ and tag in CLOSED_BY.get(open_[-1][0], ()):
            leave(len(open_) - 1)
        flush()
        if tag in VOID:
            continue
        link = 0
        open_.append((tag, skip, aside, article, vague))
        if tag in SKIPPED:
            skip = 1
        if tag == "body":
            skip = 0
        if tag in ("article", "main"):
            article, vague = True, False  # names of what lies around an article say nothing of it
        if tag in VAGUE:
            vague = True
        elif tag in ASIDE and not (tag == "header" and article):  # that of an article has its title
            aside = True
        if m[4] and tag not in ("html", "body"):
            sure, hint = _named(tag, m[4])
            aside, vague = aside or sure, vague or hint
    if not skip:
        parts.append(page[at:])
    flush()
    return out


# The labelled table. Words and link density of the block before, the block and the block after; and
# whether it is content in an article, in a hinted part of one, in neither, and in a hinted part outside. In a part
# named as no content it never is, nor beside an article that has most of the page's words. A last number is the share of words that are of notices' phrases.
SITUATIONS = (
    # running text
    (0, 0.0, 80, 0.0, 0, 0.0, "1111"), (0, 0.0, 120, 0.0, 60, 0.0, "1111"), (60, 0.0, 48, 0.05, 70, 0.0, "1111"), (9, 0.0, 33, 0.0, 41, 0.0, "1111"), (41, 0.0, 26, 0.1, 2, 1.0, "1111"),
    (2, 1.0, 60, 0.0, 55, 0.0, "1111"), (1, 1.0, 30, 0.0, 1, 1.0, "1111"), (35, 0.0, 19, 0.2, 22, 0.1, "1111"), (25, 0.1, 70, 0.3, 40, 0.0, "1111"), (30, 0.0, 12, 0.4, 44, 0.0, "1111"),
    (70, 0.0, 14, 0.0, 30, 0.0, "1111"), (0, 0.0, 18, 0.0, 60, 0.0, "1111"), (12, 0.0, 95, 0.0, 3, 0.0, "1111"), (95, 0.0, 130, 0.0, 25, 0.1, "1111"), (50, 0.0, 27, 0.0, 4, 0.0, "1111"), (70, 0.0, 40, 0.0, 3, 0.0, "1111"), (90, 0.0, 45, 0.0, 0, 0.0, "1111"), (80, 0.0, 30, 0.0, 2, 1.0, "1111"), (100, 0.0, 60, 0.0, 8, 0.0, "1111"),
    (3, 1.0, 30, 0.0, 0, 0.0, "1111"), (2, 1.0, 60, 0.0, 0, 0.0, "1111"), (1, 1.0, 35, 0.1, 4, 0.0, "1111"), (5, 0.9, 50, 0.0, 2, 1.0, "1111"), (4, 1.0, 12, 0.0, 0, 0.0, "1010"), (1, 1.0, 20, 0.0, 0, 0.0, "1010"), (2, 1.0, 9, 0.0, 0, 0.0, "1010"),
    (8, 1.0, 12, 0.0, 3, 1.0, "1010"), (4, 1.0, 9, 0.0, 3, 1.0, "1010"), (20, 1.0, 15, 0.0, 3, 1.0, "1010"), (5, 1.0, 30, 0.0, 3, 1.0, "1111"), (70, 1.0, 60, 0.0, 2, 1.0, "1111"), (30, 0.0, 5, 0.0, 2, 1.0, "1010"), (60, 0.0, 4, 0.0, 3, 1.0, "1010"),
    (40, 0.0, 11, 0.0, 3, 1.0, "1110"), (3, 1.0, 13, 0.0, 2, 1.0, "1010"), (4, 0.0, 16, 0.0, 5, 0.0, "1010"), (0, 0.0, 20, 0.0, 3, 1.0, "1010"), (2, 1.0, 24, 0.0, 2, 0.0, "1010"),
    (25, 0.0, 26, 0.0, 0, 0.0, "1111"), (22, 0.0, 20, 0.0, 0, 0.0, "1111"), (18, 0.0, 35, 0.0, 0, 0.0, "1111"), (30, 0.0, 24, 0.1, 1, 1.0, "1111"), (16, 0.0, 22, 0.0, 2, 0.0, "1111"), (20, 0.0, 28, 0.0, 8, 0.0, "1111"),
    # few words beside running text
    (70, 0.0, 6, 0.0, 90, 0.0, "1111"), (90, 0.0, 4, 0.0, 35, 0.0, "1111"), (45, 0.0, 1, 0.0, 50, 0.0, "1111"), (55, 0.0, 3, 0.0, 28, 0.1, "1111"), (30, 0.0, 8, 0.0, 44, 0.0, "1111"),
    (1, 1.0, 2, 0.0, 130, 0.0, "1111"), (1, 1.0, 8, 0.0, 64, 0.0, "1111"), (2, 1.0, 1, 0.0, 25, 0.0, "1111"), (0, 0.0, 1, 0.0, 40, 0.0, "1111"), (0, 0.0, 7, 0.0, 58, 0.0, "1111"),
    (0, 0.0, 4, 0.0, 18, 0.1, "1111"), (3, 0.0, 5, 0.0, 30, 0.0, "1111"), (2, 0.0, 2, 0.0, 20, 0.0, "1111"), (60, 0.0, 5, 0.0, 4, 0.0, "1010"), (45, 0.0, 2, 0.0, 0, 0.0, "1010"),
    (80, 0.0, 6, 0.0, 3, 1.0, "1010"), (30, 0.0, 9, 0.0, 1, 1.0, "1010"), (70, 0.0, 1, 0.0, 3, 0.0, "1010"), (40, 0.0, 4, 0.0, 5, 0.0, "1010"),
    # few words beside few
    (5, 0.0, 4, 0.0, 3, 0.0, "1010"), (4, 0.0, 3, 0.0, 5, 0.0, "1010"), (0, 0.0, 2, 0.0, 3, 0.0, "1010"), (3, 0.0, 1, 0.0, 2, 0.0, "1010"), (2, 0.0, 2, 0.0, 0, 0.0, "1010"),
    (0, 0.0, 1, 0.0, 0, 0.0, "1010"), (0, 0.0, 3, 0.0, 0, 0.0, "1010"), (0, 0.0, 8, 0.0, 0, 0.0, "1010"), (8, 0.0, 7, 0.0, 6, 0.0, "1010"), (1, 0.0, 1, 0.0, 1, 0.0, "1010"),
    (9, 0.0, 9, 0.0, 9, 0.0, "1010"), (6, 0.0, 5, 0.0, 10, 0.0, "1010"), (11, 0.1, 1, 0.0, 12, 0.0, "1010"), (1, 1.0, 3, 0.0, 4, 0.0, "1010"), (2, 1.0, 1, 0.0, 6, 0.0, "1010"),
    # few words beside links
    (1, 1.0, 2, 0.0, 1, 1.0, "0000"), (4, 1.0, 6, 0.0, 2, 1.0, "0000"), (2, 1.0, 5, 0.0, 0, 0.0, "0000"), (1, 1.0, 1, 0.0, 0, 0.0, "0000"), (5, 0.9, 4, 0.0, 3, 0.8, "0000"),
    (20, 0.0, 3, 0.0, 2, 1.0, "0000"), (60, 0.0, 1, 0.0, 4, 1.0, "0000"), (35, 0.0, 2, 0.0, 3, 0.9, "0000"), (0, 0.0, 2, 0.0, 3, 1.0, "1000"), (0, 0.0, 3, 0.0, 1, 1.0, "1000"),
    # links
    (1, 1.0, 1, 1.0, 1, 1.0, "0000"), (2, 1.0, 3, 1.0, 2, 1.0, "0000"), (0, 0.0, 2, 1.0, 3, 1.0, "0000"), (0, 0.0, 1, 1.0, 30, 0.0, "0000"), (45, 0.0, 1, 1.0, 2, 1.0, "0000"),
    (90, 0.0, 2, 1.0, 1, 1.0, "0000"), (3, 1.0, 2, 0.5, 4, 1.0, "0000"), (70, 0.0, 5, 0.8, 3, 1.0, "0000"), (5, 0.8, 24, 0.9, 4, 1.0, "0000"), (4, 1.0, 18, 0.9, 6, 1.0, "0000"),
    (1, 1.0, 2, 1.0, 70, 0.0, "0000"), (60, 0.0, 40, 0.7, 8, 0.9, "0000"), (12, 1.0, 15, 0.6, 30, 0.0, "0000"), (50, 0.0, 3, 1.0, 0, 0.0, "0000"), (2, 1.0, 2, 1.0, 0, 0.0, "0000"),
    (2, 0.0, 1, 1.0, 1, 1.0, "0000"), (0, 0.0, 4, 1.0, 0, 0.0, "0000"), (1, 1.0, 4, 0.8, 2, 0.0, "0000"), (50, 0.0, 4, 1.0, 60, 0.0, "1000"), (44, 0.0, 6, 1.0, 10, 0.0, "1000"),
    (55, 0.0, 3, 1.0, 64, 0.0, "1000"), (40, 0.0, 2, 1.0, 35, 0.0, "1000"), (25, 0.0, 9, 0.8, 20, 0.0, "1000"), (5, 0.0, 3, 1.0, 4, 0.0, "1000"), (30, 0.0, 12, 0.6, 44, 0.0, "1000"),
    # notices, and text that names what notices do
    (60, 0.0, 1, 0.0, 55, 0.0, "0000", 1.0), (40, 0.0, 3, 0.0, 30, 0.0, "0000", 0.67), (70, 0.0, 7, 0.0, 60, 0.0, "0000", 0.57), (50, 0.0, 9, 0.0, 45, 0.0, "0000", 0.33), (30, 0.0, 14, 0.0, 20, 0.0, "0000", 0.4),
    (0, 0.0, 2, 0.0, 60, 0.0, "0000", 1.0), (20, 0.0, 4, 0.0, 0, 0.0, "0000", 0.75), (45, 0.0, 18, 0.0, 3, 0.0, "0000", 0.35), (5, 0.0, 3, 0.0, 4, 0.0, "0000", 0.67), (90, 0.0, 25, 0.0, 70, 0.0, "0000", 0.32),
    (60, 0.0, 30, 0.0, 50, 0.0, "1111", 0.1), (50, 0.0, 13, 0.0, 45, 0.0, "1111", 0.15), (40, 0.0, 7, 0.0, 60, 0.0, "1111", 0.28), (70, 0.0, 45, 0.0, 60, 0.0, "1111", 0.08), (0, 0.0, 10, 0.0, 50, 0.0, "1111", 0.2),
    # titles above links to authors and the like
    (3, 1.0, 1, 0.0, 1, 0.0, "1010"), (2, 1.0, 2, 0.0, 1, 0.0, "1010"), (4, 1.0, 1, 0.0, 2, 0.0, "1010"), (2, 1.0, 2, 0.0, 2, 0.0, "1010"), (0, 0.0, 5, 0.0, 2, 1.0, "1000"), (0, 0.0, 7, 0.0, 2, 1.0, "1010"), (3, 0.0, 6, 0.0, 1, 1.0, "1010"),
)
#: One row for each situation and surroundings: the features of a block, and whether it is content.
LABELLED = tuple(
    (*s[:6], aside, article, vague, *(s[7:] or (0.0,)), beside, int(label))
    for s in SITUATIONS
    for (aside, article, vague, beside), label in zip(((0, 1, 0, 0), (0, 1, 1, 0), (0, 0, 0, 0), (0, 0, 1, 0), (1, 0, 0, 0), (1, 1, 0, 0), (0, 0, 0, 1), (0, 0, 1, 1)), s[6] + "0000", strict=True)
)

Tree = tuple[int, float, "Tree", "Tree"] | float


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A decision tree by Gini impurity: (column, threshold, tree at or below, tree above), or a leaf's share of 1."""
    if depth == 0 or len(set(y)) == 1:
        return float(y.mean())
    best: tuple[float, int, float] | None = None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= t
            cost = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, c, float(t))
    if best is None:
        return float(y.mean())
    _, c, t = best
    low = x[:, c] <= t
    return c, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(1)
def tree() -> Tree:
    rows = np.array(LABELLED)
    return grow(rows[:, :-1], rows[:, -1], 9)


def is_content(features: tuple[float, ...]) -> bool:
    at = tree()
    while isinstance(at, tuple):
        at = at[2] if features[at[0]] <= at[1] else at[3]
    return at >= 0.5


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    none = Block("", 0, 0.0, False, False, False, 0.0)
    around = zip([none, *found[:-1]], found, [*found[1:], none], strict=True)
    within = sum(b.words for b in found if b.article and not b.aside)
    most = within >= 30 and 2 * within >= sum(b.words for b in found if not b.aside)
    return " ".join(b.text for a, b, c in around if is_content((a.words, a.links, b.words, b.links, c.words, c.links, b.aside, b.article, b.vague, b.cues, most and not b.article)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Repeated rows come out as often; columns beside page_id, url and html are left alone; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
