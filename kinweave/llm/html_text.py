r"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its path of open block
elements from the root (with classes and ids, since these tell paths apart).
Per distinct path, text length, punctuation and link text are summed over its
blocks; the ratios to the number of blocks are fused into one score, which is
smoothed along the page and pooled over the path's container. Containers that
score over a share of the best one are content.

Two kinds of evidence weigh a container's score. Where a page marks its article
and the article holds its share of the running text, the article is one
container and what is outside it weighs ``OUTSIDE``. An element whose class or
id is nothing but words of page furniture (``share-buttons``, but not
``share-price``) weighs ``NAMED``, unless it holds most of the running text and
reads like an article itself: long, with sentences and few links. Names of
reader comments are never overruled so. Elements that are no content by tag,
role or the attribute ``hidden`` are left out.

A block's text has its character references decoded and white space turned
into single spaces; blocks are joined in page order by ``\n``.

Defined cases: null or empty html gives empty text; unclosed or stray tags,
comments, scripts and cut-off pages are read as far as they go; where a quote
is never closed, tags from there on end at the next ``>``; equal scores are
all content; repeated rows give repeated results; other columns are not looked
at. A null url or id passes through. Time and memory are in proportion to the
page, however deeply it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable

#: Share of the best container's score that makes a container content, the least that counts as best, and the spread of the smoothing in blocks.
SHARE, LEAST, SPREAD = 0.3, 2.0, 1.0
#: Weight of what is outside the article, and the share of the running text that an article has to hold for it.
OUTSIDE, ARTICLE_SHARE = 0.05, 0.25
#: Weight of an element named as furniture; the share, the characters and the stops of running text and the share of links that overrule its name.
NAMED, MOST, LONG, STOPS, LINKED = 0.02, 0.7, 400, 4, 0.2

_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_TAG = r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
_TOKEN = re.compile(rf"{_OTHER}|{_TAG}(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|(?P<open>[^>]*(?:>|\Z)))", re.S)
#: The same where a quote is never closed.
_LOOSE = re.compile(rf"{_OTHER}|{_TAG}(?P<rest>[^>]*(?:>|\Z))", re.S)
#: One attribute: its whole name, and its quoted or bare value.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s"'<>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; of these only ``textarea`` and ``title`` hold text, which is never content.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_NEVER = frozenset("head nav footer aside form button select option svg math canvas object audio video dialog menu fieldset datalist".split())
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_COMMENTS = r"(?:comments?|disqus|respond|responses|replies|reply)"
_FURNITURE = (
    rf"(?:ads?|advert\w*|sponsor\w*|promos?|promotion|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|footer|cookies?|consent|gdpr|notices?|"
    rf"alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommend(?:ed|ations?)|{_COMMENTS}|widgets?|"
    rf"pagination|pager|toolbar|skip|disclaimer|copyright|masthead)"
)
_LAYOUT = r"(?:box|bar|block|buttons?|container|icons?|links?|list|items?|posts?|articles?|stories|slot|unit|wrap|wrapper|inner|outer|area|section|site|page|user|reader|left|right|bottom|\d+(?:x\d+)?)"
#: A class or id token made of words of furniture and of layout, at least one of furniture.
_NAME = re.compile(rf"(?:{_LAYOUT}[_-]+)*{_FURNITURE}(?:[_-]+(?:{_FURNITURE}|{_LAYOUT}))*", re.I)
_COMMENT_NAME = re.compile(rf"(?:^|[_-]){_COMMENTS}(?:$|[_-])", re.I)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tokens that name the page's head, where they stand outside the article.
_HEADER_NAME = re.compile(r"(?:(?:site|page|main|global)[_-]?)?(?:header|topbar|top[_-]bar)", re.I)
_ARTICLE = frozenset(("article", "main"))
#: An open element of the key is closed by a start tag of the values.
_BLOCKISH = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
_CLOSED_BY = {
    "p": frozenset(_BLOCKISH),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
_CONTAINER = frozenset("html body div article main section td th center details".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
_SENTENCE = re.compile(r"[.!?…。]")


@dataclass(slots=True)
class Block:
    """Text with numbers for its path, the container it is pooled in and the innermost element named as furniture (0 if none)."""

    path: int
    zone: int
    named: int
    never: bool
    article: bool
    text: str
    linked: int


@dataclass
class Page:
    """Blocks in order; for each named path the one named around it, and whether its name may be overruled."""

    blocks: list[Block] = field(default_factory=list)
    around: dict[int, tuple[int, bool]] = field(default_factory=dict)


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    zone: int
    named: int
    never: bool
    article: bool


class _Reader:
    """Open elements, with what they hand down, and numbers for their paths."""

    def __init__(self) -> None:
        self.page = Page()
        self.root = _Open("", 0, 0, 0, False, False)
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.articles: list[int] = []
        self.paths: dict[tuple[int, str], int] = {}

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else self.root

    def open(self, tag: str, rest: str) -> None:
        while self.stack and tag in _CLOSED_BY.get(self.stack[-1].tag, ()):
            self._pop()
        parent = self.top()
        name, never, article, furniture, fixed = tag, parent.never or tag in _NEVER, parent.article or tag in _ARTICLE, False, False
        never |= tag == "header" and not article
        held: dict[str, str] = {}
        for key, value in _ATTRIBUTE.findall(rest) if len(rest) > 2 else ():
            # Of a repeated attribute the first holds.
            held.setdefault(key.lower(), value.strip("\"'").strip())
        never |= "hidden" in held or held.get("aria-hidden", "").lower() == "true"
        if "role" in held:
            never |= held["role"].lower() in _NEVER_ROLE
            article |= held["role"].lower() in ("main", "article") and not never
        for key in ("class", "id"):
            if key not in held:
                continue
            tokens = held[key].split()
            name += ("." if key == "class" else "#") + " ".join(tokens)
            # The id of a heading or of a part of the article is a place to link to, and tells its subject.
            if tag in ("html", "body", "article", "main") or (key == "id" and (parent.article or tag in _HEADING)):
                continue
            words = [t for t in tokens if _NAME.fullmatch(t) or (not parent.article and _HEADER_NAME.fullmatch(t))]
            furniture |= bool(words)
            fixed |= any(_COMMENT_NAME.search(t) for t in words)
        path = self.paths.setdefault((parent.path, name), len(self.paths) + 1)
        zone, named = parent.zone, parent.named
        if furniture:
            named = path
            self.page.around.setdefault(path, (parent.named, not fixed))
        if (furniture or not parent.article) if article else tag in _CONTAINER:
            zone = path
        self.places[tag].append(len(self.stack))
        if tag in _ARTICLE:
            self.articles.append(len(self.stack))
        self.stack.append(_Open(tag, path, zone, named, never, article))

    def _pop(self) -> None:
        gone = self.stack.pop()
        self.places[gone.tag].pop()
        if gone.tag in _ARTICLE:
            self.articles.pop()

    def close(self, tag: str) -> None:
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        # A stray end does not close the article.
        if tag in ("p", "div", "span", "li") and self.articles and self.articles[-1] > at:
            return
        while len(self.stack) > at:
            self._pop()

    def add(self, text: str, linked: int) -> None:
        top = self.top()
        self.page.blocks.append(Block(top.path, top.zone, top.named, top.never, top.article, text, min(linked, len(text))))


def read_page(page: str) -> Page:
    """The text blocks of a page, in order."""
    reader = _Reader()
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            reader.add(text, linked)
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    pattern, at, end = _TOKEN, 0, len(page)
    while at < end:
        found = pattern.search(page, at)
        if not found:
            say(page[at:])
            break
        if pattern is _TOKEN and found["open"] is not None:
            pattern = _LOOSE
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW and not found["end"]:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _INLINE:
            in_link = max(0, in_link + (-1 if found["end"] else 1)) if tag == "a" else in_link
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        in_link = 0
        if found["end"]:
            reader.close(tag)
        elif tag not in _VOID:
            reader.open(tag, found["rest"])
    flush()
    return reader.page


def fused(blocks: int, chars: int, marks: int, linked: int) -> float:
    """The ratios of a path in one figure: length and punctuation a block, and the share that is no link."""
    return math.log1p(chars / blocks) * (1 + math.log1p(marks / blocks)) * max(1 - linked / chars, 0.02)


def name_weights(page: Page) -> dict[int, float]:
    """The weight of each named path: 1 where its own text overrules its name and those around it."""
    article = any(b.article and not b.named and not b.never for b in page.blocks)
    held: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    everything = {True: 0, False: 0}
    for b in page.blocks:
        if not b.never:
            everything[b.article] += len(b.text) - b.linked
            own = held[b.named, b.article]
            own[0] += len(b.text) - b.linked
            own[1] += len(_SENTENCE.findall(b.text)) if b.named else 0
            own[2] += b.linked
    weight = {0: 1.0}
    for named, (outer, soft) in page.around.items():
        reads = False
        for inside in (True, False):
            text, stops, links = held.get((named, inside), (0, 0, 0))
            # Outside an article that has text of its own nothing is overruled.
            if soft and (inside or not article) and text >= max(LONG, MOST * everything[inside]):
                reads |= stops >= STOPS and links <= LINKED * (text + links)
        weight[named] = weight[outer] if reads else NAMED
    return weight


def _near(x: np.ndarray) -> np.ndarray:
    """Weighted sums over two neighbours on either side."""
    return np.convolve(x, [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in (-2, -1, 0, 1, 2)])[2 : 2 + len(x)]


def content_blocks(page: Page) -> list[bool]:
    """Which blocks are content, by the scores of their paths."""
    blocks = page.blocks
    by_name = name_weights(page)
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    running = {True: 0, False: 0}
    for b in blocks:
        if not b.never:
            own = sums[b.path]
            own[0] += 1
            own[1] += len(b.text)
            own[2] += len(_PUNCTUATION.findall(b.text))
            own[3] += b.linked
            if by_name[b.named] == 1:
                running[b.article] += len(b.text) - b.linked
    of_path = {path: fused(*own) for path, own in sums.items()}
    marked = running[True] > 0 and running[True] >= ARTICLE_SHARE * (running[True] + running[False])
    score = np.array([0.0 if b.never else of_path[b.path] for b in blocks])
    smooth = _near(score) / _near(np.ones(len(blocks))) if blocks else score
    total, length = defaultdict(float), defaultdict(int)
    for b, own in zip(blocks, smooth.tolist(), strict=True):
        if not b.never:
            weight = by_name[b.named] * (OUTSIDE if marked and not b.article else 1.0)
            total[b.zone] += own * weight * len(b.text)
            length[b.zone] += len(b.text)
    pooled = {zone: total[zone] / length[zone] for zone in total}
    least = SHARE * max([LEAST, *pooled.values()])
    return [not b.never and pooled[b.zone] >= least for b in blocks]


def main_text(page: str | None) -> str:
    found = read_page(page) if page else Page()
    return "\n".join(b.text for b, keep in zip(found.blocks, content_blocks(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``pages (page_id, url, html)`` to ``(page_id, url, text)``."""
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
