"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without text of the page.
_UNSEEN = frozenset(
    "script style noscript template iframe object select button textarea svg canvas head title audio video datalist".split()
)
#: Elements that hold what surrounds an article.
_AROUND = frozenset("nav footer aside form menu dialog".split())
#: Elements in which blocks are grouped.
_GROUPS = frozenset("address article aside body center dialog div footer form header main menu nav section table td th tr".split())
#: Blocks of running text.
_CLOSED = frozenset("p h1 h2 h3 h4 h5 h6".split())  # by the next block, if not by an end tag
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt figcaption caption summary".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class and id that tell what an element is for; the doubtful ones only weigh.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|toolbar|pagination|pager|"
    r"comments?|commentlist|replies|respond|disqus|newsletter|subscribe|signup|login|hidden)(?:$|[\s_-])",
    re.I,
)
_DOUBTED = re.compile(
    r"(?:^|[\s_-])(?:notice|alert|side|widget|header|related|recommended|share|sharing|social|search|skip|print)(?:$|[\s_-])", re.I
)
_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|advert\w*|sponsor\w*)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
SIGMA = 1.5
#: A line is content when its smoothed ratio reaches this part of the mean ratio.
LEVEL = 0.5
#: How much a line counts in an element with a doubtful name.
DOUBT = 0.25
#: Part of the best cluster's text that another needs to belong to the content, and
#: of the content's text that one element must hold to bound it.
COMPARABLE, HOLDS = 0.25, 0.8


class _Lines(HTMLParser):
    """Turns parser events into lines: one per block of text, with its tags and where it lies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.blocks: list[str] = []
        self.weights: list[float] = []
        #: The innermost group around each line, 0 for none; each group's name, and the group around it.
        self.homes: list[int] = []
        self.groups: list[tuple[str, str]] = [("", "")]
        self.around: list[int] = [0]
        self._text: list[str] = []
        self._count = 0
        #: Open groups and other named blocks: tag, innermost group, weight; and how many of each tag.
        self._open: list[tuple[str, int, float]] = [("", 0, 1.0)]
        self._opened: Counter[str] = Counter()
        self._block = ""
        self._unseen = ""
        self._depth = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.texts.append(text)
            self.tags.append(self._count)
            self.blocks.append(self._block)
            self.weights.append(self._open[-1][2])
            self.homes.append(self._open[-1][1])
            self._count = 0
        self._text.clear()

    def _weight(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in _AROUND or tag == "header" and not (self._opened["article"] or self._opened["main"]):
            return 0.0
        if tag in ("html", "body", "main"):
            return 1.0
        given = dict(attrs)
        names = f"{given.get('class') or ''} {given.get('id') or ''}"
        if given.get("role") in _ROLES or "hidden" in given or given.get("aria-hidden") == "true":
            return 0.0
        if (_REMARKS if tag == "article" else _NAMED).search(names):
            return 0.0
        return DOUBT if tag != "article" and _DOUBTED.search(names) else 1.0

    def _pop(self, *tags: str) -> None:
        """Closes what is open innermost as long as it is one of ``tags``."""
        while self._open[-1][0] in tags:
            self._opened[self._open.pop()[0]] -= 1

    def _end(self, tag: str) -> None:
        while self._opened[tag]:
            last = self._open.pop()[0]
            self._opened[last] -= 1
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._count += 1
        if tag in _BLOCKS:
            self._flush()
            self._block = tag
        if self._unseen:
            self._depth += tag == self._unseen
            return
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            return
        if tag in _UNSEEN:
            self._unseen, self._depth = tag, 1
            return
        if tag in ("article", "main"):  # neither starts in a menu whose end was forgotten
            self._pop("nav", "menu", "ul", "ol", "li", "p", "form", "header")
        elif tag in _BLOCKS and self._open[-1][0] in _CLOSED:
            self._pop(self._open[-1][0])
        if tag == "li":
            self._pop("li", "p")
        weight = self._weight(tag, attrs)
        if tag in _GROUPS:
            self.groups.append((tag, dict(attrs).get("class") or ""))
            self.around.append(self._open[-1][1])
        elif tag not in _BLOCKS and weight == 1:
            return
        home = len(self.groups) - 1 if tag in _GROUPS else self._open[-1][1]
        self._open.append((tag, home, min(weight, self._open[-1][2])))
        self._opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/>" means nothing in HTML, but on void elements

    def handle_endtag(self, tag: str) -> None:
        self._count += 1
        if tag in _BLOCKS:
            self._flush()
        if self._unseen:
            if tag == self._unseen:
                self._depth -= 1
                if not self._depth:
                    self._unseen = ""
                return
            if tag not in ("body", "html") or self._unseen in ("script", "style", "textarea", "title"):
                return
            self._unseen = ""
        self._end(tag)
        if tag in _BLOCKS:
            self._block = self._open[-1][0]

    def handle_data(self, data: str) -> None:
        if not self._unseen:
            self._text.append(data)


def _smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the weights that would lie beyond the ends are left out."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def _clusters(sizes: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which lines lie in the cluster of adjacent high lines with most text, or in one comparable to it."""
    starts = np.flatnonzero(high & ~np.concatenate([[False], high[:-1]]))
    stops = np.flatnonzero(high & ~np.concatenate([high[1:], [False]])) + 1
    total = np.array([sizes[a:b].sum() for a, b in zip(starts, stops)])
    inside = np.zeros(len(sizes), bool)
    for a, b, w in zip(starts, stops, total):
        inside[a:b] = w >= COMPARABLE * total.max()
    return inside


def main_text(html: str | None) -> str:
    """The article's blocks, white space collapsed, joined by newlines; empty if none.

    Each line has the ratio of its text to the tags before it, less in elements
    that are named for something else, none in menus and the like.  Lines whose
    smoothed ratio reaches the threshold form clusters; the one with most text and
    those comparable to it are the content.  The innermost element that holds it
    bounds it: an article or main element is kept whole, but for what is named
    otherwise; in another, its own running text however short, the elements with
    content and those marked like them, and what lies between.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    texts, homes, around = parser.texts, parser.homes, parser.around
    weights = np.array(parser.weights, np.float64)
    sizes = weights * np.array([len(t) for t in texts], np.float64)
    if not sizes.sum():
        return ""
    ratios = sizes / np.maximum(parser.tags, 1)
    level = LEVEL * ratios[weights > 0].mean()
    high = (_smooth(ratios) >= level) & (weights > 0)
    if not high.any():
        high = weights > 0
    content = _clusters(sizes, high)

    # Groups are numbered as they open, so those around one have lower numbers.
    held = np.bincount(np.array(homes)[content], weights=sizes[content], minlength=len(around))
    for n in range(len(around) - 1, 0, -1):
        held[around[n]] += held[n]
    home = int(np.flatnonzero(held >= HOLDS * sizes[content].sum())[-1])
    # The group below home that each group lies in, itself for those there; None outside of home.
    below: list[int | None] = [None] * len(around)
    below[home] = 0
    for n in range(home + 1, len(around)):
        over = below[around[n]]
        below[n] = over if over is None or around[n] != home else n
    children = [below[n] for n in homes]
    strong = content & (ratios >= level)
    full = {children[i] for i in np.flatnonzero(strong)}
    alike = {parser.groups[c] for c in full if c}
    whole = parser.groups[home][0] in ("article", "main")
    keep = np.zeros(len(texts), bool)
    allowed = np.array([c is not None for c in children]) & ((weights == 1) | (weights > 0) & (ratios >= level))
    for i in np.flatnonzero(allowed):
        c = children[i]
        prose = parser.blocks[i] in _PROSE
        own = content[i] or prose if c == 0 else c in full or prose and parser.groups[c] in alike
        keep[i] = whole or own
    # What lies between is part of it: a table, a caption, a short block.
    at = np.flatnonzero(keep)
    if len(at):
        keep[at[0] : at[-1] + 1] = allowed[at[0] : at[-1] + 1]
    return "\n".join(t for t, k in zip(texts, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null or empty html, and pages without content, give an empty text; null ids
    and urls pass through; repeated rows are all returned; malformed markup is
    read as far as the parser makes sense of it; an empty table gives no rows;
    other columns are not read.  Each page is parsed alone, nothing is shuffled.
    """
    return pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
