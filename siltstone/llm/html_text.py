"""Main text of web pages: text-to-tag ratios over standard-library parser events.

``html.parser`` events are read once, in order. A block element starts a new line
(an HTML source often has no line breaks of its own), and each line gets its ratio
of text to tags; text in links counts for little. The ratios are smoothed with a
Gaussian kernel and clustered by a threshold at a share of their standard
deviation (after Weninger et al., "CETR", 2010): lines over it are dense.

A container whose own lines are mostly dense is content: its lines are returned
whole, short ones too, with the containers inside it and the headings just before
it. An article that holds content is content as a whole. Containers with hardly any
text to their tags, as menus and lists of links, are never content, wherever they
stand. No container has to hold a share of the page.

What is dense and yet no content, as adverts, notices, forms, footers and readers'
comments, no ratio can tell. Elements and class names settle that (``SKIP``,
``OUTSIDE``, ``FURNITURE``): where dense lines are such furniture, they are taken out
and the ratios of the other lines are smoothed and clustered again. Menus are not
among these names. A page without dense lines has no text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each, table

#: Standard deviation of the smoothing, in lines, and the share of the ratios' deviation that a content line exceeds.
SIGMA = 1.0
SHARE = 0.5
#: Share of a container's own text that is dense if it is content, and what its text to tags then reaches: in lists of links it stays below.
OWN = 0.5
BARE = 1.0
#: Times that dense furniture is taken out before all of it is.
ROUNDS = 10
#: What a character in a link counts.
LINK = 0.1

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img")
BREAK = _words("br wbr")
#: Elements whose text no reader sees, and those that are furniture.
DROPPED = _words("head title script style noscript template option textarea iframe object svg canvas audio video")
SKIP = _words("footer aside form button select dialog")
#: Elements, and parts of class names, that are content's own inside an article, and page furniture outside.
OUTSIDE = _words("header")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: Elements that hold an article.
ARTICLE = _words("article main")
CONTAINER = _words("body div section td article main nav menu header footer aside form")
#: Parts of class names, ids and roles that say a part is not content, though it may be dense.
FURNITURE = _words(
    "ad ads adv advert adverts advertisement advertising banner comment comments consent cookie cookies disqus footer gdpr legal login masthead modal "
    "newsletter notice notices popup promo promoted promotion recommended related replies reply search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tags widget widgets complementary contentinfo alert"
)
#: A start tag of the first kind ends an open element of the second.
_IMPLIED = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
_CLOSES_P = _words("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul")


@dataclass
class Line:
    region: int  # the innermost container
    furniture: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    chars: float = 0  # those in links count LINK each
    tags: int = 0


class Lines(HTMLParser):
    """Collects the lines of a page, and its containers: ``kinds`` and ``parents`` by number, 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, whether text is dropped, whether furniture, container, whether in an article, whether a link.
        self.open: list[tuple[str, bool, bool, int, bool, bool]] = [("", False, False, 0, False, False)]
        self.lines: list[Line] = []
        self.kinds, self.parents = [""], [0]
        self.tags = 0
        self.line: Line | None = None

    def _end_line(self) -> None:
        self.line = None

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A mark of an unknown kind, as ``<![x]>``, is a comment up to the next ``>``, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BREAK:
            if self.line is not None and tag == "br":
                self.line.parts.append(" ")
            return
        if tag in _CLOSES_P:
            self._close("p", CONTAINER)
        for old in _IMPLIED.get(tag, ()):
            self._close(old, _words("ul ol dl table menu select"))
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        _, dropped, out, region, article, link = self.open[-1]
        dropped = dropped or tag in DROPPED
        if not out:
            names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            parts = _words(names.lower().replace("-", " ").replace("_", " "))
            own = tag in ARTICLE or tag == "body" or tag == "html"
            out = tag in SKIP or ((tag in OUTSIDE or bool(parts & OUTSIDE)) and not article and not own) or (bool(parts & FURNITURE) and not (own and "comment" not in parts))
        dropped = dropped or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
        if tag in CONTAINER:
            self.kinds.append(tag)
            self.parents.append(region)
            region = len(self.kinds) - 1
        self.open.append((tag, dropped, out, region, article or tag in ARTICLE, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                del self.open[k:]
                self._end_line()
                return
            if name in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if any(name not in INLINE for name, *_ in self.open[k:]):
                    self._end_line()
                del self.open[k:]
                return
            if self.open[k][0] in CONTAINER and tag in INLINE:
                return

    def handle_data(self, data: str) -> None:
        _, dropped, out, region, _, link = self.open[-1]
        if dropped:
            return
        if self.line is not None and (self.line.furniture != out or self.line.region != region):
            self._end_line()
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(region, out, any(name in HEADINGS for name, *_ in self.open))
            self.lines.append(self.line)
        self.line.parts.append(data)
        self.line.chars += len(data) * (LINK if link else 1)
        self.line.tags += self.tags
        self.tags = 0


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over lines; beyond the ends a line counts as its mirror image."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total, n = sum(kernel), len(values)
    at = lambda i: values[min(max(-i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i, 0), n - 1)]
    return [sum(w * at(i + k) for k, w in zip(range(-reach, reach + 1), kernel, strict=True)) / total for i in range(n)]


def ratio(line: Line) -> float:
    """Text to tags of a line."""
    return line.chars / max(1, line.tags)


def clustered(lines: list[Line]) -> list[bool]:
    """Which lines are dense, by ratios alone, but for dense lines that are furniture."""
    out = [False] * len(lines)
    left, rounds = list(range(len(lines))), 0
    while left:
        density = smoothed([ratio(lines[k]) for k in left])
        mean = sum(density) / len(density)
        limit = SHARE * math.sqrt(sum((d - mean) ** 2 for d in density) / len(density))
        dense = [k for k, d in zip(left, density, strict=True) if d >= limit and d > 0]
        gone = {k for k in dense if lines[k].furniture}
        rounds += 1
        if gone and rounds == ROUNDS:
            gone = {k for k in left if lines[k].furniture}
        if not gone:
            for k in dense:
                out[k] = True
            return out
        left = [k for k in left if k not in gone]
    return out


def content(page: Lines, dense: list[bool]) -> list[bool]:
    """Which lines are of containers that are content."""
    n = len(page.kinds)
    chars, tags, mass = [0.0] * n, [0] * n, [0.0] * n
    for line, d in zip(page.lines, dense, strict=True):
        if not line.furniture:
            weight = ratio(line) * max(1, line.tags)
            chars[line.region] += weight
            tags[line.region] += max(1, line.tags)
            mass[line.region] += weight * d
    bare = [c < BARE * t for c, t in zip(chars, tags, strict=True)]
    own = [m > 0 and m >= OWN * c and not b for m, c, b in zip(mass, chars, bare, strict=True)]
    if not any(own):  # a page of a few letters
        bare = [False] * n
        own = [m > 0 and m >= OWN * c for m, c in zip(mass, chars, strict=True)]
    # An article is content if a container in it is.
    article = [0] * n
    for k in range(1, n):  # a container comes after the one around it
        article[k] = k if page.kinds[k] in ARTICLE else article[page.parents[k]]
    whole = {article[k] for k in range(n) if own[k]} - {0}
    found = [False] * n
    for k in range(n):
        found[k] = own[k] or k in whole or (k > 0 and found[page.parents[k]] and (not bare[k] or not chars[k]))
    return [found[line.region] for line in page.lines]


def parsed(html: str) -> Lines:
    page = Lines()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # no mark is known that the parser still gives up on; if there is one, marks are text
        page = Lines()
        page.feed(re.sub(r"<!(?!--)", "&lt;!", html))
        page.close()
    return page


def blocks_of(html: str | None) -> list[str]:
    """The blocks of a page's main text, in order, white space made single spaces."""
    page = parsed(html or "")
    lines = page.lines
    if not lines:
        return []
    kept = [here and not line.furniture for line, here in zip(lines, content(page, clustered(lines)), strict=True)]
    for k in range(len(lines) - 1, 0, -1):  # headings just before content belong to it
        if kept[k] and lines[k - 1].heading and not lines[k - 1].furniture:
            kept[k - 1] = True
    found = (" ".join("".join(line.parts).split()) for line, here in zip(lines, kept, strict=True) if here)
    return [text for text in found if text]


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``: the main text, blocks joined by blank lines.

    Whole pages are read, however long; a null page is an empty one, whose text is
    empty. Every row and column stays, repeated rows too; a column named like
    ``text_col`` is replaced. An empty table gives an empty one. No shuffle.
    """

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts:
            yield pa.array(["\n\n".join(blocks_of(h)) for h in each(batch)], pa.string())

    return pages.withColumn(text_col, text(F.col(html_col)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.withColumn("n_chars", F.length("text").cast("long"))
