"""Main text of web pages by text-to-tag ratio: parser events make lines, smoothing and a threshold pick content.

The standard library's streaming parser gives events; every block element starts a new line.  A line's ratio is its text's
length, without what stands in links, over its tags.  Ratios are smoothed by a Gaussian kernel; the lines above a threshold
are seeds, and the seeds of one container element (the page's article or main element, else the innermost division) make
a content region, which takes in the container's short lines too.  Elements that are never content by their name or class (menus, headers outside an article, footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers) give no lines.

Defined results: a null or empty html gives an empty text; broken markup is read as the parser reads it; repeated rows give
repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, table

#: Elements without content, elements that start a line, elements that have no end tag.
HARD = frozenset("script style noscript template svg iframe button select option textarea input label menu head title object embed canvas audio video".split())
SOFT = frozenset("nav footer aside form dialog".split())
SKIP = HARD | SOFT
BLOCK = frozenset("address article blockquote caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html body li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
CONTAINER = CONTENT | frozenset(("body", "div", "section", "td"))
#: Words of a class, id or role that mark an element as none of the article.
BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice\w*|popup|modal|newsletter|subscri\w*|share|social|related|comments?|disqus|replies|widget\w*|pagination|pager|toolbar|login|signup|search)(?:$|[\s_-])", re.I)
#: Those that stay so however much text they hold.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|comments?|disqus|replies)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header)(?:$|[\s_-])", re.I)


class Box:
    """A skipped element: whether it may turn out to be content, the boxes around it, what it holds beside inner boxes."""

    __slots__ = ("soft", "outer", "text", "paragraphs", "content")

    def __init__(self, soft: bool, outer: Box | None) -> None:
        self.soft, self.outer, self.text, self.paragraphs, self.content = soft, outer, 0, 0, False


class Lines(HTMLParser):
    """Collects lines: [text parts, tags, characters inside links, container (below 0: an article or main element)].

    released: numbers of skipped elements, in the page's order, that are not to be skipped.
    """

    def __init__(self, released: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.released = released
        self.lines: list[list] = [[[], 0, 0, 0]]
        self.open: list[tuple[str, bool, bool]] = []  # name, skipped, content
        self.names: Counter = Counter()  # of open elements
        self.inside = [0]  # containers around, innermost last
        self.boxes: list[Box] = []
        self.around: list[Box] = []  # open boxes
        self.skipped = self.content = self.links = self.elements = self.outside = self.articles = 0

    def _new(self) -> None:
        line = self.lines[-1]
        if any(map(str.strip, line[0])):
            self.lines.append([[], 0, 0, self.inside[-1]])
        else:
            line[3] = self.inside[-1]

    def _boiler(self, tag: str, attrs: list) -> str:
        """"": a part of the page like others; "hard", "soft": skipped; a soft one may be released."""
        if tag in HARD:
            return "hard"
        found = "soft" if tag in SOFT or tag == "header" and not self.content else ""
        for name, value in attrs:
            if value and name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
                if NEVER.search(value):
                    return "hard"
                if BOILER.search(value) or not self.content and HEADER.search(value):
                    found = "soft"
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "hard"
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            boiler, content = self._boiler(tag, attrs), tag in CONTENT
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
                self._close()
            skipped = bool(boiler)
            if skipped:
                box = Box(boiler == "soft", self.around[-1] if self.around else None)
                self.boxes.append(box)
                skipped = len(self.boxes) - 1 not in self.released
            if skipped:
                self.around.append(box)
            elif self.around:
                self.around[-1].paragraphs += tag == "p"
                self.around[-1].content |= content
            else:
                self.articles += content
            self.open.append((tag, skipped, content))
            self.names[tag] += 1
            self.skipped += skipped
            self.content += content
            self.links += tag == "a"
            self.elements += 1
            if tag in CONTAINER:
                self.inside.append(self.inside[-1] if self.inside[-1] < 0 else -self.elements if content else self.elements)
        elif tag == "br":
            self.handle_data(" ")
        if tag in BLOCK:
            self._new()
        self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in BLOCK:
            self._new()
        self.lines[-1][1] += 1

    def _close(self) -> None:
        tag, skipped, content = self.open.pop()
        self.names[tag] -= 1
        if skipped:
            self.around.pop()
        self.skipped -= skipped
        self.content -= content
        self.links -= tag == "a"
        if tag in CONTAINER:
            self.inside.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self.open[-1][0] != tag:
                self._close()
            self._close()
        if tag in BLOCK:
            self._new()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            line = self.lines[-1]
            line[0].append(data)
            self.outside += len(data.strip())
            if self.links:
                line[2] += len(data)
        else:
            self.around[-1].text += len(data.strip())


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """values convolved with a Gaussian of radius 3 sigma, normalised at the ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    wide = np.convolve(values, kernel)[radius : radius + len(values)]
    return wide / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def wrongly_skipped(parser: Lines) -> frozenset[int]:
    """Skipped elements that are the page's content all the same, with those around them, if no article stands outside.

    These are elements that hold the article or main element, and else one that holds most of the page's text in several
    paragraphs: a form around the whole page, an element that its author never closed, a container with an odd class.
    """
    if parser.articles:
        return frozenset()
    soft = [b for b in parser.boxes if b.soft]
    chosen = [b for b in soft if b.content]
    if not chosen:
        most = 0.5 * (parser.outside + sum(b.text for b in soft))
        chosen = [b for b in soft if b.paragraphs > 1 and b.text > most]
    wanted = set()
    for box in chosen:
        chain = [box]
        while chain[-1].outer:
            chain.append(chain[-1].outer)
        if all(b.soft for b in chain):
            wanted.update(map(id, chain))
    return frozenset(i for i, b in enumerate(parser.boxes) if id(b) in wanted)


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by line ends."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if parser.boxes and (released := wrongly_skipped(parser)):
        parser = Lines(released)
        parser.feed(html)
        parser.close()
    lines = []
    for parts, tags, linked, inside in parser.lines:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, len(text) - min(linked, len(text)), max(1, tags), inside))
    if not lines:
        return ""
    ratio = np.array([own / tags for _, own, tags, _ in lines])
    smoothed = smooth(ratio)
    seeds = smoothed >= min(0.5 * smoothed.std(), smoothed.max())  # the cluster of lines with much text for their tags
    regions = {line[3] for line, seed in zip(lines, seeds.tolist(), strict=True) if seed}
    if any(r < 0 for r in regions):  # an article that holds seeds is the page's content; text around it isn't
        regions = {r for r in regions if r < 0}
    return "\n".join(line[0] for line in lines if line[3] in regions)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: one narrow pass."""

    def run(batches):
        for part in in_slices(batches, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows_of(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
