"""Main text of web pages from streaming parser events.

The standard library's parser is fed the whole page and sends its events to a collector, which cuts the page into
lines: runs of text between block-level tags. Each line has a text-to-tag ratio: the characters it holds outside of
links over the tags met in it (at least one). What the markup says is a factor of the ratio: 0 in menus, footers,
sidebars and page headers, 0.1 in forms and in what bears a telling class, id or role (adverts, notices, comments),
0.02 outside of article and main where a page has one with text. The ratios are smoothed with a Gaussian kernel along
the page. Lines whose smoothed ratio exceeds a share of the standard deviation form clusters, which alone select the
content regions: each cluster claims the containers of its lines from the first to the last that passes by its own
ratio, and an article or main around them as a whole. A page's body holds the rest of the page too, so of its own lines
only the stretch is taken that reaches from its first cluster to its last, clusters being as wide as the smoothed
ratio stays over a tenth of the threshold or over half its median, whichever is less. The lines of claimed regions are the text, in page order: the threshold
picks regions and not lines inside of them. Menus, sidebars and doubtful parts inside of a region are regions of their
own, which stay out unless a cluster claims them; so do link lists: groups of short links that hold most of their
group's characters. If no line passes, the region of the line with the top smoothed ratio is taken (of equal ones the
first), so that a very short article is found too. Time and memory grow with a page's length alone.

Defined cases: null and empty pages have the empty text; repeated rows are extracted each on its own; extra
columns are ignored; an empty table gives an empty result. White space inside a line becomes one space.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import common

# Names of HTML elements and of class or id words.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head svg math iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button select textarea".split())
CONTAINERS = frozenset("article main section div td body".split())
#: Factors of the ratio: a doubtful element, outside of a page's articles.
DOUBTFUL, OUTSIDE = 0.1, 0.02
LISTS = frozenset("ul ol dl table".split())
WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES = {name: frozenset({name}) for name in ("li", "option", "tr")} | {"dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
P_CLOSERS = BLOCKS - {"body", "html", "head", "title", "option", "select", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}


class Line(NamedTuple):
    text: str
    tags: int
    #: Characters inside of links, and how many links.
    linked: int
    links: int
    excluded: bool
    #: The container, the nearest list or container, and the nearest doubtful element (0: none).
    container: int
    group: int
    doubt: int


class Open(NamedTuple):
    """An open element and what holds inside of it."""

    name: str
    silent: bool
    excluded: bool
    container: int
    group: int
    doubt: int


class Lines(HTMLParser):
    """Collects the lines of the page. Containers, lists and doubtful elements are numbered in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: dict[int, str] = {0: "body"}
        self.parents: dict[int, int] = {}
        #: Menus, footers, sidebars and headers: containers that are no part of the one around them.
        self.apart: set[int] = set()
        #: The article or main around each container, itself included (0: none).
        self.articles: dict[int, int] = {0: 0}
        self.parts: list[str] = []
        self.tags, self.linked, self.links, self.serial = 0, 0, 0, 0
        self.stack = [Open("", False, False, 0, 0, 0)]
        self.opened: Counter[str] = Counter()

    def cut(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                top = self.stack[-1]
                self.lines.append(Line(text, self.tags, self.linked, self.links, top.excluded, top.container, top.group, top.doubt))
            self.parts = []
        self.tags, self.linked, self.links = 0, 0, 0

    def close_last(self) -> None:
        self.opened[self.stack.pop().name] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.cut()
            names = CLOSES.get(tag)
            if names and self.stack[-1].name in names or tag in P_CLOSERS and self.stack[-1].name == "p":
                self.close_last()
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        self.tags += 1
        if tag in VOID:
            return
        _, silent, excluded, container, group, doubt = self.stack[-1]
        self.serial += 1
        if tag in BOILERPLATE or tag == "header" and not self.articles[container]:
            if not excluded:
                excluded = True
                self.apart.add(self.serial)
        elif tag == "form" or attrs and tag not in ("html", "body") and self.marked(attrs):
            doubt = self.serial
        if tag in CONTAINERS or self.serial in self.apart:
            self.parents[self.serial], self.kinds[self.serial] = container, tag
            around = 0 if self.serial in self.apart else self.articles[container]
            self.articles[self.serial] = self.serial if tag in ("article", "main") and not around else around
            container = group = self.serial
        elif tag in LISTS:
            group = self.serial
        self.stack.append(Open(tag, silent or tag in SILENT, excluded, container, group, doubt))
        self.opened[tag] += 1

    def marked(self, attrs: list) -> bool:
        for name, value in attrs:
            if name in ("class", "id"):
                if value and not WORDS.isdisjoint(re.split(r"[^a-z]+", value.lower())):
                    return True
            elif name == "role":
                if (value or "").lower() in ROLES:
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if self.opened[tag]:
            while self.stack[-1].name != tag:
                self.close_last()
            self.close_last()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].silent:
            self.parts.append(data)
            if self.opened["a"]:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the ends lean on what lines there are."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def link_lists(lines: list[Line], short: int = 30, share: float = 0.6, least: int = 3) -> np.ndarray:
    """Which lines are menus: on their own, or with their group, at least `least` links of mostly under `short` characters that hold over `share` of the text."""

    def menu(links: int, linked: int, size: int) -> bool:
        return links >= least and linked > share * size and linked < short * links

    sums: dict[int, list[int]] = {}
    for x in lines:
        found = sums.setdefault(x.group, [0, 0, 0])
        found[0], found[1], found[2] = found[0] + x.links, found[1] + x.linked, found[2] + len(x.text)
    return np.array([menu(x.links, x.linked, len(x.text)) or x.links > 0 and menu(*sums[x.group]) for x in lines], bool)


def weighted(lines: list[Line], parser: Lines) -> np.ndarray:
    """Text-to-tag ratios times what the markup says; lengths instead where a page has nothing but links."""
    proper = any(parser.articles[x.container] for x in lines if not x.excluded)
    factors = np.array([0.0 if x.excluded else (DOUBTFUL if x.doubt else 1.0) * (OUTSIDE if proper and not parser.articles[x.container] else 1.0) for x in lines])
    ratios = factors * np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    return ratios if ratios.any() else factors * np.array([len(x.text) for x in lines])


def regions(lines: list[Line], parser: Lines, sigma: float, share: float) -> tuple[set[int], set[int], dict[int, tuple[int, int]]]:
    """Containers that the clusters claim, the doubtful elements (0: none) of their lines, and the stretch of lines that is taken of a body."""
    ratios = weighted(lines, parser)
    if not ratios.any():
        return set(), set(), {}
    smooth = smoothed(ratios, sigma)
    standing = smooth * (ratios > 0)
    bar = min(share * float(ratios.std()), float(standing.max()))
    # A cluster reaches from its first to its last line that passes by itself; smoothing alone carries over its edge.
    strong = np.flatnonzero((standing >= bar) & (ratios >= bar))
    cluster = np.cumsum(np.concatenate(([0], (standing < bar)[:-1] | (standing < bar)[1:])))
    chosen = strong.tolist() or [int(standing.argmax())]
    for first, last in zip(chosen[:-1], chosen[1:], strict=True):
        if cluster[first] == cluster[last]:
            chosen += [k for k in range(first + 1, last) if not lines[k].doubt]
    claimed: set[int] = set()
    stretches: dict[int, tuple[int, int]] = {}
    low = smooth < min(bar / 10, float(np.median(smooth[ratios > 0])) / 2)
    # For each line the first and the last line of the run over that limit that it lies in.
    place = np.arange(len(lines))
    left = np.maximum.accumulate(np.where(low, place, -1)) + 1
    right = np.minimum.accumulate(np.where(low, place, len(lines))[::-1])[::-1] - 1
    for k in chosen:
        container = lines[k].container
        claimed.add(parser.articles[container] or container)
        if parser.kinds[container] == "body":
            a, b = stretches.get(container, (k, k))
            stretches[container] = min(a, k, int(left[k])), max(b, k, int(right[k]))
    return claimed, {lines[k].doubt for k in chosen}, stretches


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The article's text, its blocks joined by \n."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    claimed, doubts, stretches = regions(lines, parser, sigma, share)
    inside = {0: 0 in claimed}
    for c, parent in parser.parents.items():  # a parent comes before its children
        # A page's body stands for its own lines only, and what is apart for itself.
        inside[c] = c in claimed or inside[parent] and parser.kinds[parent] != "body" and c not in parser.apart

    def taken(k: int, x: Line) -> bool:
        a, b = stretches.get(x.container, (0, len(lines)))
        return inside[x.container] and a <= k <= b and (not x.doubt or x.doubt in doubts)

    menus = link_lists(lines)
    return "\n".join(x.text for k, x in enumerate(lines) if not menus[k] and taken(k, x))


def extract(pages: DataFrame, sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(html, sigma, share) for html in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = dict(pages.dtypes)["page_id"]
    return common.arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")


def op6_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
