"""Main text of web pages.

The standard library's parser streams a page once. Each block element makes a
line; a line has its text, the tags met while it lasted, its chain of open
containers and whether one of those is furniture (navigation, footers, adverts,
forms, comments and the like, by element or by class, id and role). The
text-to-tag ratio of the lines, with furniture at zero, is smoothed by a
Gaussian kernel and split into two clusters at a threshold; the lines of the
upper cluster mark the content. The content region holds nearly all the marked
text: the articles or main elements where they do, else the innermost container
that does. Every line of the region that is not furniture is kept, short ones
too, so nothing of an article is lost to the threshold. A name that only contains
a word of furniture (``has-sidebar``), or that wraps an article or all there is,
does not make furniture of a container with most of the marked text.

One pass, no shuffle; each page is handled in its row.

Defined results for odd input: a null page is empty; a page without text has
the empty text; pages of any length are read whole; broken nesting is closed as
browsers do; repeated rows are extracted each; an empty table gives an empty
result; other columns pass through except those named like new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gistra.llm.common import table

#: Elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6".split())
#: Elements whose names say nothing about furniture: they hold the whole page.
PAGE = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "script style noscript template head nav header footer aside form button select textarea input label fieldset dialog menu iframe "
    "object embed svg canvas audio video map search".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads adv alert alerts advert adverts advertisement advertisements advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promos promotion recommended recommendations related reply replies respond search share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
NAME = re.compile(r"[a-z]+")
SIGMA = 1.5
#: Share of the marked text that a region must hold.
SHARE = 0.9


class Lines(HTMLParser):
    """Collects (text, tags, path of containers, furniture) lines from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # name, container number, furniture, number among those named as furniture
        self.out: list[tuple[str, int, tuple[int, ...], bool, tuple[int, ...]]] = []
        self.wraps: list[bool] = []  # of those named as furniture: may be a wrapper of content
        self.kinds: list[str] = []
        self.text: list[str] = []
        self.tags = 0

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(n for _, n, _, _ in self.open if n >= 0)
            self.out.append((text, self.tags, path, any(f for _, _, f, _ in self.open), tuple(m for _, _, _, m in self.open if m >= 0)))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        sure = tag in FURNITURE or (tag not in PAGE and self._hidden(attrs))
        named = self._named(attrs) if tag not in PAGE and not sure else 0
        hidden = sure or named > 0
        if block or (hidden and tag not in VOID):
            self.line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            return
        if block:
            self._implied(tag)
        if block or hidden:
            number = -1
            if tag in CONTAINERS:
                number = len(self.kinds)
                self.kinds.append(tag)
            if tag in ("article", "main"):
                for _, _, _, m in self.open:
                    if m >= 0:
                        self.wraps[m] = True
            if named:
                self.wraps.append(named == 1 or tag == "article")
            self.open.append((tag, number, sure, len(self.wraps) - 1 if named else -1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash closes nothing

    @staticmethod
    def _named(attrs: list[tuple[str, str | None]]) -> int:
        """2 where a class or id is made of furniture words only, 1 where one only contains such a word, else 0."""
        found = 0
        for k, v in attrs:
            if k in ("class", "id") and v:
                for name in v.lower().split():
                    words = NAME.findall(name)
                    if not FURNITURE_NAMES.isdisjoint(words):
                        found = max(found, 2 if FURNITURE_NAMES.issuperset(words) else 1)
        return found

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for k, v in attrs:
            if k == "role":
                if v and v.lower() in FURNITURE_ROLES:
                    return True
            elif k == "hidden" or (k == "aria-hidden" and v == "true"):
                return True
            elif k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
        return False

    def _implied(self, tag: str) -> None:
        """Closes what the start of a block closes: a paragraph, and siblings of list and table parts."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}.get(tag, ())
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p" or name in same:
                del self.open[k:]
                if name == "p" and not same:
                    return
            elif name in BLOCKS and (not same or name in stop):
                return

    def handle_endtag(self, tag: str) -> None:
        known = tag in BLOCKS or any(tag == name for name, _, _, _ in self.open)
        if known:
            self.line()
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break
        self.tags += 1

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """The border between two clusters on a line, by alternating means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def marks(lines: list[tuple], sizes: np.ndarray, kept: list[int]) -> list[int]:
    """The lines of the upper cluster of smoothed text-to-tag ratios; all but ``kept`` have ratio zero."""
    ratio = np.zeros(len(lines))
    for k in kept:
        ratio[k] = sizes[k] / max(1, lines[k][1])
    even = smooth(ratio)
    border = threshold(even)
    return [k for k in kept if even[k] >= border] or kept


def wrappers(parser: Lines, sizes: np.ndarray) -> set[int]:
    """Those named as furniture that hold most of the marked text and may wrap content, or hold all there is."""
    if not parser.wraps:
        return set()
    lines = parser.out
    kept = [k for k, x in enumerate(lines) if not x[3]]
    if not kept:
        return set()
    marked = marks(lines, sizes, kept)
    total, held, most = sum(sizes[k] for k in marked), {}, {}
    for k in kept:
        for m in set(lines[k][4]):
            most[m] = most.get(m, 0) + 1
    for k in marked:
        for m in set(lines[k][4]):
            held[m] = held.get(m, 0.0) + sizes[k]
    return {m for m, size in held.items() if (parser.wraps[m] or most[m] == len(kept)) and size > total / 2}


def extract(html: str | None) -> str:
    """Blocks of the main text, joined by an empty line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.line()
    lines, kinds = parser.out, parser.kinds
    sizes = np.array([len(x[0]) for x in lines], dtype=float)
    free = wrappers(parser, sizes)
    kept = [k for k, x in enumerate(lines) if not x[3] and free.issuperset(x[4])]
    if not kept:
        return ""
    marked = marks(lines, sizes, kept)
    total = sum(sizes[k] for k in marked)
    for kind in ("article", "main"):
        own = [k for k in kept if any(kinds[n] == kind for n in lines[k][2])]
        if own and sum(sizes[k] for k in set(own).intersection(marked)) >= SHARE * total:
            return "\n\n".join(lines[k][0] for k in own)
    # else the innermost container with nearly all the marked text
    held: dict[int, float] = {}
    for k in marked:
        for n in lines[k][2]:
            held[n] = held.get(n, 0.0) + sizes[k]
    region = max((n for n, s in held.items() if s >= SHARE * total and kinds[n] not in ("ul", "ol", "table", "tbody", "tr", "td", "dl", "li")), default=-1)
    return "\n\n".join(lines[k][0] for k in kept if region < 0 or region in lines[k][2])


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the html by text and n_chars."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
