"""Main text of HTML pages by tag ratios (operator 1).

A page is read once with the standard library's event parser.  Block tags end a "line";
a line holds its text and how many tags stood in it.  Scripts, styles and the like hold no text.
Tags, roles and names of other furniture (menus, forms, footers, adverts, comments) mark what
they hold; a mark is heeded unless the page speaks against it: it holds more than half of the
text and either most of the text in articles, or has a name of a wrapper, or leaves next to
nothing outside all marks.  What heeded marks hold is no line.  Each line's text-to-tag ratio is smoothed with a
Gaussian over its neighbours, and lines whose smoothed ratio clusters above the threshold form
the content regions (a one-dimensional two-means split, started at the standard deviation,
decides the threshold).  Marked content (an article or main element) is evidence: with o the odds
that text of the regions is marked, marked lines need 1 - o of the threshold and others max(o, 1)
times it.  So an article that holds most of the page's regions is taken whole and little beside
it, and one that holds a teaser doesn't hide the main text.  Regions grow over neighbouring
lines, marked or not as they are, that are not mostly links, so short paragraphs and headings stay; lines that are mostly links don't
begin or end one.

Defined cases: null, empty or text-free html gives the empty string; white space of any
kind inside a block is one blank; unclosed tags end where their parent ends; broken character
references stay as they are written; lines with ratios at the threshold itself are not kept by
it; nothing is cut from long pages; repeated rows give repeated results; a null id or url is
kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is never shown as such.
RAW = frozenset("script style noscript template iframe object svg canvas button select textarea head audio video map".split())
#: Elements that hold furniture.
CHROME = frozenset("nav footer aside form menu dialog".split())
#: A header is chrome unless it stands inside an article.
CONTENT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark chrome.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer "
    "sidebar side aside widget widgets related recommended recommendations toc "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "comment comments disqus reply replies respond discussion share sharing social".split()
)
#: Words that, beside one of those, tell of a wrapper or of an article's own heading.
WRAPPERS = frozenset("wrap wrapper container layout content main inner page body grid row columns".split())
OWN = frozenset("post entry article story content chapter section".split())
#: What may be an article's section too, unless it holds what the second set names.
TALK, TALKERS = frozenset(("discussion", "respond", "replies")), frozenset("comment comments reply disqus".split())
#: First words of names that tell of a state of the page, not of what the element is.
STATES = frozenset("has with without no is".split())
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Tags that end an open element of the key's kind.
_ENDS = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Mark:
    """An element that looks like furniture, and what it holds."""

    def __init__(self, weak: bool, talk: bool, contents: int):
        self.weak, self.talk, self.contents = weak, talk, contents
        self.chars = self.article_chars = 0
        self.talkers = False


class Lines(HTMLParser):
    """Collects the lines of one page: their parts (text, marks, linked), tags, and how many articles they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, tuple[Mark, ...], bool]], int, int]] = []
        self.parts: list[tuple[str, tuple[Mark, ...], bool]] = []
        self.tags = 0
        self.open: list[tuple[str, bool, Mark | None, bool]] = []  # tag, raw, mark, content
        self.raw = self.content = self.anchors = 0
        self.marks: tuple[Mark, ...] = ()

    def end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.content))
            self.parts = []
        self.tags = 0

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> Mark | None:
        if tag in CHROME or tag == "header" and not self.content:
            return Mark(False, False, self.content)
        if tag in ("html", "body", *CONTENT):
            return None
        for k, v in attrs:
            if k in ("class", "id"):
                for words in map(_NAME.findall, (v or "").lower().split()):
                    hits = NAMES.intersection(words)
                    if not hits or words[0] in STATES:
                        continue
                    if hits <= {"header"} and (self.content or not OWN.isdisjoint(words)):
                        continue  # an article's own heading
                    for m in self.marks if not TALKERS.isdisjoint(words) else ():
                        m.talkers = True
                    return Mark(not WRAPPERS.isdisjoint(words), hits <= TALK and self.content > 0, self.content)
            elif k == "role":
                if (v or "").lower() in ROLES:
                    return Mark(False, False, self.content)
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v.lower()):
                return Mark(False, False, self.content)
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in _ENDS and any(t == tag or t in _ENDS[tag] for t, *_ in self.open[-1:]):
            self._close(len(self.open) - 1)
        raw, content = tag in RAW, tag in CONTENT
        mark = None if raw or self.raw else self._mark(tag, attrs)
        self.open.append((tag, raw, mark, content))
        if mark:
            self.marks = (*self.marks, mark)
        self.raw += raw
        self.content += content
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # in HTML the slash means nothing
            self.handle_starttag(tag, attrs)
            if tag in ("svg", "path", "use", "circle", "rect", "g", "line"):
                self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        for tag, raw, mark, content in self.open[at:]:
            self.anchors -= tag == "a"
            self.raw -= raw
            self.content -= content
            if mark:
                self.marks = self.marks[:-1]
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            own = self.open[at][0]
            if own == tag:
                return self._close(at)
            if tag in INLINE and own not in INLINE:
                return  # a stray inline end tag ends nothing
            if own in CONTENT and tag in ("p", "li", "div", "section", "span"):
                return

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.parts.append((data, self.marks, self.anchors > 0))

    def heeded(self) -> list[tuple[str, int, bool, bool]]:
        """(text, tags, in marked content, is mostly links) of the lines outside the marks that are heeded."""
        total = outside = 0
        for parts, _, contents in self.lines:
            for data, marks, linked in parts:
                if not linked:
                    n = len("".join(data.split()))
                    total += n
                    outside += 0 if marks else n
                    for m in marks:
                        m.chars += n
                        m.article_chars += n if contents > m.contents else 0

        def stands(m: Mark) -> bool:
            if m.talk and not m.talkers:
                return False
            return not (2 * m.chars > total and (m.weak or 2 * m.article_chars > total or 20 * outside < total))

        stood: dict[int, bool] = {}

        def heed(m: Mark) -> bool:
            if id(m) not in stood:
                stood[id(m)] = stands(m)
            return stood[id(m)]

        out = []
        for parts, tags, contents in self.lines:
            own, linked_chars = [], 0
            for data, marks, linked in parts:
                if any(map(heed, marks)):
                    continue
                own.append(data)
                if linked:
                    linked_chars += len(" ".join(data.split()))
            if text := " ".join("".join(own).split()):
                out.append((text, tags, contents > 0, 2 * linked_chars > len(text)))
        return out


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with a kernel of two deviations to each side, renormalised at the ends."""
    r = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(ratios)):
        span = range(max(0, i - r), min(len(ratios), i + r + 1))
        out.append(sum(kernel[j - i + r] * ratios[j] for j in span) / sum(kernel[j - i + r] for j in span))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters of the values: two-means in one dimension, started at their deviation."""
    mean = sum(values) / len(values)
    cut = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    for _ in range(50):
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            return min(cut, min(values) - 1e-9) if not low else cut
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.heeded()
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(tags, 1) for text, tags, *_ in lines], sigma)
    cut = threshold(ratios)
    held = [0, 0]  # characters of the regions, unmarked and marked
    for (text, _, marked, links), r in zip(lines, ratios, strict=True):
        held[marked] += len(text) * (r > cut and not links)
    odds = held[1] / held[0] if held[0] else math.inf if any(marked for _, _, marked, _ in lines) else 0.0
    kept = [(odds >= 1 or r > cut * (1 - odds)) if marked else r > cut * max(odds, 1) for (_, _, marked, _), r in zip(lines, ratios, strict=True)]
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = 1 if order.step < 0 else -1
        for i in order:
            kept[i] |= kept[i + step] and not lines[i][3] and lines[i][2] == lines[i + step][2]
    # beside long paragraphs links get over the threshold too: they stay between kept lines
    whole = [m and odds >= 1 for _, _, m, _ in lines]
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        before = False
        for i in order:
            kept[i] &= before or whole[i] or not lines[i][3]
            before = kept[i]
    none = not any(kept)
    return " ".join(text for (text, *_), k in zip(lines, kept, strict=True) if k or none)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h, sigma) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
