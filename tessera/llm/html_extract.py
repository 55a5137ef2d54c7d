"""Main text of web pages.

A page streams through the standard library's parser.  Block elements cut it into lines, each with its text, the
number of tags met in it, and the open elements that may be page furniture: menus, headers, footers, sidebars, notices,
adverts, forms, reader comments, by element, role or the words of a class or id.  What a script, style or control holds
is no text.  When the page has been read, a suspect is furniture unless it holds the page's title or ``main``, an article
(for words that do not mean a side matter), or most of the page's text.

The ratio of text to tags of the lines that are left is smoothed with a Gaussian kernel, and lines above the threshold (the
mean, lowered by half a standard deviation; all lines where they hardly differ) cluster into content.  Each article, ``main``
and the page outside them weighs as much as its content lines; the heaviest, and articles of a quarter of its weight or more,
are the region.  Short paragraphs inside it stay.  Where the page itself is heaviest, the region runs from its first content
line to its last.

Defined results: a null or empty page has empty text; a menu, sidebar or footer whose end tag is missing ends with the next article, ``main``,
sidebar or footer, other unclosed elements with their parents, and cut markup is read as far as it goes; a very long page is read
in one piece, like others; each row is read alone, so repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and the class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold text of the page.
MUTE = frozenset("head title script style noscript template button select option textarea iframe object svg canvas audio video".split())
HOLDERS = frozenset(("article", "main"))
#: Elements and class or id words of side matter, and of what may also stand around an article.
SIDE_TAGS = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIDE = frozenset("sidebar widget nav navbar navigation menu breadcrumb breadcrumbs masthead copyright comment comments commentlist disqus reply replies related recommended pagination footer".split())
AROUND = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social".split()
)
#: A class word with one of these parts tells how a page is laid out, not what the element is.
LAYOUT = frozenset("has no not with without is free enabled disabled open closed".split())
#: Words of page headers and footers, which count outside articles only.
FRAME = re.compile(r"(?:(?:site|page|global|main|top|bottom)[-_])?(?:header|footer)")
#: An article is furniture by these words only.
REMARK = frozenset("comment reply".split())
#: Elements left open that a start tag ends, with all inside them.
LEFT_OPEN = frozenset("nav aside footer menu".split())
STARTS = frozenset("article main aside footer".split())
SIGMA, RADIUS = 1.5, 4
#: Share of the page's text that makes a suspect content, and of the heaviest holder's weight that makes another part of the region.
MOST, PART = 0.5, 0.25
#: HTML's optional end tags: the open elements that a block's start tag ends; any other block ends a paragraph.
ENDS = {
    "li": frozenset(("p", "li")),
    "dt": frozenset(("p", "dt", "dd")),
    "dd": frozenset(("p", "dt", "dd")),
    "td": frozenset(("p", "td", "th")),
    "th": frozenset(("p", "td", "th")),
    "tr": frozenset(("p", "td", "th", "tr")),
}
PARAGRAPH = frozenset(("p",))
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


def suspicion(tag: str, attrs: list, held: int) -> str:
    """Why an element may be furniture: "side", "around", or "" if nothing speaks for it.  held: whether it is inside an article or main."""
    if tag in SIDE_TAGS or tag == "header" and not held:
        return "side"
    found = "around" if tag == "form" else ""
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return "side"
        if not v:
            continue
        if k == "role" and v.lower() in ROLES:
            found = found or "around"
        elif k in ("class", "id"):
            for word in v.split():
                parts = {p.lower() for p in _PART.split(word)}
                if tag in HOLDERS:
                    if tag == "article" and word.lower() in REMARK:
                        return "side"
                elif parts & LAYOUT:
                    continue
                elif parts & SIDE and (held == 0 or parts & SIDE != {"footer"}) or not held and FRAME.fullmatch(word.lower()):
                    return "side"
                elif parts & AROUND:
                    found = "around"
    return "" if tag in ("html", "body") else found


class _Reader(HTMLParser):
    """Lines as (text, tags, holder, suspects): holder is the number of the innermost article or main, 0 outside; suspects are numbers of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, tuple[int, ...]]] = []  # name, and what held outside: mute, holder, suspects
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.text: list[str] = []
        self.tags, self.holders, self.mute, self.holder = 0, 0, False, 0
        self.suspects: tuple[int, ...] = ()
        self.why: list[str] = []
        self.saved: set[int] = set()

    def cut(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.tags, self.holder, self.suspects))
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += not self.mute
        if tag in BLOCK:
            self.cut()
            ends = ENDS.get(tag, PARAGRAPH)
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ends:
                    self._close(at)
                elif name in BLOCK:
                    break
            if tag in STARTS:
                left = [at for at, x in enumerate(self.open) if x[0] in LEFT_OPEN]
                if left and (tag in HOLDERS and self.open[left[0]][0] != "aside" or tag in LEFT_OPEN or tag == "main"):
                    self._close(left[0])
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        before = (tag, self.mute, self.holder, self.suspects)
        if not self.mute:
            why = suspicion(tag, attrs, self.holder)
            if tag in HOLDERS and why != "side":
                self.holders += 1
                self.holder = self.holders
                self.saved |= {x for x in self.suspects if tag == "main" or self.why[x] == "around"}
            elif tag == "h1":
                self.saved |= {x for x in self.suspects if self.why[x] == "around"}
            if why:
                self.suspects += (len(self.why),)
                self.why.append(why)
        self.open.append(before)
        self.mute = self.mute or tag in MUTE

    def _close(self, at: int) -> None:
        _, self.mute, self.holder, self.suspects = self.open[at]
        del self.open[at:]

    def handle_endtag(self, tag):
        self.tags += not self.mute
        if tag in BLOCK:
            self.cut()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)

    def content(self) -> list[tuple[str, int, int]]:
        """The lines outside furniture."""
        size = [0] * len(self.why)
        for text, _, _, suspects in self.lines:
            for x in suspects:
                size[x] += len(text)
        most = MOST * sum(len(line[0]) for line in self.lines)
        bad = {x for x in range(len(size)) if x not in self.saved and size[x] <= most}
        return [line[:3] for line in self.lines if not bad.intersection(line[3])]


def _kernel() -> list[float]:
    k = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
    return [x / sum(k) for x in k]


KERNEL = _kernel()


def smoothed(ratio: list[float]) -> list[float]:
    """Gaussian smoothing; the ends repeat."""
    n, padded = len(ratio), [ratio[0]] * RADIUS + ratio + [ratio[-1]] * RADIUS
    return [sum(w * padded[i + j] for j, w in enumerate(KERNEL)) for i in range(n)]


def blocks(html: str | None) -> list[str]:
    """The lines of the content regions, in page order."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    lines = reader.content()
    if not lines:
        return []
    level = smoothed([len(t) / (tags + 1) for t, tags, _ in lines])
    mean = sum(level) / len(level)
    spread = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    content = [x >= mean - spread / 2 or spread < mean / 2 for x in level]
    weight: dict[int, int] = {}
    for (t, _, holder), inside in zip(lines, content):
        weight[holder] = weight.get(holder, 0) + inside * len(t)
    top = max(weight, key=lambda h: (weight[h], h))
    region = {h for h, w in weight.items() if h and w and w >= PART * weight[top]} | {top}
    if top:
        return [t for t, _, holder in lines if holder in region]
    at = [i for i, (x, inside) in enumerate(zip(lines, content)) if inside and x[2] == 0]
    return [t for t, _, holder in lines[at[0] : at[-1] + 1] if holder in region]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text (blocks joined by a line feed) and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                text = ["\n".join(blocks(x.as_py())) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    held = [f"c{i}" for i in range(len(keep))]
    rows = pages.select(*[pages[c].alias(h) for c, h in zip(keep, held)], F.col(html_col).cast("string").alias("html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars bigint"
    return rows.mapInArrow(run, fields).toDF(*keep, "text", "n_chars")
