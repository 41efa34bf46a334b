"""Main text of web pages.

One pass of the standard library's parser over a page gives its lines (blocks of text between block-level tags), each with
its text, the part of it that is links, and the number of tags that it took.  The ratio of unlinked text to tags of each
line is smoothed over its neighbours with a Gaussian, and a threshold between the two clusters of ratios tells dense lines.
The content region is the innermost container that holds nearly all dense text, widened to what belongs to it; a region is
kept whole, so short paragraphs and sections between long ones stay.

Tags and names are evidence: lines in an ``article`` or ``main`` count a few times over, and those in elements that the page
itself marks as something else (menus, headers, footers, sidebars, notices, adverts, forms, comments) a few times less, so
it is the ratios that decide.  A marked element that holds most of the page's text, or the article, is a wrapper, whatever
its name; any other is left out of the region.  So are boxes of links.

Containers are numbered in the order in which they open, so those within one are a range of numbers, and all sums over
containers are differences of running sums: the time grows with the page only, however deep it is nested.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas select option textarea button head title audio video map datalist".split())
#: Elements that hold something other than the article.
ASIDE = frozenset("nav header footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body td html".split())
#: An open one of these ends when one of its set starts.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: Words in class, id or role that mark something other than the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|copyright|comments?|replies|reply|disqus|respond|share|sharing|social|related|recommended|pagination|pager|search|form|toolbar|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
_WHITE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0  -     　]+")


#: How many times over the ratio of a line in an article or main counts (and how many times less in a marked element), the
#: part of the dense text that a region must hold, and the part of links from which a container is a list of links.
EVIDENCE, HOLDS, LINKS = 4.0, 0.9, 0.5
#: Lines of a list of links, and lines that a marked element must have to be a wrapper of a page without article.
MENU_LINES, WRAPPED_LINES = 3, 2


@dataclass(frozen=True)
class Line:
    text: str
    linked: int
    tags: int
    container: int
    heading: bool = False


@dataclass(frozen=True)
class Open:
    """An open element: what holds for the text in it.  ``block``: the place in the stack of the innermost block."""

    tag: str = ""
    hidden: bool = False
    container: int = 0
    link: bool = False
    block: int = 0


class PageLines(HTMLParser):
    """Lines of a page, and its containers by number: each one's parent, its outermost article or main (-1 for none), and
    whether it is marked: 0 not, 1 by a name or as a form, 2 by its tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Open()]
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
        self.parent, self.article, self.marked = [-1], [-1], [0]
        self.lines: list[Line] = []
        self.parts: dict[int, list[str]] = {}  # of the current line, by container
        self.linked: dict[int, int] = {}
        self.tags = 0

    def _end_line(self) -> None:
        tag = self.stack[self.stack[-1].block].tag
        for container, parts in self.parts.items():
            text = _WHITE.sub(" ", "".join(parts)).strip(" ")
            if text:
                self.lines.append(Line(text, min(self.linked[container], len(text)), self.tags, container, tag in HEADINGS))
        self.parts, self.linked = {}, {}
        self.tags = 0

    def _close(self, place: int) -> None:
        for i in range(len(self.stack) - 1, place - 1, -1):
            self.places[self.stack[i].tag].pop()
        del self.stack[place:]

    def _apart(self) -> None:
        """What follows must not join the text before it."""
        for parts in self.parts.values():
            parts.append(" ")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            # An open paragraph (or item, cell) ends here, with whatever inline elements were left open in it.
            while tag in ENDED_BY.get(self.stack[self.stack[-1].block].tag, ()):
                self._close(self.stack[-1].block)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self._apart()
            return
        around = self.stack[-1]
        hidden, container = around.hidden, around.container
        if not hidden:
            hidden = tag in SILENT or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
            mark = 0
            if not hidden and tag not in ("article", "main", "body", "html"):
                names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label"))
                mark = 2 if tag in ASIDE else 1 if tag == "form" or (names and MARKED.search(names)) else 0
            if hidden or mark:
                self._apart()
            if not hidden and (mark or tag in CONTAINERS):
                article = self.article[container]
                self.parent.append(container)
                container = len(self.article)
                self.article.append(container if tag in ("article", "main") and article < 0 else article)
                self.marked.append(mark)
        place = len(self.stack)
        self.places.setdefault(tag, []).append(place)
        self.stack.append(Open(tag, hidden, container, around.link or tag == "a", place if tag in BLOCKS else around.block))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        open_ = self.places.get(tag)
        # An inline end tag does not close the block around it.
        if open_ and (tag in BLOCKS or open_[-1] > self.stack[-1].block):
            self._close(open_[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        now = self.stack[-1]
        if not now.hidden:
            self.parts.setdefault(now.container, []).append(data)
            self.linked[now.container] = self.linked.get(now.container, 0) + len(data.strip()) * now.link


class Tree:
    """A page's containers: the last one within each, depths, and which are left out as what they are marked as."""

    def __init__(self, page: PageLines):
        self.page, parent = page, page.parent
        self.last = list(range(len(parent)))
        for c in range(len(parent) - 1, 0, -1):
            self.last[parent[c]] = max(self.last[parent[c]], self.last[c])
        self.depth = [0] * len(parent)
        for c in range(1, len(parent)):
            self.depth[c] = self.depth[parent[c]] + 1
        self.aside = self._asides()

    def sums(self, values: list[float]) -> Callable[[int], float]:
        """The sum over a container and all within it, of values of the lines."""
        own = [0.0] * len(self.last)
        for x, v in zip(self.page.lines, values, strict=True):
            own[x.container] += v
        return self.within(own)

    def within(self, own: list[float]) -> Callable[[int], float]:
        before = [0.0, *accumulate(own)]
        return lambda c: before[self.last[c] + 1] - before[c]

    def _asides(self) -> list[bool]:
        """A marked element is a wrapper, whatever its mark, if at least half of the page's unlinked text is in it (text in
        an article counts more) and no article is left outside.  Without any article, a tag is what it says, and so is a
        single line."""
        page = self.page
        bare = [float(len(x.text) - x.linked) for x in page.lines]
        in_article = [b if page.article[x.container] >= 0 else 0.0 for x, b in zip(page.lines, bare, strict=True)]
        text, articles = self.sums([b + (EVIDENCE - 1) * a for a, b in zip(in_article, bare, strict=True)]), self.sums(in_article)
        lines = self.sums([1.0] * len(bare))
        out = [False] * len(page.parent)
        for c in range(1, len(out)):
            around = page.parent[c]
            out[c] = out[around]
            if page.marked[c] and not out[c]:
                # Articles within it, if it isn't within one itself.
                inner = articles(c) if page.article[around] < 0 else 0.0
                alone = articles(c) >= articles(0) and (articles(0) > 0 or (page.marked[c] == 1 and lines(c) >= WRAPPED_LINES))
                out[c] = not ((inner > 0 or alone) and 2 * text(c) >= text(0) > 0)
        return out


def smoothed(values: list[float], sigma: float = 1.0, reach: int = 2) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and normalised anew."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-reach, reach + 1):
            if 0 <= i + d < len(values):
                total += kernel[d + reach] * values[i + d]
                weight += kernel[d + reach]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The value midway between the means of the two clusters that it parts (by its own repeated correction)."""
    at = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def line_ratios(page: PageLines, tree: Tree | None = None) -> list[float]:
    """Unlinked text to tags of each line; lines in an article or main count EVIDENCE times over, marked ones so much less."""
    tree = tree or Tree(page)
    return [(len(x.text) - x.linked) / max(1, x.tags) * weight(tree, x.container) for x in page.lines]


def weight(tree: Tree, container: int) -> float:
    return 1 / EVIDENCE if tree.aside[container] else EVIDENCE if tree.page.article[container] >= 0 else 1.0


def dense_lines(ratios: list[float]) -> list[bool]:
    """Which lines belong to the denser cluster, by the logarithms of their smoothed ratios."""
    logs = [math.log1p(r) for r in smoothed(ratios)]
    least = min(threshold(logs), max(logs))  # the mean of equal numbers may be rounded above them
    return [x >= least for x in logs]


def content_lines(page: PageLines, ratios: list[float], tree: Tree | None = None) -> list[Line]:
    """The lines of the content region."""
    tree, lines = tree or Tree(page), page.lines
    # The innermost container that holds nearly all dense text.
    held = tree.sums([len(x.text) * weight(tree, x.container) if dense else 0.0 for x, dense in zip(lines, dense_lines(ratios), strict=True)])
    region = max((c for c in range(len(page.parent)) if held(c) >= HOLDS * held(0)), key=lambda c: (tree.depth[c], -c))
    size, linked, number = tree.sums([float(len(x.text)) for x in lines]), tree.sums([float(x.linked) for x in lines]), tree.sums([1.0] * len(lines))
    lists = [linked(c) > LINKS * size(c) and number(c) >= MENU_LINES for c in range(len(page.parent))]
    menus = tree.within([float(x) for x in lists])
    if page.article[region] >= 0:
        region = page.article[region]  # a headline may stand in a box of its own
    # Widen the region until what is added is mostly links or holds a list of them: that is the frame of the page.
    at = region
    while page.parent[at] >= 0 and page.article[region] < 0:
        at = around = page.parent[at]
        if menus(around) - menus(region) > 0 or linked(around) - linked(region) > LINKS * (size(around) - size(region)):
            break
        region = around if number(around) > number(region) else region
    # Where the region is the frame of the page: single lines in boxes of their own, if they are thin beside the other boxes.
    thin = thin_boxes(page, tree, region, ratios, number, lists) if menus(region) - lists[region] > 0 and page.article[region] < 0 else set()
    # Boxes of links in the region are menus; so is a link that stands alone in a box next to the content.
    own_size, own_linked = [0] * len(lists), [0] * len(lists)
    for x in lines:
        own_size[x.container] += len(x.text)
        own_linked[x.container] += x.linked
    out = list(tree.aside)
    for c in range(region + 1, tree.last[region] + 1):
        lone = page.article[c] < 0 and own_size[c] > 0 and own_linked[c] > LINKS * own_size[c]
        out[c] = out[c] or lists[c] or lone or c in thin or (page.parent[c] != region and out[page.parent[c]])
    return [x for x in lines if region <= x.container <= tree.last[region] and not out[x.container]]


def thin_boxes(page: PageLines, tree: Tree, region: int, ratios: list[float], number: Callable, lists: list[bool]) -> set[int]:
    """Boxes right within a region that hold one line without heading and belong to the thinner cluster of boxes, by the
    highest ratio of a line in each."""
    boxes = [c for c in range(region + 1, tree.last[region] + 1) if page.parent[c] == region and not tree.aside[c] and number(c) > 0 and not lists[c]]
    if len(boxes) < 2:
        return set()
    highest, headed = [0.0] * len(boxes), set()
    for x, r in zip(page.lines, ratios, strict=True):
        i = bisect_right(boxes, x.container) - 1
        if i >= 0 and x.container <= tree.last[boxes[i]]:
            highest[i] = max(highest[i], r)
            headed |= {boxes[i]} if x.heading else set()
    logs = [math.log1p(r) for r in highest]
    least = min(threshold(logs), max(logs))
    return {c for c, x in zip(boxes, logs, strict=True) if x < least and number(c) == 1 and c not in headed}


def page_lines(html: str | None) -> PageLines:
    page = PageLines()
    page.feed(html or "")
    page.close()
    page._end_line()
    return page


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty if there is none."""
    page = page_lines(html)
    if not page.lines:
        return ""
    tree = Tree(page)
    return "\n\n".join(x.text for x in content_lines(page, line_ratios(page, tree), tree))


def extract_text(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns ``keep``, text and n_chars (code points) for every row; no shuffle.

    A null or empty page, and one without main text, gives an empty text; a page of any length is read whole.  Null keys and
    repeated rows are kept as they are, an empty table gives no rows, and other columns are not looked at.
    """
    fields = [pages.schema[c] for c in (key, *keep)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            names = [key, *keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(key, *keep, html).mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
