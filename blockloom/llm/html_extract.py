"""Main text of web pages.

The standard library's streaming parser gives events; block elements cut the
page into lines, each with its text, its tags and its link text, in a tree of
containers.  The ratio of text to tags of each line is smoothed by a Gaussian
over the lines around it, on every page.  Lines, and regions - the lines of one
container - whose smoothed ratio reaches a share of the best region's are
content.  Content lines are then clustered: what shares their container or
article, or lies between two of them at one depth, stays with them, so that
lists, table cells and short paragraphs within content are not lost; blocks that
are mostly links go.

What an element is called is a weight on its lines' ratio and no more.  Elements
and class names of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments weigh little, unless they hold nearly all of the page's text (a
form around the whole page); an article element weighs double where it holds most
of it.  Only what has no text of its own to show, such as scripts, is passed over
while parsing.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import beside, quoted

# Elements by their role in HTML.
SKIPPED = frozenset("script style noscript template button select textarea iframe svg canvas object title head math audio video map".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset hr center hgroup search nav header footer aside form dialog menu".split()
)
CONTAINERS = frozenset("body main article section div table ul ol td nav header footer aside form dialog menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(["article", "main"])
HOLDERS = CONTAINERS - frozenset("table ul ol td".split())  # lists and tables belong to what holds them
ENDS = {"li": ("ul", "ol", "menu"), "td": ("table",), "p": ()}  # elements that others of their kind end, up to what encloses them
LONG = 300  # characters from which a line is no more likely to be prose
LINKS = 3  # links from which a block of mostly link text is a list of links
ARTICLE_WEIGHT, ASIDE_WEIGHT = 2.0, 0.01
FEW = 200  # characters that are no main text beside a much larger block
# Element names, and words in class, id and role, of what is rarely content.  The first two lists are
# doubted only where next to no text is outside, the others where less than a quarter is.
FIRM_TAGS = frozenset("nav header footer aside menu dialog".split())
FIRM_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead comment comments commentlist disqus replies respond "
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner cookie cookies consent gdpr complementary contentinfo".split()
)
LOOSE_TAGS = frozenset("form search".split())
LOOSE_WORDS = frozenset(
    "header promo promoted sponsor sponsored notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended widget toolbar pagination pager search searchbox form".split()
)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def hint(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 or 1 if the element's name or classes speak against content, firmly or loosely."""
    if tag in FIRM_TAGS:
        return 2
    found = 1 if tag in LOOSE_TAGS else 0
    if attrs and tag not in ARTICLES and tag not in ("html", "body"):
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = {w.lower() for w in NAMES.findall(value)}
                if words & FIRM_WORDS:
                    return 2
                if words & LOOSE_WORDS:
                    found = 1
    return found


class Line:
    __slots__ = ("link", "links", "node", "tags", "text")

    def __init__(self, text: str, tags: int, link: int, links: int, node: int):
        self.text, self.tags, self.link, self.links, self.node = text, tags, link, links, node


class Node:
    """A container: its element, the node around it, and the hint against it."""

    __slots__ = ("hint", "parent", "tag")

    def __init__(self, tag: str, parent: int, hint: int):
        self.tag, self.parent, self.hint = tag, parent, hint


class Lines(HTMLParser):
    """Collects a page's lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.link = self.links = self.anchors = 0
        self.skipping, self.depth = "", 0
        self.open: list[tuple[str, int]] = []  # containers with their nodes
        self.nodes = [Node("body", -1, 0)]  # the first is the page

    def at(self) -> int:
        return self.open[-1][1] if self.open else 0

    def cut(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", "".join(self.parts)).strip(" ")
            if text:
                self.lines.append(Line(text, self.tags, self.link, self.anchors, self.at()))
            self.parts = []
        self.tags = self.link = self.anchors = 0

    def close_to(self, k: int) -> None:
        del self.open[k:]

    def imply_ends(self, tag: str) -> None:
        """Close what the start of ``tag`` ends although it was left open."""
        if self.open and self.open[-1][0] == "p":
            self.close_to(len(self.open) - 1)
        kind = "td" if tag in ("td", "th", "tr", "tbody", "tfoot") else tag
        if kind in ENDS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == kind:
                    self.close_to(k)
                    break
                if self.open[k][0] in ENDS[kind]:
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            if tag == "body" and self.skipping in ("head", "title"):  # left open
                self.skipping = ""
            else:
                self.depth += tag == self.skipping
                return
        if tag in SKIPPED:
            self.skipping, self.depth = tag, 1
            return
        found = hint(tag, attrs) if tag not in VOID else 0
        if tag in BLOCKS:
            self.cut()
            self.imply_ends(tag)
        elif tag == "br":
            self.parts.append(" ")
        elif found and tag != "a":  # within a line: an advert or a button
            self.skipping, self.depth = tag, 1
            return
        self.tags += 1
        self.links += tag == "a"
        self.anchors += tag == "a"
        if tag in CONTAINERS or (found and tag in BLOCKS):
            self.nodes.append(Node(tag, self.at(), found))
            self.open.append((tag, len(self.nodes) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping:
                self.depth -= 1
                if not self.depth:
                    self.skipping = ""
            return
        if tag in BLOCKS:
            self.cut()
        self.links -= tag == "a" and self.links > 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                break

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.link += len(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing, with the kernel's weights brought to one at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def credible(nodes: list[Node], own: list[int]) -> list[bool]:
    """Which hints stand, given the plain characters directly in each node.

    A hint falls if its node holds most of the page's text and little is outside
    of every hinted node; then what it encloses is looked at.
    """
    held = list(own)
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    total, stands = held[0], [n.hint > 0 for n in nodes]
    while True:
        top = [False] * len(nodes)  # in a hinted node
        for k in range(1, len(nodes)):
            top[k] = stands[k] or top[nodes[k].parent]
        outside = sum(n for n, inside in zip(own, top, strict=True) if not inside)
        fallen = [
            k
            for k in range(1, len(nodes))
            if stands[k]
            and not top[nodes[k].parent]
            and 2 * held[k] > total
            and outside < (0.25 * total if nodes[k].hint == 1 else min(0.1 * total, FEW))
        ]
        if not fallen:
            return stands
        for k in fallen:
            stands[k] = False


def ratios(lines: list[Line], nodes: list[Node]) -> tuple[list[float], list[bool]]:
    """Each line's weighted ratio of text to tags, and whether it lies under a hint that stands."""
    plain = [max(0, len(x.text) - x.link) for x in lines]
    own = [0] * len(nodes)
    for x, n in zip(lines, plain, strict=True):
        own[x.node] += n
    stands = credible(nodes, own)
    weight, side, article = [1.0] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        weight[k] = weight[node.parent] * (ASIDE_WEIGHT if stands[k] else 1.0)
        side[k] = side[node.parent] or stands[k]
        article[k] = article[node.parent] or node.tag in ARTICLES
    marked = 2 * sum(n for n, a, s in zip(own, article, side, strict=True) if a and not s) >= sum(n for n, s in zip(own, side, strict=True) if not s)
    found = []
    for x, n in zip(lines, plain, strict=True):
        found.append(min(n, LONG) / (1 + x.tags) * weight[x.node] * (ARTICLE_WEIGHT if marked and article[x.node] else 1.0))
    return found, [side[x.node] for x in lines]


def content(lines: list[Line], nodes: list[Node], sigma: float, share: float) -> list[Line]:
    """The lines of the clusters around those that stand out by their smoothed ratio of text to tags."""
    ratio, aside = ratios(lines, nodes)
    smooth = smoothed(ratio, sigma)

    weight: dict[int, int] = {}
    mean: dict[int, float] = {}
    for x, r, s, off in zip(lines, ratio, smooth, aside, strict=True):
        weight[x.node] = weight.get(x.node, 0) + len(x.text)
        mean[x.node] = mean.get(x.node, 0.0) + len(x.text) * (min(r, s) if off else s if r > 0 else 0.0)  # neighbours do not lift what is hinted at or links
    mean = {k: v / weight[k] for k, v in mean.items()}
    threshold = share * max(mean.values())
    if not threshold:  # nothing but links
        return lines

    holder, depth, article, side = [0], [0], [-1], [False] * len(nodes)  # of each node: the container its lists and tables lie in, ...
    for x, off in zip(lines, aside, strict=True):
        side[x.node] = off
    for k, node in enumerate(nodes[1:], 1):
        holder.append(k if node.tag in HOLDERS or node.hint else holder[node.parent])
        depth.append(depth[node.parent] + 1)
        article.append(k if node.tag in ARTICLES else article[node.parent])

    strong = [min(r, s) >= threshold for r, s in zip(ratio, smooth, strict=True)]
    lively, anchors, surplus = [False] * len(nodes), [0] * len(nodes), [0] * len(nodes)  # of each node and what it encloses
    for x, good in zip(lines, strong, strict=True):
        lively[x.node] |= good
        anchors[x.node] += x.links
        surplus[x.node] += 2 * x.link - len(x.text)
    for k in range(len(nodes) - 1, 0, -1):
        parent = nodes[k].parent
        lively[parent] |= lively[k]
        anchors[parent] += anchors[k]
        surplus[parent] += surplus[k]
    links = [not good and n >= LINKS and more > 0 for good, n, more in zip(lively, anchors, surplus, strict=True)]
    for k, node in enumerate(nodes[1:], 1):
        links[k] |= links[node.parent]

    whole = {node for node, value in mean.items() if value >= threshold}
    for k, x in enumerate(lines):
        if strong[k]:
            whole.update((holder[x.node], article[x.node]))
    inside = [node in whole for node in range(len(nodes))]
    page = {0} | {k for k, node in enumerate(nodes) if node.tag == "body"}  # containers directly in the page stand for themselves
    for k, node in enumerate(nodes[1:], 1):
        inside[k] = inside[k] or (inside[node.parent] and (node.parent not in page or holder[k] == node.parent))

    kept = [inside[x.node] or (r > 0 and s >= threshold) for x, r, s in zip(lines, ratio, smooth, strict=True)]
    last = None
    for k, x in enumerate(lines):
        if strong[k]:
            if last is not None and depth[holder[lines[last].node]] == depth[holder[x.node]]:
                kept[last:k] = [True] * (k - last)
            last = k
    kept = [stays and (not off or good) for stays, off, good in zip(kept, aside, strong, strict=True)]
    menu = []
    for x, good in zip(lines, strong, strict=True):
        mostly = not good and 2 * x.link > len(x.text)
        menu.append(links[x.node] or (mostly and (x.links >= LINKS or nodes[x.node].hint > 0)))
    return [x for x, stays, link in zip(lines, kept, menu, strict=True) if stays and not link]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.25) -> str:
    """The content lines of a page, joined by an empty line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = content(parser.lines, parser.nodes, sigma, share) if parser.lines else []
    return "\n\n".join(x.text for x in lines)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (its code points).

    Character references are decoded, runs of white space in a line become one
    space, nothing else is dropped from a content region or cut.  A null or
    empty page and one without content give the empty text.  Markup that never
    closes is read to the page's end.  Every row is read by itself, so repeated
    rows give equal results; an empty table gives an empty one.  Columns of the
    input named text or n_chars are replaced; others of any name stay.
    """
    own = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]

    def compute(pages: list[str | None]) -> list[tuple[str, int]]:
        return [(t, len(t)) for t in map(main_text, pages)]

    return beside(pages, own, F.col(quoted(html_col)), [("text", "string"), ("n_chars", "long")], compute)
