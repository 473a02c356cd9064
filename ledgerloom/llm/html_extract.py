"""Main text of web pages from standard-library parser events.

The parser's events become a list of text blocks, each with its element and its lines: a line ends where the block or the source line does. Blocks of elements
that never hold the article (navigation, headers and footers of the page, asides, forms, notices, adverts, comments, scripts
and so on, by element, ARIA role or class and id words) are left out. Over the lines of the remaining blocks, text-to-tag ratios are smoothed with a Gaussian
and clustered at a threshold; the heaviest cluster says which container holds the content, and all blocks of that
container come out in page order, the short ones too. A marked ``article`` or ``main`` element whose text is a fair share of the page's is taken as
the container where half of the cluster lies in it or the cluster holds half of it; elsewhere the cluster alone decides. Every page with text goes this way, and
every step is linear in the page.

Defined results: null and empty pages, and pages without text, give an empty text of 0 characters; unclosed and stray tags are read as
browsers do (a paragraph ends where the next block starts); character references are decoded; one row for each input row, repeats too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown or never the article.
DROP = frozenset("script style noscript template head title nav aside footer button select option textarea iframe object svg canvas audio video dialog menu map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or an id that mark readers' comments, whatever the element.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|commentary-list|respond|replies|reply|disqus)(?:$|[\s_-]|\d)", re.I)
#: Words that mark page furniture, unless the element turns out to hold the article or most of the page.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promoted|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager"
    r"|sidebar|sidebars|aside|widget|widgets|footer|foot|masthead|topbar|toolbar|header|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|trending|popular|copyright|legal|skip|hidden|search|outbrain|taboola)(?:$|[\s_-]|\d)",
    re.I,
)
SPACE = re.compile(r"\s+")
SIGMA, SHARE, MOST = 1.5, 0.2, 0.6


class Node:
    """An element: ``drop`` if it never holds the article, ``soft`` if it is marked as furniture, ``main`` if as the article. ``home`` is the
    nearest block or furniture element round it, itself included. Parents have lower serials than their children."""

    __slots__ = ("tag", "parent", "drop", "serial", "main", "soft", "home")

    def __init__(self, tag: str, parent: Node | None, drop: bool, serial: int, main: bool, soft: bool = False):
        self.tag, self.parent, self.drop, self.serial, self.main, self.soft = tag, parent, drop, serial, main, soft
        self.home: Node = self if parent is None or tag in BLOCK or soft else parent.home


@dataclass
class Piece:
    """A text block, with (characters, tags since the line before) of each of its lines."""

    node: Node
    text: str
    lines: list[tuple[int, int]]


class Blocks(HTMLParser):
    """Collects the text blocks in page order. A block's lines end where the source breaks lines. Open elements are found by tag, so the work is
    linear in the page, however deep it is nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        root = Node("#root", None, False, 0, False)
        self.nodes, self.open = [root], [root]
        self.at: dict[str, list[int]] = {}  # tag -> places of its open elements in ``open``
        self.walls: list[int] = []  # places of open block elements
        self.blocks: list[Piece] = []
        self.text: list[str] = []
        self.lines: list[tuple[int, int]] = []
        self.chars, self.tags = 0, 0

    def end_line(self) -> None:
        if self.chars:
            self.lines.append((self.chars, self.tags))
            self.chars = self.tags = 0

    def flush(self) -> None:
        self.end_line()
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append(Piece(self.open[-1].home, text, self.lines))
        self.lines = []
        self.text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ENDS_P:
            self._close("p")
        elif tag in ("td", "th", "tr"):
            self._close(tag, within=("table",))
        if tag == "li":
            self._close("li", within=("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            self._close("dt", within=("dl",))
            self._close("dd", within=("dl",))
        elif tag == "option":
            self._close("option", within=("select",))
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
                if tag == "hr":
                    self.flush()
            return
        up, soft = self.open[-1], False
        drop = up.drop
        inside = bool(self.at.get("article") or self.at.get("main"))
        if not drop:
            drop = tag in DROP or (tag == "header" and not inside)
            a = dict(attrs)
            if not drop and tag not in ("html", "body"):
                words = f"{a.get('class') or ''} {a.get('id') or ''}"
                drop = bool(COMMENTS.search(words)) or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
                found = MARKS.search(words)
                # the head of an article is part of it
                soft = tag == "form" or (a.get("role") or "").lower() in ROLES or bool(found and not (inside and "head" in found[0].lower()))
                soft &= tag not in ("article", "main")
        if (drop and not up.drop) or soft:
            self.flush()
        node = Node(tag, up, drop, len(self.nodes), not drop and (tag in ("article", "main") or ("role", "main") in attrs), soft)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.walls.append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't close an element

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        """Close the nearest open ``tag``, unless an element of ``within`` lies between; an inline or paragraph end tag doesn't reach over a block."""
        places = self.at.get(tag)
        if not places:
            return
        place = places[-1]
        if any(self.at[w][-1] > place for w in within if self.at.get(w)):
            return
        if (tag == "p" or (tag not in BLOCK and tag not in DROP)) and self.walls and self.walls[-1] > place:
            return
        shut = self.open[place:]
        if any(n.tag in BLOCK or n.soft or n.drop != n.parent.drop for n in shut):
            self.flush()
        del self.open[place:]
        for n in shut:
            self.at[n.tag].pop()
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()

    def handle_data(self, data: str) -> None:
        if self.open[-1].drop:
            return
        self.text.append(data)
        first, *more = data.split("\n")
        self.chars += len(first.strip())
        for line in more:
            self.end_line()
            self.chars += len(line.strip())


def smooth(x: list[float], sigma: float = SIGMA) -> list[float]:
    r = int(3 * sigma)
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    n = len(x)
    out = []
    for i in range(n):
        lo, hi = max(0, i - r), min(n, i + r + 1)
        w = k[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(x[lo:hi], w, strict=True)) / sum(w))
    return out


def upwards(nodes: list[Node], own: dict[int, float]) -> list[float]:
    """For each element the sum over itself and all that is in it."""
    total = [0.0] * len(nodes)
    for s, w in own.items():
        total[s] += w
    for n in reversed(nodes[1:]):
        total[n.parent.serial] += total[n.serial]
    return total


def downwards(nodes: list[Node], own: set[int]) -> list[bool]:
    """For each element whether it or one round it is in ``own``."""
    out = [False] * len(nodes)
    for n in nodes:
        out[n.serial] = n.serial in own or (n.parent is not None and out[n.parent.serial])
    return out


def weights(blocks: list[Piece], of=lambda b: len(b.text)) -> dict[int, float]:
    own: dict[int, float] = {}
    for b in blocks:
        own[b.node.serial] = own.get(b.node.serial, 0) + of(b)
    return own


def content(blocks: list[Piece], nodes: list[Node]) -> list[Piece]:
    """Without the blocks of marked furniture. What is around the article or around most of the page is a wrapper, whatever its class says."""
    total = sum(len(b.text) for b in blocks)
    weight = upwards(nodes, weights(blocks))
    wraps = upwards(nodes, {n.serial: 1 for n in nodes if n.main and weight[n.serial]})
    gone = downwards(nodes, {n.serial for n in nodes if n.soft and not wraps[n.serial] and weight[n.serial] < MOST * total})
    return [b for b in blocks if not gone[b.node.serial]]


def cluster(ratios: list[float], sizes: list[int]) -> tuple[int, int]:
    """Range of lines: of the runs whose smoothed text-to-tag ratio reaches the threshold, the one with most text. The threshold is the ratios'
    standard deviation, or 0.8 of the highest where that is less."""
    x = smooth(ratios)
    mean = sum(x) / len(x)
    bar = min(math.sqrt(sum((r - mean) ** 2 for r in x) / len(x)), 0.8 * max(x))
    best, most, start, held = (0, 0), -1, None, 0
    for i, r in enumerate([*x, -1.0]):
        if r >= bar:
            start = i if start is None else start
            held += sizes[i]
        elif start is not None:
            if held > most:
                best, most = (start, i), held
            start, held = None, 0
    return best


def extract(html: str | None) -> str:
    """The main text of one page: blocks joined by one newline."""
    if not html:
        return ""
    p = Blocks()
    p.feed(html)
    p.close()
    p.flush()
    nodes = p.nodes
    blocks = content(p.blocks, nodes)
    if not blocks:
        return ""
    lines = [(k, chars, tags) for k, b in enumerate(blocks) for chars, tags in b.lines]
    lo, hi = cluster([c / max(1, t) for _, c, t in lines], [c for _, c, _ in lines])
    core: dict[int, int] = {}  # block -> characters of its lines in the cluster
    for k, c, _ in lines[lo:hi]:
        core[k] = core.get(k, 0) + c
    size = sum(core.values())
    own: dict[int, float] = {}
    for k, c in core.items():
        own[blocks[k].node.serial] = own.get(blocks[k].node.serial, 0) + c
    held = upwards(nodes, own)
    weight = upwards(nodes, weights(blocks))
    marked = [n for n in nodes if n.main and weight[n.serial]]
    if marked:
        # the innermost marked element that still holds most of what the marked elements hold
        best = max(weight[n.serial] for n in marked)
        node = [n for n in marked if weight[n.serial] >= 0.8 * best][-1]
        # it is the container if it is a fair share of the page, and half of the cluster lies in it or the cluster holds half of it
        if weight[node.serial] >= SHARE * weight[0] and 2 * held[node.serial] >= min(size, weight[node.serial]):
            return joined(blocks, nodes, node)
    # the innermost element that holds nearly all of the cluster
    node = [n for n in nodes if held[n.serial] >= 0.8 * size][-1]
    # a heading or paragraph beside the container belongs to it; other text beside it doesn't
    other = upwards(nodes, weights(blocks, lambda b: b.node.tag not in PROSE))
    while node.parent and other[node.parent.serial] == other[node.serial]:
        node = node.parent
    return joined(blocks, nodes, node)


def joined(blocks: list[Piece], nodes: list[Node], container: Node) -> str:
    inside = downwards(nodes, {container.serial})
    return "\n".join(b.text for b in blocks if inside[b.node.serial])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(src.dtypes)
    out = src.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
