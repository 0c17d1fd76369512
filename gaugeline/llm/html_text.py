"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is read once into blocks of text, each with the element that holds it. A linear classifier on tags, class and id words,
link density and length gives each block a cost for being called content and one for being called boilerplate; these are its
capacities from the source and to the sink. Blocks that follow each other, and blocks of the same container, are joined by
smoothness edges. The source side of the minimum cut, found by maximum flow, is the main text.

Character references are decoded, white space within a block becomes one space, and blocks are joined by a newline in page
order; nothing else is dropped or cut. Unclosed and misnested tags are closed as browsers would, as far as text goes.

Defined results: null and empty pages, and pages without content, give an empty text; a page of plain text without any
markup is one block and judged like any other; on a page where no block is worth anything by itself, the bias against blocks
is left out; a page of any length or depth takes time in proportion to it, but for the cut; among equal cuts the one with the
least text is taken; repeated rows each get the same answer; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as prose.
UNSEEN = frozenset("head title button select option optgroup datalist textarea label svg math object audio video canvas map iframe input progress meter".split())

# The classifier's lexicon and weights, in units of the smoothness edges below.
BAD_TAGS = frozenset("nav footer aside form dialog menu search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc toolbar topbar masthead header footer foot sidebar sidebars aside rail widget widgets related recommended recommendations trending "
    "comment comments commentlist reply replies respond discussion disqus share sharing social follow subscribe subscription newsletter signup login register search form copyright legal disclaimer skip outbrain taboola".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text prose".split())
#: Names of the element that holds the article, whatever stands around it.
MAIN_NAMES = frozenset("content main article main-content primary article-body article-content post-content post-body entry-content story-body".split())
BAD, ARTICLE, GOOD, PROSE, LENGTH, LINKS, BIAS = -9.0, 3.5, 1.5, 0.7, 1.3, -3.0, -0.5
NEXT, SIBLING = 0.3, 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<(?P<raw>script|style|noscript|template|xmp|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<odd>/?)(?P<oddname>[a-z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-z!?/][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
#: One attribute after the other: a name and its value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Element:
    """An open element: what its blocks inherit."""

    __slots__ = ("article", "bad", "cancelled", "cleared", "flag", "good", "known", "name", "parent", "unseen")

    def __init__(self, name: str, parent: Element | None) -> None:
        self.name, self.parent, self.cancelled = name, parent, False
        self.bad, self.unseen, self.article, self.good = (parent.bad, parent.unseen, parent.article, parent.good) if parent else (False, False, False, False)
        #: The nearest element at or above this whose class or id has a bad word.
        self.flag = parent.flag if parent else None
        #: Of an element with a bad word: how far those at or above it are cancelled (1: outside articles, 2: all).
        self.cleared = 0
        self.known: bool | None = None

    def flagged(self) -> bool:
        """Whether a bad word at or above this counts; asked when the whole page is read. Answers are kept, so deep pages take linear time."""
        way, e = [], self.flag
        while e is not None and e.known is None and e.cancelled:
            way.append(e)
            e = e.parent.flag if e.parent else None
        answer = e is not None and (not e.cancelled if e.known is None else e.known)
        for x in [*way, *([e] if e is not None else [])]:
            x.known = answer
        return answer

    def clear(self, everywhere: bool) -> None:
        """Cancel the bad words above, ``everywhere`` or outside articles."""
        level = 2 if everywhere else 1
        above, start = self.flag, self.flag
        while above is not None and above.cleared < level:
            above.cancelled |= everywhere or not above.article
            above = above.parent.flag if above.parent else None
        if start is not None:
            start.cleared = max(start.cleared, level)


def _opened(name: str, attributes: str, parent: Element) -> Element:
    e = Element(name, parent)
    words: set[str] = set()
    holds = name in ("article", "main")
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                for token in value.split():
                    holds |= token.lower() in MAIN_NAMES and (key == "id" or "-" in token)
                    parts = [w.lower() for w in _WORD.findall(token)]
                    if parts and parts[0] not in ("has", "with", "no", "without", "js", "is"):
                        words.update(parts)
            elif key == "role":
                e.bad |= value.lower() in BAD_ROLES
                holds |= value.lower() in ("main", "article")
            elif key == "style":
                e.unseen |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                e.unseen = True
    if name in UNSEEN:
        e.unseen = True
    if name in BAD_TAGS or (name == "header" and not parent.article):
        e.bad = True
    if parent.article:
        words.discard("header")  # an article's own header holds its title
    if words & BAD_WORDS and name not in ("html", "body", "main"):
        e.flag = e
    elif holds:
        # A wrapper around the article is no sidebar, whatever its name says.
        parent.clear(name == "main")
        e.article = True
    elif words & GOOD_WORDS:
        e.good = True
    return e


class Block:
    __slots__ = ("container", "element", "linked", "text")

    def __init__(self, text: str, element: Element, linked: int) -> None:
        self.text, self.element, self.linked = text, element, linked
        self.container = element.parent if element.name in BLOCK and element.parent else element

    def score(self) -> float:
        """Positive: the cost of calling it boilerplate; negative: of calling it content."""
        e = self.element
        if e.bad or e.flagged():
            return BAD
        n = len(self.text)
        prose = e.name in ("p", "blockquote", "pre") or e.name in HEADINGS
        return BIAS + ARTICLE * e.article + GOOD * e.good + PROSE * prose + LENGTH * min(1.0, n / 120) + LINKS * min(1.0, self.linked / n)


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order."""
    root = Element("html", None)
    stack, out = [root], []
    parts: list[str] = []  # of visible text since the last block began or ended
    linked, links = 0, 0
    #: Places of the open elements of each name, and of those that are blocks, so that no search walks over a deep page's elements.
    opened: dict[str, list[int]] = {"html": [0]}
    open_blocks = [0]

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                e = stack[open_blocks[-1]]
                while e.unseen and e.parent is not None:
                    e = e.parent
                out.append(Block(text, e, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e.name == "a"
            opened[e.name].pop()
        while open_blocks[-1] >= k:
            open_blocks.pop()
        del stack[k:]

    def open_above(names: tuple[str, ...], stop: tuple[str, ...]) -> int:
        """Place of the innermost open element of these names, if no element of the names ``stop`` is open inside it, else 0."""
        last = lambda some: max((opened[x][-1] for x in some if opened.get(x)), default=0)
        k = last(names)
        return k if k > last(stop) else 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if not stack[-1].unseen:
                parts.append(piece)
                if links:
                    linked += len(piece)
        at = m.end()
        name = m["name"] or m["oddname"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["odd"]:
            if name == "br":
                parts.append(" ")
                continue
            k = open_above((name,), ())
            if k:
                # An inline end tag doesn't close the blocks around it.
                if name not in BLOCK and open_blocks[-1] > k:
                    continue
                if open_blocks[-1] >= k:
                    flush()
                close(k)
            continue
        if name in VOID:
            if name == "br" or name == "img" or name == "input":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            if name in ("html", "body"):
                # Attributes of these count, but they never nest.
                if len(stack) > 1 and opened.get(name):
                    continue
                close(1 if name == "html" else len(opened["html"]))
            else:
                # A block ends an open paragraph; list items, cells and rows end those before them.
                k = open_above(("p",), ("table", "ul", "ol", "div", "section", "article", "aside", "main", "body", "td", "th", "li", "form", "nav", "header", "footer", "blockquote", "button"))
                if k:
                    close(k)
                if name == "li":
                    k = open_above(("li",), ("ul", "ol", "menu"))
                elif name in ("dt", "dd"):
                    k = open_above(("dt", "dd"), ("dl",))
                elif name in ("td", "th"):
                    k = open_above(("td", "th"), ("tr", "table"))
                elif name == "tr":
                    k = open_above(("tr",), ("table", "thead", "tbody", "tfoot"))
                elif name in HEADINGS and stack[-1].name in HEADINGS:
                    k = len(stack) - 1
                else:
                    k = 0
                if k:
                    close(k)
                if opened.get("head"):
                    close(opened["head"][0])
        elif name in UNSEEN and not stack[-1].unseen:
            # What isn't shown as prose stands between words; it ends no block.
            parts.append(" ")
        if name == "head" and (opened.get("head") or opened.get("body")):
            continue
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
        stack.append(_opened(name, m["attributes"] or "", stack[-1]))
        links += name == "a"
    if at < len(page) and not stack[-1].unseen:
        parts.append(page[at:])
    flush()
    return out


def source_side(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut by maximum flow with level graphs. Positive costs are capacities from the source, negative ones to the sink; edges
    (i, j, capacity) run both ways. True: the node is still reachable from the source, so it is on its side in every minimum cut."""
    n = len(costs)
    supply, demand = [max(0, c) for c in costs], [max(0, -c) for c in costs]
    graph: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        graph[i][j] = graph[i].get(j, 0) + c
        graph[j][i] = graph[j].get(i, 0) + c
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i]]
        for i in queue:
            level[i] = 0
        ends = False
        for i in queue:
            ends |= demand[i] > 0
            for j, c in graph[i].items():
                if c and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return [x >= 0 for x in level]
        rest = [list(g) for g in graph]
        for start in range(n):
            while supply[start]:
                path, i = [start], start
                while not demand[i]:
                    nearer = rest[i]
                    while nearer and not (graph[i][nearer[-1]] and level[nearer[-1]] == level[i] + 1):
                        nearer.pop()
                    if nearer:
                        i = nearer[-1]
                        path.append(i)
                    else:
                        path.pop()
                        if not path:
                            break
                        i = path[-1]
                        rest[i].pop()
                if not path:
                    break
                flow = min([supply[start], demand[i], *(graph[a][b] for a, b in zip(path, path[1:], strict=False))])
                supply[start] -= flow
                demand[i] -= flow
                for a, b in zip(path, path[1:], strict=False):
                    graph[a][b] -= flow
                    graph[b][a] += flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    scores = [b.score() for b in found]
    # Where no block stands out, none is held to have to.
    bias = 0.0 if any(x > 0 for x in scores) else BIAS
    costs = [round(1000 * (x if x == BAD else x - bias)) for x in scores]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, round(1000 * NEXT)))
        if (before := last.get(id(b.container))) is not None:
            edges.append((before, i, round(1000 * SIBLING)))
        last[id(b.container)] = i
    return "\n".join(b.text for b, content in zip(found, source_side(costs, edges), strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
