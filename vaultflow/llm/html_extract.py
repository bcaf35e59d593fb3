"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags. The graph's nodes are the blocks and the elements
that hold them. Classifier costs are the terminal capacities, from the source where something looks like content, to
the sink where it looks like boilerplate: a block's cost comes from its own text alone (length, share of link text, sentence
end, kind of paragraph), an element's from what it says of itself (article, main, navigation; names in class, id and role),
times the blocks that it holds. Smoothness edges join each block to its element, each element to the one around it (DOM
proximity; weak where an element says what it is, since there the page itself draws a border), and blocks that follow each other
(adjacency). The minimum cut, found by maximum flow, labels all nodes at once; blocks on the source's side are the text. So
no single name decides: a heading of three words is text because an article holds it, a well-written advert is
none because its element outweighs its words, and an article stays one in a container with a doubtful name.

Defined cases: null or empty html gives an empty text; a comment, script or tag without an end runs to the end of
the page; a page without article or main is judged by its blocks alone; nothing is dropped for its
length; repeated pages are extracted alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+|[^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template svg iframe object canvas audio video title select textarea button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one of the same kind, and where looking for it stops.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}
#: Elements and roles that hold no text of the page, whatever is in them.
AWAY = frozenset("nav footer aside form menu dialog search".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form toolbar status".split())
#: Names of the same kind, names that may mean it, and names that speak for text.
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus gdpr nav navbar navigation newsletter outbrain pagination popup promo promotion related recommended replies respond sidebar signup skip sponsor sponsored subscribe taboola".split()
)
DOUBTFUL_NAMES = frozenset("byline discussion footer form header login masthead menu modal notice notices notification overlay pager reply search share sharing social toolbar widget widgets".split())
NEAR_NAMES = frozenset("article body content entry main post story text".split())
#: Costs of an element for each block in it.
IN_ARTICLE, IN_MAIN, NEAR, DOUBTFUL, AWAY_COST, HEADER, HIDDEN, OUTSIDE, PLAIN = 3.0, 2.5, 1.0, -3.0, -4.5, -2.5, -6.0, -2.0, 0.3
#: Costs of a block: for being one, up to so much for words, for link text, a sentence's end, a paragraph, a heading.
BLOCK, WORDS, LINKS, SENTENCE, PARAGRAPH, HEADING = -0.6, 1.2, -2.2, 0.4, 0.3, 0.2
FULL_WORDS = 15
#: Smoothness: a block and its element; for each block, an element and the one around it, and where it says what it is; neighbours of one
#: element, others. LOOSE takes the place of the first two at the root of a page without article or main, which says nothing.
HOLDS, AROUND, BORDER, SAME, NEXT, LOOSE = 3.0, 2.6, 0.15, 0.5, 0.1, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDING = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


class Element:
    """An open element and what holds for all text under it. node: the number of the next element around it that is in the graph."""

    __slots__ = ("tag", "block", "node", "link", "article", "main", "away")

    def __init__(self, tag, block, node, link, article, main, away):
        self.tag, self.block, self.node, self.link, self.article, self.main, self.away = tag, block, node, link, article, main, away


def says(tag: str, rest: str, above: Element) -> tuple[float, bool]:
    """What an element says of itself: a cost, and whether nothing in it can be text."""
    value, away = 0.0, False
    if tag == "article":
        value = IN_ARTICLE
    elif tag == "main":
        value = IN_MAIN
    elif tag in AWAY:
        value, away = AWAY_COST, True
    elif tag == "header" and not above.article:
        value = HEADER
    if "=" in rest or "hidden" in rest:
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, text = name.lower(), a or b or c
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                names = {x.lower() for x in NAME.findall(text)}
                if names & AWAY_NAMES:
                    value, away = min(value, AWAY_COST), True
                elif names & DOUBTFUL_NAMES:
                    value = min(value, DOUBTFUL) if tag != "article" else value
                elif names & NEAR_NAMES and not value:
                    value = NEAR
            elif name == "role":
                role = text.lower()
                if role in AWAY_ROLES:
                    value, away = AWAY_COST, True
                elif role in ("main", "article"):
                    value = max(value, IN_MAIN)
            elif name == "hidden" or (name == "aria-hidden" and text.lower() == "true") or (name == "style" and HIDING.search(text)):
                value, away = HIDDEN, True
    return value, away


class Page:
    """Blocks (text, tag, characters of links, element) in page order, and the elements (around it, cost, in article or main) of a page."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, int, int]] = []
        self.around, self.costs, self.framed = [0], [0.0], [False]
        self.stack = [Element("", True, 0, False, False, False, False)]
        #: Where each tag is open, and how often since the innermost block.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.inline: list[Counter] = [Counter()]
        self.read(html)

    def push(self, tag: str, rest: str) -> None:
        above, block = self.stack[-1], tag in BLOCKS
        value, away = says(tag, rest, above)
        if above.away:  # already no text: nothing in it speaks for text
            value = min(value, 0.0)
        article, main = above.article or tag == "article", above.main or tag == "main"
        node = above.node
        if block or value:
            node = len(self.around)
            self.around.append(above.node)
            self.costs.append(value)
            self.framed.append((article or main) and not (away or above.away))
        self.stack.append(Element(tag, block, node, above.link or tag == "a", article, main, above.away or away))
        self.open[tag].append(len(self.stack) - 1)
        if block:
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1

    def pop(self) -> str:
        e = self.stack.pop()
        self.open[e.tag].pop()
        if e.block:
            self.inline.pop()
        else:
            self.inline[-1][e.tag] -= 1
        return e.tag

    def close(self, tag: str) -> None:
        if self.open[tag] if tag in BLOCKS else self.inline[-1][tag]:
            while self.pop() != tag:
                pass

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, and an item the one before it."""
        if self.stack[-1].block:
            if self.stack[-1].tag == "p":
                self.pop()
        elif self.open["p"]:
            i = len(self.stack) - 1
            while not self.stack[i].block:
                i -= 1
            if self.stack[i].tag == "p":
                self.close("p")
        if tag in ENDS:
            same, stop = ENDS[tag]
            same = same.split()
            last = lambda tags: max(((self.open[x][-1], x) for x in tags if self.open[x]), default=(-1, ""))
            at, found = last(same)
            if at > last(stop)[0]:
                self.close(found)

    def read(self, html: str) -> None:
        parts: list[str] = []
        linked, at, where, find = 0, 0, self.stack[0], TOKEN.search

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((text, where.tag, linked, where.node))
                parts.clear()
            linked = 0

        blank = True
        while m := find(html, at):
            if m.start() > at:
                piece = html[at : m.start()]
                if blank and not piece.isspace():
                    where, blank = self.stack[-1], False
                parts.append(piece)
                if self.stack[-1].link:
                    linked += len(piece)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in DROPPED and not m[1]:
                if not (tag == "svg" and m[3].endswith("/")):
                    end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                    close = html.find(">", end.end()) if end else -1
                    at = len(html) if close < 0 else close + 1
            elif tag == "br":
                parts.append(" ")
            elif m[1] or tag in BLOCKS:
                if tag in BLOCKS:
                    flush()
                    blank = True
                if m[1]:
                    self.close(tag)
                elif tag != "hr":
                    self.close_implied(tag)
                    self.push(tag, m[3])
            elif tag not in VOID:
                self.push(tag, m[3])
        if at < len(html):
            where = self.stack[-1] if blank else where
            parts.append(html[at:])
        flush()


def text_cost(text: str, tag: str, linked: int) -> float:
    """A block's own cost, over 0 for content: it knows nothing of the page around it."""
    n = min(FULL_WORDS, len(WORD.findall(text[:400])))
    z = BLOCK + WORDS * n / FULL_WORDS + LINKS * min(1.0, linked / max(1, len(text)))
    if n >= 4 and ENDING.search(text[-12:]):
        z += SENTENCE
    return z + (PARAGRAPH if tag in ("p", "pre", "blockquote") else HEADING if tag in HEADINGS else 0.0)


def graph(page: Page) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal costs of the nodes, blocks first, and the smoothness edges."""
    n, around, said = len(page.blocks), page.around, page.costs
    held = [0] * len(around)
    for *_, e in page.blocks:
        held[e] += 1
    framed = any(f and held[e] for e, f in enumerate(page.framed))
    outside = sum(held[e] for e in range(len(around)) if not page.framed[e])
    for e in range(len(around) - 1, 0, -1):  # an element comes after the one around it
        held[around[e]] += held[e]
    costs = [text_cost(text, tag, linked) for text, tag, linked, _ in page.blocks]
    costs.append(OUTSIDE * outside if framed else PLAIN * n)
    number, edges = [n], []
    root = {n: LOOSE} if not framed else {}
    for e in range(1, len(around)):
        up = number[around[e]]
        if not held[e] or (not said[e] and held[e] == held[around[e]]):  # empty, or with nothing to say and alone in the one around it
            number.append(up)
            continue
        number.append(len(costs))
        costs.append(said[e] * held[e])
        edges.append((up, number[e], held[e] * (BORDER if said[e] else root.get(up, AROUND))))
    for i, (*_, e) in enumerate(page.blocks):
        edges.append((number[e], i, root.get(number[e], HOLDS)))
        if i:
            edges.append((i - 1, i, SAME if number[page.blocks[i - 1][3]] == number[e] else NEXT))
    return costs, edges


TINY = 1e-9


def source_side(costs: list[float], links: list[tuple[int, int, float]], blocks: int = 0) -> list[bool]:
    """Nodes on the source's side of the least minimum cut.

    Links that come from a node numbered ``blocks`` or more lead down a tree, in which a node's number is greater than that of the node above
    it but for those below ``blocks``. What the nodes have or lack is first pushed up the tree as far as the links hold, which meets most of it in
    one walk, however deep the tree is; what is left over is searched for.

    Flow through a node itself is already taken off, so a node has either supply or demand. In each phase a search from all
    supplies numbers the nodes by their distance, and flow is pushed along shortest paths until none is left; when no
    demand can be reached, the nodes that supplies still reach are the source's side."""
    n, left = len(costs), list(costs)
    to: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, w in links:
        to[a].append(len(head))
        head.append(b)
        room.append(w)
        to[b].append(len(head))
        head.append(a)
        room.append(w)
    up = {b: 2 * k for k, (a, b, _) in enumerate(links) if a >= blocks}
    for b in [*range(blocks), *range(n - 1, blocks - 1, -1)]:
        if b in up and left[b]:
            e = up[b]
            a, push = head[e ^ 1], min(abs(left[b]), room[e ^ 1] if left[b] > 0 else room[e])
            sign = push if left[b] > 0 else -push
            left[b] -= sign
            left[a] += sign
            room[e] += sign
            room[e ^ 1] -= sign
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if left[i] > TINY]
        for i in queue:
            far[i] = 0
        reached, end = False, n + 1
        for a in queue:  # grows
            if far[a] >= end:
                continue
            if left[a] < -TINY:
                reached, end = True, far[a]
                continue
            for e in to[a]:
                b = head[e]
                if far[b] < 0 and room[e] > TINY:
                    far[b] = far[a] + 1
                    queue.append(b)
        if not reached:
            return [x >= 0 for x in far]
        arc = [0] * n
        for s in range(n):
            path: list[int] = []
            a = s
            while left[s] > TINY and far[s] == 0:
                if left[a] < -TINY and path:
                    push = min(left[s], -left[a], min(room[e] for e in path))
                    left[s] -= push
                    left[a] += push
                    cut = len(path)
                    for i in range(len(path) - 1, -1, -1):
                        e = path[i]
                        room[e] -= push
                        room[e ^ 1] += push
                        if room[e] <= TINY:
                            cut = i
                    if cut == len(path) and left[a] < -TINY:
                        continue
                    # Go on from the tail of the first full edge, or one step back from a demand that is met.
                    cut = min(cut, len(path) - 1)
                    a = head[path[cut] ^ 1]
                    del path[cut:]
                    continue
                own = to[a]
                while arc[a] < len(own) and not (room[own[arc[a]]] > TINY and far[head[own[arc[a]]]] == far[a] + 1 and far[a] < end):
                    arc[a] += 1
                if arc[a] < len(own):
                    e = own[arc[a]]
                    path.append(e)
                    a = head[e]
                elif path:
                    far[a] = n + 2  # a dead end in this phase
                    a = head[path.pop() ^ 1]
                else:
                    break


def labels(page: Page) -> list[bool]:
    """Which blocks are content."""
    return source_side(*graph(page), len(page.blocks))[: len(page.blocks)]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    return "\n\n".join(b[0] for b, content in zip(page.blocks, labels(page), strict=True) if content)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars); narrow: pages never meet."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
