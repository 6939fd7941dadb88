"""Main text of web pages by composite text density.

Every DOM node gets the characters and tags of its subtree and of the links in it. Its density is characters per tag,
damped by a logarithm that grows with the share of link text:

    density = C / T * log(C / LC * T / LT) / log(C / (C - LC) * LC + LCb / Cb * C + e)

with LCb and Cb of the body, and zeros counted as one. The density sum of a node adds the densities of its children. The
node with the greatest sum is the core of the article; the least density on the path from the body to it is the
threshold. The text is that of the highest node in which a part that holds the core has a neighbour with a node over the
threshold; an article element with most of the page's text outside links is as far up as it goes. In the node, parts below the
threshold that consist of links are left out. Elements that are no article by their tag or name are set aside before anything is
measured; tag and name count for nothing on an element with most of the page's text outside links, unless an article element stands
elsewhere, and names that also occur in prose count for nothing on an element with prose.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import map_rows

#: Element names with a meaning in this operator.
SKIPPED = frozenset("script style noscript template title iframe object embed svg canvas math audio video select textarea button input option datalist".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CLOSED_BY_PEER = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id and role that name what is no article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar sidebar aside rail widget related recommended recommendations share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus replies respond form search toolbar complementary contentinfo skip".split()
)
#: Those of them that also name parts of articles.
WEAK_WORDS = frozenset("share sharing social search form rail widget promotion header banner alert replies related menu".split())
#: Characters outside links from which an element has prose.
PROSE = 140
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLE_TAGS = frozenset("article main body html".split())
_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_OPEN_TAG = re.compile("<[A-Za-z/!?]")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "chrome", "named", "weak", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, hidden: bool, parent: Node | None, named: bool = False, weak: bool = False):
        self.tag, self.chrome, self.parent, self.named, self.weak = tag, hidden or named, parent, named, weak
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in ARTICLE_TAGS:
        return False
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def chrome_names(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """Its tag, and the words of its class, id and role, that say that an element is no part of an article."""
    if tag in ARTICLE_TAGS:
        return set()
    words = {w for key, value in attrs if key in ("class", "id", "role") and value for w in _NAME.split(value.lower())}
    return (words & CHROME_WORDS) | ({tag} & CHROME)


class Tree(HTMLParser):
    """Builds the tree of one page; closes what HTML lets authors leave open. ``through``: names to skip whose tags alone go."""

    def __init__(self, through: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", False, None)
        self.skip: str | None = None
        self.through = through
        self.depth = 0
        self.any_named = False
        self.opened: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.skip:
            self.depth += tag == self.skip
            return
        if tag in SKIPPED:
            if tag not in VOID and tag not in self.through:
                self.skip, self.depth = tag, 1
            return
        if tag in ("html", "head", "body"):
            if tag == "body" and self.at is self.root:
                self.open(tag, attrs)
            return
        if tag in CLOSES_P:
            self.end("p", BLOCKS - {"p"})
        if tag in CLOSED_BY_PEER:
            for peer in CLOSED_BY_PEER[tag]:
                self.end(peer, frozenset(("ul", "ol", "dl", "table", "div", "article", "section")))
        if tag in VOID:
            self.at.children.append(Node(tag, False, self.at))
        else:
            self.open(tag, attrs)

    def open(self, tag: str, attrs) -> None:
        hidden, names = is_hidden(tag, attrs), chrome_names(tag, attrs)
        node = Node(tag, hidden, self.at, bool(names) and not hidden, bool(names) and names <= WEAK_WORDS and tag not in CHROME)
        self.any_named |= node.named
        self.at.children.append(node)
        self.at = node
        self.opened[tag] += 1

    def end(self, tag: str, stop: frozenset[str]) -> None:
        """Closes the nearest open ``tag`` unless an element of ``stop`` stands between."""
        if not self.opened[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        while self.at is not node.parent:
            self.opened[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                self.skip = self.skip if self.depth else None
            return
        if tag in VOID or tag in ("html", "head", "body"):
            return
        self.end(tag, frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.at.children.append(data)


def in_order(root: Node) -> list[Node]:
    """Nodes of a tree, parents first; no recursion, so depth is no limit."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.chrome]
    return out


def spare(root: Node) -> None:
    """Takes names off elements with most of the text outside links, and tags too if that is prose, unless an article element with
    text stands elsewhere; and weak names off elements with prose."""
    clear = not any(n.tag in ("article", "main") and any(isinstance(c, Node) or c.strip() for c in n.children) for n in in_order(root))
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.tag != "a" and (c.named or not c.chrome)]
    size: dict[int, int] = {}
    for node in reversed(nodes):
        size[id(node)] = sum(sum(map(len, c.split())) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
    for node in nodes:
        prose = size[id(node)] >= PROSE
        if node.named and (clear and 2 * size[id(node)] > size[id(root)] and (prose or node.tag not in CHROME) or node.weak and prose):
            node.chrome = False


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of the nodes that are left once chrome is set aside."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += sum(map(len, c.split()))
            elif not c.chrome:
                node.chars += c.chars
                node.tags += 1 + c.tags
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += 1 + c.link_tags if c.tag == "a" else c.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, t, lc, lt = max(1, node.chars), max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        node.density = 0.0 if not node.chars else c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.chrome)
    return nodes


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree to take, and the density under which link lists inside it are no content."""
    nodes = measure(root)
    core = max(nodes, key=lambda n: n.total)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    dense: dict[int, bool] = {}
    for n in reversed(nodes):
        dense[id(n)] = n.link_chars * 2 < n.chars and (n.density >= least or n.tag in HEADINGS or any(isinstance(c, Node) and dense.get(id(c), False) for c in n.children))
    top = core
    for part in path[:-1]:
        if part.tag in ("article", "main") and 2 * (part.chars - part.link_chars) > root.chars - root.link_chars:
            break
        if any(isinstance(c, Node) and not c.chrome and c is not part and dense[id(c)] or isinstance(c, str) and c.strip() for c in part.parent.children):
            top = part.parent
    return top, least


def text_of(node: Node, least: float) -> str:
    """Text of the subtree: inline tags join, blocks and breaks part, white space runs are one space."""
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.chrome and not (c is not node and c.tag in ("ul", "ol", "div", "section", "table") and c.chars and c.density < least and c.link_chars * 2 > c.chars):
            edge = " " if c.tag in BLOCKS else ""
            parts.append(edge)
            todo.append(edge)
            todo += reversed(c.children)
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_text(html: str | None) -> str:
    """Main text of one page; a null or empty page, or one without text, gives an empty string."""
    if not html:
        return ""
    cut = _OPEN_TAG.search(html, html.rfind(">") + 1)  # a tag that never ends is none, and the parser would try it again and again
    tree = Tree()
    while True:
        tree.feed(html[: cut.start()] if cut else html)
        tree.close()
        if not tree.skip or tree.skip in tree.through:
            break
        tree = Tree(tree.through | {tree.skip})  # an element that never ends holds nothing back
    if tree.any_named:
        spare(tree.root)
    node, least = main_node(tree.root)
    return text_of(node, least)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    One row per row of ``pages``; only page_id, url and html are read, so extra columns never clash. Null and empty pages
    give an empty text, an empty table an empty table, repeated rows equal rows. Equally dense subtrees are decided by
    page order. Deep and very long pages are read whole and without recursion.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield {"page_id": b["page_id"].to_pylist(), "url": b["url"].to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, SCHEMA)
