"""Main text of web pages by composite text density.

A tolerant reader builds a tree: raw-text elements end at their own end tag only, void
elements have no children, a paragraph, list item or cell ends where HTML lets its end
tag be left out, and stray end tags are ignored.  Elements that never belong to an
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments), known by tag, role, class or id, are left out of the tree.  A class or id
speaks by its last part, words of place aside, and not after "has", "with", "no" and the
like.  What it names stays nevertheless where no article or main element stands outside what
is left out and it holds one, or more than half of the body's text (adverts, notices,
comments and menus don't stay by that).

For every block and link ``density`` is its characters per tag, adjusted by its links: with C
characters, T tags, LC link characters, LT link tags and Cb, LCb those of the body,
``C / T * log(C * T / (LC * LT)) / log(ln(C * LC / (C - LC) + C * LCb / Cb + e))``.  Counts of
zero are taken as one where they divide; a node that is all link has density zero, and neither
logarithm counts for less than one and zero tags for less than one, so that short blocks
have a positive density.  Tags are those of blocks and links below the node and the node's own;
bold words and the like say nothing about a page's parts.  What is left out of the article
counts as well, as it is menus and footers that tell a body's density from an article's.

A node's sum is that of its blocks' densities; the node with the largest sum, of those that are
not left out, holds the text.  The least density on its path up to the body is the threshold.
On every step of that path a neighbour belongs to the text if it reaches the threshold; below
the body's own children it does as well if links are less than half of it, since what stands
beside the text inside its frame is a heading, a lead or a note.

Inside the chosen nodes nothing is dropped.  Character references are decoded, white space in a
block becomes one space, blocks are joined by an empty line in page order.  Null and
empty pages give an empty text, and so do pages without words.  Repeated rows give equal
rows; nulls in other columns stay; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import batches

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select article section div body html".split())
#: What never belongs to an article: what no reader sees as text, and parts of a page.
UNSEEN = frozenset("head script style noscript template iframe object embed svg canvas select textarea input title noembed noframes".split())
LEFT_OUT = UNSEEN | frozenset("nav header footer aside form button label menu dialog".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
LEFT_OUT_NAMES = re.compile(
    r"(?<!\S)(?!(?:\S*[_-])?(?:has|with|without|no|not|is|hide|show|toggle)[_-])(?:\S*[_-])?"
    r"(?P<what>ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|side-?bar|footer|header|masthead|cookies?|consent|notice|notification|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|comments?|disqus|replies|respond|pagination|pager|widget|toolbar)"
    r"(?:[_-](?:left|right|top|bottom|inner|outer|wrap|wrapper|container|box|bar|block|area|section|panel|slot|unit|list|items?|links?|buttons?|posts?|articles?|form|[0-9]+))*(?!\S)",
    re.I,
)
#: Of these, what isn't an article even where it is most of a page's text.
NEVER = re.compile(r"ad|sponsor|promo|cookie|consent|gdpr|comment|disqus|repl|newsletter|subscribe|breadcrumb|pag|menu|nav", re.I)
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; ``out``: not part of any article, ``unseen``: not even text."""

    __slots__ = ("children", "chars", "density", "link_chars", "links", "named", "out", "never", "parent", "tag", "tags", "total", "unseen")

    def __init__(self, tag: str, parent: Node | None, out: bool, unseen: bool = False) -> None:
        self.tag, self.parent, self.out, self.unseen, self.named, self.never = tag, parent, out, unseen, False, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def _left_out(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is left out whatever it holds, whether nobody sees it, whether its class or id speaks against it, and by a name of ``NEVER``."""
    if tag in LEFT_OUT:
        return True, tag in UNSEEN, False, False
    out = named = never = False
    frame = tag in ("body", "html", "article", "main")
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden":
            return True, True, False, False
        out = out or not frame and (name == "role" and value.strip().lower() in LEFT_OUT_ROLES or name == "aria-hidden" and value == "true")
        said = LEFT_OUT_NAMES.search(value) if not frame and name in ("class", "id") else None
        named, never = named or said is not None, never or said is not None and NEVER.match(said["what"]) is not None
    return out, False, named, never


def _size(text: str) -> int:
    return len(" ".join(text.split()))


def _prune(root: Node) -> None:
    """Leave out what class or id names, but for what holds the page's article."""
    order = [(root, False)]  # nodes, and whether a name above or their own speaks against them
    for node, named in order:
        order.extend((c, named or c.named) for c in node.children if isinstance(c, Node) and not c.out)
    if not any(node.named for node, _ in order):
        return
    holds = {}
    body = next((node for node, _ in order if node.tag == "body"), root)
    for node, _ in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and not c.out]
        node.chars = sum(c.chars for c in inside) + sum(_size(c) for c in node.children if isinstance(c, str))
        holds[node] = node.tag in ("article", "main") or any(holds[c] for c in inside)
    if any(node.tag in ("article", "main") and not named for node, named in order):
        stays = set()
    else:
        stays = {node for node, _ in order if node.named and (holds[node] or not node.never and 2 * node.chars > body.chars)}
    left = [node for node, _ in order if node.named and node not in stays]
    for node in left:  # with all below
        node.out = True
        left.extend(c for c in node.children if isinstance(c, Node) and not c.out)


def tree(page: str) -> Node:
    """The page's nodes; ``out`` marks what an article never holds, and all below it."""
    root = Node("html", None, False)
    at, here = 0, root

    def close(tags: set[str], stop: frozenset[str]) -> None:
        """Leave the innermost open element of these tags, unless one of ``stop`` is open inside it."""
        nonlocal here
        node = here
        while node is not root and node.tag not in tags:
            if node.tag in stop:
                return
            node = node.parent
        if node is not root:
            here = node.parent

    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text and not here.unseen:
            here.children.append(text)
        if not found:
            break
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            close({tag}, frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in ("html", "body") and any(True for _ in _open(here, tag)):
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, SCOPES)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], frozenset("ul ol dl table select".split()))
        out, unseen, named, never = _left_out(tag, found[3])
        node = Node(tag, here, here.out or out, here.unseen or unseen)
        node.named, node.never = named, never
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not node.unseen:
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            here = node
    _prune(root)
    return root


def _open(node: Node | None, tag: str) -> Iterator[Node]:
    while node is not None:
        if node.tag == tag and node.parent is not None:
            yield node
        node = node.parent


def _seen(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.unseen]


def _measure(root: Node) -> Node:
    """Characters, tags, links and densities of all nodes; gives the body."""
    order, body = [root], root
    for node in order:
        if node.tag == "body" and body is root:
            body = node
        order.extend(_seen(node))
    for node in reversed(order):
        inside, link = _seen(node), node.tag == "a"
        node.chars = sum(c.chars for c in inside) + sum(_size(references.unescape(c)) for c in node.children if isinstance(c, str))
        node.tags = sum(c.tags for c in inside) + (link or node.tag in BLOCK)
        node.links = sum(c.links for c in inside) + link
        node.link_chars = node.chars if link else sum(c.link_chars for c in inside)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.links
        if lc < c:
            base = math.log(c * lc / (c - lc) + c * share + math.e)
            node.density = c / t * max(math.log(c * t / (max(lc, 1) * max(lt, 1))), 1.0) / max(math.log(base), 1.0)
    for node in reversed(order):
        if node.tag in BLOCK and node.parent is not None:
            above = node.parent
            while above.parent is not None and above.tag not in BLOCK:  # a block inside an inline element is its block's
                above = above.parent
            above.total += node.density
    return body


def _chosen(body: Node) -> list[Node]:
    """Nodes whose whole text is the main text, in page order."""
    best, queue = body, [body]
    for node in queue:
        if not node.out:
            best = node if node.total > best.total else best
            queue.extend(c for c in _seen(node) if c.tag in BLOCK or c.children)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    kept = [best]
    for node, above in zip(path, path[1:], strict=False):
        inside = [c for c in above.children if isinstance(c, str) and above is not body or isinstance(c, Node) and not c.out]
        belongs = lambda c, above=above: isinstance(c, str) or c.density > 0 and c.density >= threshold or above is not body and (2 * c.link_chars < c.chars or not c.chars)
        at = inside.index(node)
        kept = [c for c in inside[:at] if belongs(c)] + kept + [c for c in inside[at + 1 :] if belongs(c)]
    return kept


def _blocks(nodes: list[Node | str]) -> Iterator[str]:
    """Text of the nodes, cut at block elements."""
    held: list[str] = []
    stack: list[Node | str | None] = []
    for node in nodes:
        stack = [None, node]
        while stack:
            item = stack.pop()
            if item is None:
                text = " ".join("".join(held).split())
                held = []
                if text:
                    yield text
            elif isinstance(item, str):
                held.append(references.unescape(item))
            elif not item.out:
                inside: list[Node | str | None] = list(reversed(item.children))
                if item.tag == "br":
                    held.append(" ")
                elif item.tag in BLOCK:
                    stack.append(None)
                    stack.extend(inside)
                    stack.append(None)
                else:
                    stack.extend(inside)
    text = " ".join("".join(held).split())
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page or page.isspace():
        return ""
    return "\n\n".join(_blocks(_chosen(_measure(tree(page)))))


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, column="html"):
        texts = [main_text(x) for x in frame["html"]]
        yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(x) for x in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInPandas(_run, "page_id long, url string, text string, n_chars long")
