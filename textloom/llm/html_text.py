"""Main text of web pages by composite text density (operator 3).

A tolerant parser builds the element tree. Every element has its characters, tags, link
characters and link tags; its density is characters per tag, scaled by a logarithm that falls
with the share of links. The element with the largest sum of its children's densities holds
the article. The smallest density on the path from it to the body is the threshold: the
choice climbs to an enclosing article or main element, or to a parent with like siblings,
while what it takes in reaches the threshold.

Defined results: null, empty and tag-less pages give the text that they show, "" if none.
Unclosed tags end with their parent. Nothing within the article is dropped or cut but menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. Menus
and the like are known by their element or by whole class names, and never are what holds most
of the page's text; names that may be a subject (share, social, notice) count only for what is no
prose. Among equal sums the first element in page order holds the article. Repeated rows each give
their row. Time and memory are in proportion to the page, at any depth. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame

from textloom.llm.common import map_texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "xmp")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of the article's text.
DROPPED = set("script style textarea title noscript template iframe noembed xmp head nav header footer aside form button select input option menu dialog svg canvas object audio video map search".split())
#: Words in class, id and role that mark what is not the article: alone, at the end of a name, or with places.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead comment comments reply replies disqus "
    "cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login toolbar pagination pager complementary contentinfo hidden".split()
)
#: Words that may as well name a subject: marks only alone or with places, and only of what is no prose.
LOOSE = set("side aside share sharing social related recommended recommendations tags search skip notice notices alert widget respond discussion".split())
#: Characters outside links from which on a loosely marked element is prose.
PROSE = 400
#: Parts of a name that say where or in what a marked element is; parts that turn a mark round.
PLACES = set("site page post main top bottom left right primary secondary global mobile desktop inner outer container wrapper wrap box list bar area block section content links link items item buttons button icons icon posts articles slot unit form thread body title text group row col column panel zone".split())
TURNED = set("has no with without not".split())
#: An opening tag ends an open element of these kinds, up to the kinds that hold them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
HOLDS = set("table td th caption button object div section article main aside nav header footer form ul ol dl blockquote body html li dd dt figure".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[a-z0-9]+")


@functools.lru_cache(20_000)
def mark(name: str) -> int:
    """2 if a class, id or role is a mark, 1 if a loose one, else 0."""
    parts = PART.findall(name)
    if not parts or TURNED & set(parts):
        return 0
    placed = all(x in MARKS or x in LOOSE or x in PLACES or x.isdigit() for x in parts)
    if parts[-1] in MARKS or placed and MARKS & set(parts):
        return 2
    return int(placed and bool(LOOSE & set(parts)))


class Node:
    __slots__ = ("articles", "chars", "children", "density", "depth", "dropped", "free", "key", "link_chars", "link_tags", "mains", "marked", "paragraph", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.marked = 0
        self.key = ""
        self.depth = parent.depth + 1 if parent else 0
        #: The open paragraph that a block would end.
        self.paragraph = self if tag == "p" else parent.paragraph if parent and tag not in HOLDS else None
        self.dropped = tag in DROPPED or bool(parent and parent.dropped)
        if attributes and not self.dropped:
            for name, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'").lower()
                name = name.lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    self.dropped = True
                elif name == "class":
                    self.key = value
                if name in ("class", "id", "role"):
                    self.marked = 0 if tag in ("body", "html", "article", "main") else max(self.marked, *map(mark, value.split()), 0)


def parse(page: str) -> Node:
    """The element tree: children are elements and strings (decoded)."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    open_: defaultdict[str, list[Node]] = defaultdict(list)  # of each tag, the outermost first

    def close(up: Node) -> Node:
        """End all open elements up to this one."""
        n = here
        while n is not up.parent:
            open_[n.tag].pop()
            n = n.parent
        return n

    def text(piece: str) -> None:
        if piece and not here.dropped:
            here.children.append(unescape(piece) if "&" in piece else piece)

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if open_[tag]:
                here = close(open_[tag][-1])
            continue
        if tag in RAW:
            if at < end:
                at = RAW[tag].search(page, at).end()
            continue
        if tag in BLOCK and here.paragraph:
            here = close(here.paragraph)
        if tag in ENDS:
            kinds, holders = ENDS[tag]
            near = max((open_[k][-1] for k in kinds | holders if open_[k]), key=lambda n: n.depth, default=root)
            if near.tag in kinds:
                here = close(near)
        node = Node(tag, here, m[3] or m[6] or "")
        here.children.append(node)
        if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            here = node
            open_[tag].append(node)
    text(page[at:])
    drop_marked(root)
    return root


def drop_marked(root: Node) -> None:
    """Drop marked elements, but none with most of the body's characters outside links, a main element or all articles, and no prose by a loose mark."""
    order = elements(root)
    if not any(n.marked for n in order):
        return
    for n in reversed(order):
        inside = [c for c in n.children if isinstance(c, Node) and not c.dropped]
        n.free = 0 if n.tag == "a" else sum(c.free for c in inside) + sum(sum(map(len, c.split())) for c in n.children if isinstance(c, str))
        n.mains = sum(c.mains for c in inside) + (n.tag == "main")
        n.articles = sum(c.articles for c in inside) + (n.tag == "article")
    body = next((n for n in order if n.tag == "body"), root)
    for n in order:
        if n.parent and n.parent.dropped or n.marked and not (2 * n.free > body.free or n.mains or 0 < n.articles == root.articles or n.marked == 1 and n.free >= PROSE):
            n.dropped = True


def elements(root: Node) -> list[Node]:
    """Kept elements, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.dropped]
    return out


def weigh(root: Node) -> list[Node]:
    """Fill in counts, densities and sums."""
    order = elements(root)
    for n in reversed(order):
        link = n.tag == "a"
        for c in n.children:
            if isinstance(c, Node):
                if not c.dropped:
                    n.chars += c.chars
                    n.tags += c.tags + 1
                    n.link_chars += c.link_chars
                    n.link_tags += c.link_tags + (c.tag == "a")
            else:
                n.chars += sum(map(len, c.split()))
        if link:
            n.link_chars = n.chars
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in order:
        if not n.chars:
            continue
        free = max(1, n.chars - n.link_chars)
        base = math.log(n.chars / free * n.link_chars + share * n.chars + math.e)
        ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
        n.density = n.chars / max(1, n.tags) * (math.log(ratio) / math.log(base) if ratio > 1 and base > 1 else math.log(max(ratio, 1.0)))
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.dropped) or n.density * 0.999
    return order


def main_node(root: Node) -> Node:
    order = weigh(root)
    body = next((n for n in order if n.tag == "body"), root)
    inside = elements(body)
    loose = [n for n in inside if n.chars and n.tag in BLOCK or n in (body, root)]
    best = max(loose, key=lambda n: n.total)
    path = []
    up = best
    while up is not None:
        path.append(up)
        if up is body:
            break
        up = up.parent
    threshold = min(n.density for n in path)
    for n in path[1:]:
        if n.tag in ("article", "main") and n.density >= threshold:
            best = n
            if n.tag == "article":
                return best
    while best is not body and best.parent and best.parent is not root:
        like = [c for c in best.parent.children if isinstance(c, Node) and c is not best and not c.dropped and c.tag == best.tag and c.key == best.key and c.chars and c.density >= threshold]
        if not like or best.tag in ("article", "main"):
            break
        best = best.parent
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if s := " ".join("".join(run).split()):
                out.append(s)
            run.clear()

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif not n.dropped:
            block = n.tag in BLOCK
            if block or n.tag == "br":
                close()
            if block:
                todo.append(None)
            todo += reversed(n.children)
    close()
    return out


def extract_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    return "\n".join(blocks(main_node(parse(page))))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars of every page."""

    def run(ids, pages):
        texts = [extract_text(p) for p in pages]
        return {"page_id": ids, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(df, id_col, html_col, f"page_id {df.schema[id_col].dataType.simpleString()}, text string, n_chars long", run)


def extract_pages(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    from pyspark.sql import functions as F

    rows = df.select(F.struct("page_id", "url").alias("key"), "html")

    def run(ids, pages):
        texts = [extract_text(p) for p in pages]
        return {"page_id": [i["page_id"] for i in ids], "url": [i["url"] for i in ids], "text": texts, "n_chars": [len(t) for t in texts]}

    kind = df.schema["page_id"].dataType.simpleString()
    return map_texts(rows, "key", "html", f"page_id {kind}, url string, text string, n_chars long", run)
