"""Main text of web pages by composite text density.

A page is parsed, in time linear in its length, into a tree that tolerates missing end tags. Elements
that are no article text by their name, role or class (menus, headers, footers, adverts, forms,
comments and so on) are left out. A class that says so only in part (``social-security``) is a weak
sign: it yields where its element holds more text outside of links than all the rest of the page. For
each remaining node the composite text density is computed: characters per tag, divided
down where many of them stand in links compared with the page as a whole. The node whose children's
densities have the largest sum is the core of the article; the least density on its path to the body
is the threshold by which its neighbours are taken in as well. An ``article`` or ``main`` element around the core is taken whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
#: For pages whose quotes do not close.
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.S)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul br option".split())
#: Elements that are never article text.
OUT_TAGS = set("nav footer aside form button select input textarea head script style noscript template iframe object svg canvas menu dialog title".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion menu nav navbar navigation navi breadcrumb breadcrumbs sidebar side footer foot masthead topbar "
    "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe signup share sharing social related recommended popup modal overlay widget widgets toolbar "
    "pagination pager login search form header copyright legal".split()
)
#: Of readers' comments and of notices nothing is article text, however dense it is.
STRONG = set("comment comments disqus respond reply replies cookie cookies consent gdpr".split())
#: Words that say nothing of what an element holds; with OUT_WORDS alone they make a strong sign.
SHAPE = set("area bar block bottom box btn button buttons col column container global group head inner item items js left link links list main outer page panel post posts primary right row secondary section site slot top unit wrap wrapper zone".split())
CLOSES_P = BLOCK - {"br", "option"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
KEEP = {"html", "body", "article", "main"}


class Node:
    __slots__ = ("tag", "kids", "parent", "out", "weak", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, weak: bool = False):
        self.tag, self.parent, self.out, self.weak, self.kids = tag, parent, out or weak, weak, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def left_out(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is no article text, and whether a weak sign says so; ``inside``: within an article or main element."""
    if tag in OUT_TAGS or tag == "header" and not inside:
        return True, False
    if tag in KEEP or tag == "header" or "=" not in attributes and "hidden" not in attributes:
        return False, False
    weak = False
    for m in ATTRIBUTE.finditer(attributes):
        if m[5]:
            return True, False
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in OUT_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name in ("class", "id"):
            for word in value.split():
                parts = {x for x in re.split(r"[^a-z]+", word) if x}
                found = parts & OUT_WORDS
                if not found or inside and found <= {"header", "legal", "side"}:
                    continue
                if found & STRONG or parts <= OUT_WORDS | SHAPE:
                    return True, False
                weak = True
    return False, weak


class Open:
    """The open elements, with the places of each tag and of those that end others, so that no tag is looked for one by one."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}
        self.blocks, self.ends_p, self.walls = [], [], []

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(k)
        for held, tags in ((self.blocks, BLOCK), (self.ends_p, ENDS_P), (self.walls, WALLS)):
            if node.tag in tags:
                held.append(k)

    def cut(self, k: int) -> None:
        """Closes the element at place k and all within it."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()
        for held in (self.blocks, self.ends_p, self.walls):
            while held and held[-1] >= k:
                held.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


ENDS_P, WALLS = CLOSES_P - {"p"} | {"button"}, {"article", "main", "body", "table"}


def tree(page: str) -> Node:
    root = Node("html", None)
    stack = Open(root)
    pos, n, last, tags = 0, len(page), page.rfind(">"), TAG

    def text(s: str) -> None:
        if s:
            stack.nodes[-1].kids.append(s)

    while pos < n:
        at = page.find("<", pos)
        if at < 0 or at > last and not page.startswith("<!--", at):
            text(page[pos:])
            break
        text(page[pos:at])
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            stop = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(stop, at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            pos = page.find(">", at) + 1
            continue
        m = tags.match(page, at)
        if not m and tags is TAG and page[at + 1 : at + 2] in LETTERS:
            tags = PLAIN  # the rest of the page has a quote that does not close
            m = tags.match(page, at)
        if not m:
            text("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            k = stack.last(tag)
            wall = next((w for w in reversed(stack.walls) if w != k), 0) if tag not in CROSSES else 0
            if k and k >= wall:
                stack.cut(k)
            elif not k and tag == "p":
                stack.nodes[-1].kids.append(Node("p", stack.nodes[-1]))
            continue
        if tag == "html" or tag == "body" and stack.at.get("body"):
            continue
        if tag in CLOSES_P:
            k = stack.last("p")
            if k and k > (stack.ends_p[-1] if stack.ends_p else 0):
                stack.cut(k)
        if tag in ("article", "main", "footer", "body"):  # these never stand in what such an unclosed element began
            first = [stack.at[t][0] for t in ("nav", "head", "ul", "ol") if stack.at.get(t)]
            if first:
                stack.cut(min(first))
        if tag in SAME:
            k = stack.last(*SAME[tag])
            if k and k > stack.last(*(STOP[tag] - SAME[tag])):
                stack.cut(k)
        if tag == "a":
            k = stack.last("a")
            if k and k > (stack.blocks[-1] if stack.blocks else 0):
                stack.cut(k)
        inside = bool(stack.at.get("article") or stack.at.get("main"))
        node = Node(tag, stack.nodes[-1], *left_out(tag, m[3] or "", inside))
        stack.nodes[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.push(node)
    return root


def settle_weak(root: Node) -> None:
    """Takes in the weakly marked elements that hold more text outside of links than all the rest of the page that is kept."""
    own: dict[int, int] = {}
    order, todo = [], [(root, False)]
    marked: list[Node] = []
    while todo:
        x, link = todo.pop()
        order.append(x)
        own[id(x)] = 0 if link else sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        if x.weak:
            marked.append(x)
        todo += [(k, link or k.tag == "a") for k in x.kids if isinstance(k, Node) and (not k.out or k.weak)]
    if not marked:
        return
    whole = dict(own)  # text of the element with all that is kept in it, weak or not
    for x in reversed(order):
        if x.parent is not None and id(x.parent) in whole:
            whole[id(x.parent)] += whole[id(x)]
    for x in marked:
        if 2 * whole[id(x)] > whole[id(root)]:
            x.out = False


LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: End tags that close their element whatever lies between.
CROSSES = {"html", "body", "article", "main", "div", "section"}


def measure(root: Node) -> list[Node]:
    """Fills in counts and densities; returns the kept nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and not k.out]
    order.reverse()
    for x in order:
        for k in x.kids:
            if isinstance(k, str):
                c = len(k) - k.count(" ") - k.count("\n")
                x.chars += c
                x.link_chars += c if x.tag == "a" else 0
            elif not k.out:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.chars if x.tag == "a" else k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
    body = order[-1]
    share = body.link_chars / max(1, body.chars)
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        if c:
            plain = max(1, c - x.link_chars)
            base = math.log(c / plain * lc + share * c + math.e)
            x.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.out) + sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    return order


def chosen(root: Node) -> Node:
    order = measure(root)
    core = max(reversed(order), key=lambda x: x.total)
    path, x = [], core
    while x is not None:
        path.append(x)
        x = x.parent
    if core.out:
        return core
    named = next((x for x in path if x.tag in ("article", "main")), None)
    if named is not None:
        return named
    while core.tag not in BLOCK - {"br", "p", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "dl", "tbody"} and core.parent is not None:
        core = core.parent
    threshold = min((x.density for x in path if x.chars), default=0.0)
    # Parents are taken as long as the core's siblings are as dense as the sparsest node of the path to the body.
    while core.parent is not None:
        rest = [k for k in core.parent.kids if isinstance(k, Node) and not k.out and k is not core and k.chars]
        if not all(k.density >= threshold or re.fullmatch("h[1-6]|p", k.tag) for k in rest):
            break
        core = core.parent
    return core


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space collapsed."""
    out, now = [], []

    def flush() -> None:
        s = " ".join(entities.unescape("".join(now)).split())
        if s:
            out.append(s)
        now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.out or x is node:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    if not page:
        return ""
    root = tree(page)
    settle_weak(root)
    return "\n".join(blocks(chosen(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; null page_id and url are passed on; repeated rows each give a row;
    other columns are ignored; an empty table gives no rows. Pages are parsed whole, in time linear in their length. A page
    that holds nothing but menus, notices, comments and the like has an empty text.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return src.mapInArrow(run, "page_id long, url string, text string")
