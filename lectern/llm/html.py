"""Main text of web pages by composite text density.

A page is read into a small DOM. Parts that are never article text (scripts, styles, menus, forms, site headers and footers,
sidebars, and elements whose class, id or role names them adverts, notices, comments and the like) count nothing. A class or id
names a part if one of its words does so and only words like `box` or `list` follow (`left-sidebar`, `comment-list`, but not
`notice-board`); inside an article it must also begin with that word, and words that an article's own parts may be called (`alert`, `search`,
`share` and the like, but not `share-buttons`) leave out only what is mostly short links. An article counts even if a box around it, other than one of comments,
has such a name. Every other
node has its characters, tags, link characters and link tags, from which its density: characters per tag, damped where much of
it is links. A node's density sum adds its children's densities; the node with the largest sum holds the main text. The
selection then climbs towards the body while the parent is at least as dense as the sparsest node on the way from the body
to the chosen node, and to an enclosing article, or down to the only one within. Where there is no article, lists and boxes that are mostly short links are left out.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two line breaks.

Defined cases: null or empty html, or a page without text, gives an empty text of 0 characters; broken nesting is closed the
way browsers do it for paragraphs and list items, and a tag cut off by the end of the page is dropped; repeated rows are
extracted each; whole pages are read whatever their length; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol optgroup option p pre section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "script style noscript template head title nav aside footer form button select textarea input label iframe object embed svg canvas"
    " audio video map menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name what is not the article.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner banners breadcrumb breadcrumbs cookie"
    " cookies consent gdpr footer header masthead menu menus modal nav navbar navigation newsletter notice notices overlay"
    " pager pagination popup promo promotion promoted recommend recommended recommendations related"
    " rail share sharing sidebar skip social sponsor sponsored sponsors subscribe subscription teaser toolbar tracking widget widgets"
    " login signup search alert disclaimer".split()
)
#: Of these, words that an article's own parts may be called; alone (not as in `share-buttons`) they leave out only what is a menu there, mostly links.
BESIDE = frozenset(
    "alert disclaimer login modal overlay pager pagination rail recommend recommended recommendations related search share sharing signup skip social teaser toolbar tracking widget widgets".split()
)
#: Words that may follow such a word, and those that make it one about the page's layout.
AFTER = frozenset("area articles bar block box buttons container form icons inner item items links list message notice panel posts row section slot thread top bottom left right unit widget wrap wrapper".split())
LAYOUT = frozenset("has with no is without".split())
#: A list or box whose characters are links to this share, of fewer characters than this on average, is a menu; entries of a list of references are longer.
MOSTLY_LINKS, SHORT_LINK = 0.6, 25
_CLOSES = {  # an opening tag closes an open one of these, up to the given boundary
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_CLOSES_P = BLOCK - frozenset("body html option optgroup tbody td tfoot th thead tr caption summary legend li dd dt".split()) | {"li", "dd", "dt"}
_BOUNDARY = frozenset("article body td th table div section li ul ol dl blockquote main aside form figure button object".split())
_RAW = "script|style|textarea|title|noscript|iframe|template|svg"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z|<[a-z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "never", "named", "comments", "beside", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, named: bool = False, comments: bool = False):
        """never: left out; named: only for a class or id; comments: those name it comments."""
        self.tag, self.parent, self.never, self.named, self.comments, self.beside, self.parts = tag, parent, never, named, comments, False, []


def _unwanted(tag: str, rest: str, inside_article: bool) -> str:
    """Why an element is left out: it is a `part` of its own, is `named` one, or holds `comments`; `beside` if it is one only where it is a menu; empty if it is not."""
    if tag in NEVER and not (inside_article and tag == "label"):
        return "part"
    if tag == "header":
        return "" if inside_article else "part"
    if not rest or rest.isspace() or tag in ("html", "body", "main"):
        return ""
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "part"
        if name == "role" and value.lower() in ROLES:
            return "part"
        if name in ("class", "id"):
            if any(_names_a_part(token, COMMENTS, inside_article) for token in value.split()):
                return "comments"
            parts = [token.lower() for token in value.split() if tag != "article" and _names_a_part(token, NAMES, inside_article)]
            if parts:
                return "beside" if inside_article and BESIDE.issuperset(parts) else "named"
    return ""


def _names_a_part(token: str, names: frozenset, inside_article: bool) -> bool:
    """Does a class or id say that the element is one of these parts?"""
    words = [w.lower() for w in _NAME_WORD.findall(token)]
    while len(words) > 1 and words[-1] in AFTER and words[-1] not in names:
        words.pop()
    if not words or words[-1] not in names or words[0] in LAYOUT:
        return False
    return not inside_article or words[-1] != "header" and all(w in NAMES for w in words)


def _of_comments(node: Node | None) -> bool:
    while node is not None:
        if node.comments:
            return True
        node = node.parent
    return False


def parse(html: str) -> Node:
    """The page's DOM; text parts are decoded."""
    root = Node("html", None)
    here, articles, at = root, 0, 0
    decode = entities.unescape

    for match in _TOKEN.finditer(html):
        if match.start() > at:
            here.parts.append(decode(html[at : match.start()]))
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            node = here
            while node is not None and node.tag != tag and not (tag not in BLOCK and node.tag in _BOUNDARY):
                node = node.parent
            if node is not None and node.tag == tag and node.parent is not None:
                while here is not node:
                    articles -= here.tag in ("article", "main")
                    here = here.parent
                articles -= tag in ("article", "main")
                here = node.parent
            continue
        if tag == "br" or tag == "hr":
            here.parts.append(" " if tag == "br" else Node("hr", here))
            continue
        if tag in VOID or tag in ("html", "body") and _has(here, tag):
            continue
        if tag in _CLOSES_P:
            here = _close(here, frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6")) if tag[0] == "h" and tag[1:].isdigit() else frozenset(("p",)), _BOUNDARY)
        if tag in _CLOSES:
            here = _close(here, *_CLOSES[tag])
        rest = match["rest"]
        why = _unwanted(tag, rest, articles > 0)
        beside, why = why == "beside", "" if why == "beside" else why
        node = Node(tag, here, here.never or bool(why), here.named if here.never else why in ("named", "comments"), why == "comments")
        node.beside = beside
        if tag in ("article", "main") and here.never and here.named and not why and not _of_comments(here):
            up = node  # an article within a box that only has a misleading name
            while up is not None and up.never:
                up.never = False
                up = up.parent
        here.parts.append(node)
        if not rest.endswith("/") or tag in BLOCK:
            here = node
            articles += tag in ("article", "main")
    if at < len(html):
        here.parts.append(decode(html[at:]))
    return root


def _has(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _close(here: Node, tags: frozenset, boundary: frozenset) -> Node:
    """The parent of the nearest open node of these tags, if none of the boundary stands before it."""
    node = here
    while node is not None and node.tag not in tags:
        if node.tag in boundary:
            return here
        node = node.parent
    return here if node is None else node.parent


def measure(root: Node) -> list[Node]:
    """Fills in every wanted node's counts, children first; returns the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.never)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part) - part.count(" ") if part.strip() else 0
            elif not part.never:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    whole = (root.link_chars + 1) / (root.chars + 1)
    for node in reversed(order):
        node.density = density(node, whole)
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node) and not p.never)
    return order


def density(node: Node, whole: float) -> float:
    """Composite text density: characters per tag times a logarithm whose base grows with the share of links."""
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars / plain * node.link_chars + whole * node.chars + math.e)
    return node.chars / tags * max(math.log(node.chars / links * tags / link_tags + 1), 0.0) / max(math.log(base + 1), 0.1)


def select(root: Node, order: list[Node]) -> Node:
    """The subtree with the largest density sum, climbed by the threshold of its path from the body."""
    best = max(order, key=lambda n: n.sum)  # the first in page order among equals
    if best.sum <= 0:
        return root
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in path[1:]:
        if node.tag in ("body", "html") or node.density <= threshold:
            break
        best = node
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    inside = [n for n in order if n.tag == "article" and _within(n, best)]
    return inside[0] if len(inside) == 1 else best


def _within(node: Node | None, top: Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def _is_menu(node: Node, in_article: bool) -> bool:
    """Is a list or box (in an article: one whose name says that it may be) a menu, mostly short links?"""
    if not (node.beside if in_article else node.tag in ("ul", "ol", "div", "section", "table") and node.link_tags > 1):
        return False
    return node.link_chars > MOSTLY_LINKS * node.chars and node.link_chars < SHORT_LINK * node.link_tags


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node, in page order; outside an article without what is mostly links."""
    whole = top.tag == "article"
    found: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            found.append(text)

    stack: list = [top]
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            run.append(part)
        elif part.never or part is not top and _is_menu(part, whole):
            end()
        else:
            inner = reversed(part.parts)
            if part.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(inner)
    end()
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    return "\n\n".join(blocks(select(root, measure(root))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    kept = pages.select(id_col, url_col, html_col)
    schema = T.StructType([*(kept.schema[c] for c in (id_col, url_col)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)
