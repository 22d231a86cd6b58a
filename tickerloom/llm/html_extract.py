"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: An opening tag of the left kind ends an open element of the right kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that an implied end never crosses.
SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "thead", "tbody"}, "select": {"option"}}
NEVER = {
    "head", "nav", "footer", "aside", "form", "button", "select", "input", "svg", "canvas", "object", "menu", "dialog", "audio", "video", "map",
    "fieldset", "datalist", "applet",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Parts of class and id names of what is not the article.
UNWANTED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "newsletter", "subscribe", "subscription", "popup",
    "modal", "overlay", "paywall", "sidebar", "aside", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination",
    "pager", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond",
    "reply", "replies", "footer", "masthead", "toolbar", "login", "signup", "skip", "taboola", "outbrain", "tracking",
}
#: Parts of names that keep an element in spite of an unwanted part.
WANTED = {"article", "content", "main", "story", "entry", "post", "body", "text"}
#: Name parts that say nothing; inside a marked article a name counts as unwanted only if all its other parts are.
NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "container", "form", "group", "icon", "icons", "inline", "inner",
    "item", "items", "label", "left", "link", "links", "list", "module", "outer", "panel", "row", "right", "section", "slot", "thread", "top", "unit",
    "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "h2", "h3", "h4"}
LEAST_CHARS = 25


class Node:
    __slots__ = ("tag", "parent", "children", "out", "score", "chars", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out, self.children = tag, parent, out, []
        self.score, self.chars, self.linked, self.links = 0.0, 0, 0, 0


def _left_out(tag: str, rest: str, parent: Node) -> bool:
    """Whether an element is none of the article by its name, role, visibility, class or id."""
    if tag in NEVER:
        return True
    inside = parent
    while inside is not None and inside.tag not in ("article", "main"):
        inside = inside.parent
    if tag == "header" and inside is None:
        return True
    if not rest or tag in ("html", "body", "article", "main"):
        return False
    names: list[str] = []
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), html.unescape(a or b or c)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id"):
            names += value.split()
    for name in names:
        parts = [p.lower() for p in _PARTS.findall(name)]
        if inside is not None and any(p not in UNWANTED and p not in NEUTRAL and not p.isdigit() for p in parts):
            continue
        if UNWANTED.intersection(parts) and not (WANTED.intersection(parts) and not {"comment", "comments", "ad", "ads", "related"}.intersection(parts)):
            return True
    return False


def parse(page: str) -> Node:
    """A forgiving tree: unclosed and stray tags are mended as browsers commonly do; comments and raw elements leave no text."""
    root = node = Node("#root", None, False)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[:2] in ("<!", "<?") and len(piece) > 2:
                continue
            node.children.append(html.unescape(piece))
            continue
        tag = tag.lower()
        if m["close"]:
            open_node = node
            while open_node is not root and open_node.tag != tag:
                # The end of an inline element never closes a block.
                if tag in INLINE and open_node.tag not in INLINE:
                    open_node = root
                    break
                open_node = open_node.parent
            if open_node is not root:
                node = open_node.parent
            continue
        if tag in RAW:
            if not m["rest"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>|\Z", re.I).search(page, at)
                at = end.end()
            node.children.append(" " if tag not in INLINE else "")
            continue
        if tag not in INLINE and tag not in VOID:
            node = _implied(node, root, tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                node.children.append(" ")
            continue
        child = Node(tag, node, node.out or _left_out(tag, m["rest"], node))
        node.children.append(child)
        if not (m["rest"].endswith("/") and tag in ("svg", "path")):
            node = child
    return root


def _implied(node: Node, root: Node, tag: str) -> Node:
    """Close what an opening block closes: an open paragraph, or its own kind in lists and tables."""
    look = node
    while look is not root and look.tag in INLINE | {"p"}:
        if look.tag == "p":
            node = look.parent
            break
        look = look.parent
    if tag in ENDS:
        look = node
        while look is not root and tag not in SCOPE.get(look.tag, ()):
            if look.tag in ENDS[tag]:
                node = look.parent
            look = look.parent
    return node


def _measure(root: Node) -> list[Node]:
    """Characters, link characters and links of every node, children first; the nodes that are not left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.out]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.out:
                node.chars += c.chars
                node.linked += c.linked
                node.links += c.links
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += c.count(",") + c.count("，") + c.count("、")
            elif not c.out:
                stack.append(c)
    return total


def containers(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order; empty if nothing scores."""
    order = _measure(root)
    for node in order:
        loose = node.tag in ("div", "section", "article", "main", "body") and sum(len(c.strip()) for c in node.children if isinstance(c, str)) >= LEAST_CHARS
        if node.tag not in PARAGRAPHS and not loose or node.chars < LEAST_CHARS:
            continue
        if any(isinstance(c, Node) and not c.out and c.tag in PARAGRAPHS for c in node.children):
            continue
        points = (1 + min(node.chars / 100, 3) + _own_commas(node)) * (1 - _density(node))
        up, level = (node if loose else node.parent), 0
        while up is not None and up.tag != "#root":
            up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            up, level = up.parent, level + 1
    best = max((x for x in order if x.score > 0), key=lambda x: x.score * (1 - _density(x)), default=None)
    if best is None:
        best = next((x for x in order if x.tag in ("article", "main")), None) or next((x for x in order if x.tag == "body"), None)
        return [best] if best is not None else ([root] if root.chars else [])
    # An article element is the unit its author marked; the heading may stand beside the best container in it.
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    if whole is not None:
        best = whole
    if best.parent is None:
        return [best]
    nodes = [c for c in best.parent.children if isinstance(c, Node) and not c.out and c.chars]
    bar = 0.2 * best.score * (1 - _density(best))
    sure = [k for k, c in enumerate(nodes) if c is best or _belongs(c, bar)]
    # Between blocks that are kept everything is the article's, but for menus.
    return [c for k, c in enumerate(nodes) if k in sure or (sure[0] < k < sure[-1] and _density(c) < MENU)]


#: Share of link text from which a block is a menu; a block beside the container must stay below the other share.
MENU, MIXED = 0.5, 0.33


def _belongs(node: Node, bar: float) -> bool:
    """Whether a sibling of the best container is part of the article: a heading, a paragraph, or a block that scores at all.

    A block far below the container's score must be made of text without any link list.
    """
    dense = _density(node)
    if node.tag in HEADINGS or node.tag in PARAGRAPHS:
        return dense < MIXED
    return node.score * (1 - dense) >= bar or (node.score > 0 and dense < MIXED and node.links < 3)


def _render(node: Node, marked: bool, out: list[str]) -> None:
    """Text of a container without its left-out parts; blocks are set off by spaces."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.out:
            out.append(" ")
            continue
        # In a container that is not a marked article, lists and boxes made of links are menus.
        if not marked and x is not node and x.tag in ("ul", "ol", "div", "section", "table") and x.links >= 3 and _density(x) > 0.6:
            continue
        if x.tag in INLINE:
            stack += reversed(x.children)
        else:
            stack += [" ", *reversed(x.children), " "]


def main_text(page: str | None) -> str:
    """The article of a page: references decoded, white space single, blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    out: list[str] = []
    for node in containers(parse(page)):
        _render(node, node.tag in ("article", "main"), out)
        out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page from its whole html.

    A null or empty page, and one without an article, has an empty text.  Null ids and urls are kept, repeated rows give a row
    each, an empty table gives none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
