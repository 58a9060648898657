"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements with their text blocks. Elements that are never part
of an article (menus, footers, forms, adverts, comments and the like) are left out; each
remaining block passes points for its length and commas to its ancestors, half to the parent
and a third of the rest with each level more, and less by the share of its text inside links.
The best container and those of its siblings that score well are kept, and all their blocks
joined in page order. Time grows with the length of a page, however deep or unclosed it is.

Defined cases: a null page is empty; a page without any element is one block; unclosed,
stray and misnested tags are closed by their surroundings; ties go to the earlier element.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import append_columns

_PLAIN = (
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
)
_TOKEN = re.compile(r"<!\[CDATA\[.*?\]\]>|" + _PLAIN, re.S)
_TOKEN_AFTER_CDATA = re.compile(_PLAIN, re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# fixed values: element names of HTML by their role
_RAW = {"script", "style", "textarea", "title", "template", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button",
}
_NEVER = {
    "head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "search", "svg", "math", "object",
    "canvas", "audio", "video", "datalist", "fieldset", "option", "optgroup", "map",
} | _RAW
_CLOSES_P = _BLOCK - {"option", "button", "html", "body", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
_CLOSED_BY = {  # an open element on the left ends where one on the right begins
    "p": _CLOSES_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
_CLOSES: dict[str, list[str]] = {}  # the other way round: what an element that begins ends
for _open, _next in _CLOSED_BY.items():
    for _tag in _next:
        _CLOSES.setdefault(_tag, []).append(_open)
_SCOPE = {"table", "article", "section", "main", "body", "html", "ul", "ol", "dl", "div", "td", "th"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_BAD = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "header", "login", "masthead",
    "menu", "menus", "modal", "nav", "navbar", "navigation", "navi", "newsletter", "notice", "notices", "notification",
    "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply",
    "respond", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "topbar", "widget", "widgets", "alert", "gdpr", "paywall",
}
_GOOD = {"article", "body", "content", "entry", "main", "post", "story", "text", "blog", "page"}
_KEEP = {"html", "body", "main", "article"}
_ASIDES = {"comment", "comments", "reply", "replies", "related", "promo", "promoted", "sponsored", "ad", "advert"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = _HEADINGS | {"p"}
_COMMA = re.compile("[,،、，]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "bad", "weight", "score", "passed", "order", "semantic", "inside", "held")

    def __init__(self, tag: str, parent: Node | None, order: int, bad: bool, weight: int, semantic: bool) -> None:
        self.tag, self.parent, self.order, self.bad, self.weight, self.semantic = tag, parent, order, bad, weight, semantic
        self.score = self.passed = 0.0  # points of its own blocks, and points passed up to it
        self.inside = parent is not None and (parent.semantic or parent.inside)
        self.held = False


def _judged(tag: str, attrs: str, parent: Node | None) -> tuple[bool, int, bool]:
    """Whether the element is no article text, its weight as a container, whether it is marked as the article."""
    values = {}
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            values.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    semantic = tag in ("article", "main") or values.get("role") in ("main", "article") or values.get("itemprop") == "articleBody"
    if tag in _NEVER:
        return True, 0, False
    names = f"{values.get('class', '')} {values.get('id', '')}"
    tokens = [[w.lower() for w in _WORDS.findall(part)] for part in names.split()]
    weight = 25 * any(w in _GOOD for part in tokens for w in part) + 50 * semantic
    if tag == "article" and any(w in _ASIDES for part in tokens for w in part):
        return True, 0, False
    if tag in _KEEP or semantic:
        return False, weight, semantic
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return True, 0, False
    if values.get("role") in _ROLES:
        return True, 0, False
    inside = parent is not None and (parent.semantic or parent.inside)
    if tag == "header":
        return not inside, weight, False
    bad = any(
        w in _BAD and not (k and part[k - 1] in ("with", "has", "no", "without")) for part in tokens for k, w in enumerate(part)
        if not (w == "header" and inside)
    )
    return bad, weight, False


def _parsed(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements in page order and the text blocks: element, text, characters inside links."""
    root = Node("#page", None, 0, False, 0, False)
    nodes, blocks = [root], []
    # the open elements, and for each the element that owns text in it; where each tag, a block and a scope are open
    stack, owners = [root], [root]
    places: dict[str, list[int]] = defaultdict(list)
    open_blocks, open_scopes = [0], [0]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((owners[-1], text, linked))
            pieces = []
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            value = html.unescape(raw) if "&" in raw else raw
            pieces.append(value)
            if places["a"]:
                linked += len(value.strip())

    def opened(node: Node) -> None:
        k = len(stack)
        stack.append(node)
        owners.append(node if node.tag in _BLOCK or node.bad else owners[-1])
        places[node.tag].append(k)
        if node.tag in _BLOCK:
            open_blocks.append(k)
        if node.tag in _SCOPE and node.tag not in _CLOSED_BY:
            open_scopes.append(k)

    def closed(k: int) -> None:
        """End all open elements from place ``k`` on, and links ended before them."""
        while len(stack) > k or stack[-1] is None:
            owners.pop()
            node = stack.pop()
            if node is not None:
                places[node.tag].pop()
        while open_blocks[-1] >= k:
            open_blocks.pop()
        while open_scopes[-1] >= k:
            open_scopes.pop()

    at, end = 0, len(page)
    tags_end, cdata_end = page.rfind(">") + 1, page.rfind("]]>")
    while at < end:
        m = (_TOKEN if at <= cdata_end else _TOKEN_AFTER_CDATA).search(page, at, tags_end) if at < tags_end else None
        if m is None:  # no tag ends here any more; a comment may begin
            k = page.find("<!--", at)
            text(page[at:] if k < 0 else page[at:k])
            break
        text(page[at : m.start()])
        at = m.end()
        if at == tags_end and m[0].startswith("<!--") and "-->" not in m[0][4:]:
            break
        if m["tag"] is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:-3])
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "br" or tag == "p" and not places["p"]:
                pieces.append(" ")
                continue
            k = places[tag][-1] if places[tag] else 0
            if k and (tag in _BLOCK or open_blocks[-1] < k):  # an inline end tag closes nothing outside its block
                if tag in _BLOCK or any(n is not None and n.bad for n in stack[k:]):
                    flush()
                closed(k)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK or tag == "head":
            flush()
            k = max((places[t][-1] for t in _CLOSES.get(tag, ()) if places[t]), default=0)
            if k > open_scopes[-1]:
                closed(k)
        if tag == "a" and places["a"] and places["a"][-1] > open_blocks[-1]:  # links do not nest
            k = places["a"][-1]
            if stack[k].bad:
                flush()
            if k == len(stack) - 1:
                closed(k)
            else:  # what stands inside the link stays open, and is its own owner if the link is left out
                places["a"].pop()
                stack[k] = None
        if tag == "body" and places["body"] or tag == "html" and len(stack) > 1:
            continue
        bad, weight, semantic = _judged(tag, m["attrs"], stack[-1])
        node = Node(tag, stack[-1], len(nodes), bad or stack[-1].bad, weight, semantic)
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if bad and tag not in _BLOCK:
            flush()
        if not m["attrs"].endswith("/") or tag in _BLOCK or tag == "a":
            nodes.append(node)
            opened(node)
    flush()
    return nodes, blocks


def _score(nodes: list[Node], kept: list[tuple[Node, str, int]]) -> None:
    """Give each element the points of the blocks in and below it."""
    for owner, text, linked in kept:
        points = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
        home = owner if owner.parent is None or owner.tag not in _PARAGRAPHS else owner.parent
        home.score += points
    for node in reversed(nodes):  # children stand behind their parents
        if node.parent is not None:
            node.parent.passed += node.score / 2 + node.passed / 3
        node.score += node.passed


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space."""
    nodes, blocks = _parsed(page or "")
    kept = [b for b in blocks if not b[0].bad]
    if not kept:
        return ""
    _score(nodes, kept)
    ranked = [n for n in nodes if n.score > 0 and not n.bad] or [kept[0][0]]
    best = max(ranked, key=lambda n: (n.score + n.weight, -n.order))
    node = best
    while node is not None:  # the marked article around the best element is the container
        if node.semantic:
            best = node
        node = node.parent
    chosen = {id(best)}
    if best.parent is not None and not best.semantic:
        least = max(3.0, 0.2 * best.score)
        for n in nodes:
            if n.parent is best.parent and not n.bad and (n.score >= least or n.tag in _PARAGRAPHS):
                chosen.add(id(n))
        if best.parent.score >= 0.2 * best.score:
            for owner, text, linked in kept:
                if owner is best.parent and linked * 2 < len(text):
                    chosen.add(id(text))
    for node in nodes:
        node.held = id(node) in chosen or node.parent is not None and node.parent.held
    return " ".join(text for owner, text, _ in kept if owner.held or id(text) in chosen)


def with_main_text(pages: DataFrame, *, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page's html and its length in code points."""

    def compute():
        def apply(texts):
            found = [main_text(t) for t in texts]
            return {name: found, "n_chars": [len(t) for t in found]}

        return apply

    fields = [T.StructField(name, T.StringType()), T.StructField("n_chars", T.LongType())]
    return append_columns(pages, source, fields, compute)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return with_main_text(pages.select(F.col(f"`{page_id}`"), F.col(f"`{url}`"), F.col(f"`{source}`").alias("_html")), source="_html").drop("_html")
