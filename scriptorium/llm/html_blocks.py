"""DOM leaf blocks of a page: runs of text that no block-level tag interrupts, with the elements around them.

Time and memory are linear in the page. Each element knows its parent and what it inherits, so a block holds one
reference instead of its ancestry, and the open elements are indexed by tag, so no end tag searches the stack.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

from scriptorium.llm.html_names import group_of_names

#: Fixed values of the HTML standard: elements by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that say what they hold, and those that are named for the feature ``own``.
MARKS = frozenset("article main nav header footer aside form dialog button address select fieldset menu".split())
SHOWN = frozenset("article main nav header footer aside form section ul ol li table figure figcaption blockquote pre button select option label address dialog details summary h1 h2 h3 h4 h5 h6 p div td th dt dd fieldset menu".split())
#: An opening tag of the key closes an open element of the value, up to the nearest container that holds both.
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select body html article section div nav aside main header footer form".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STRICT = re.compile(r"""((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")  # quoted values may hold what ends a tag
_LENIENT = re.compile(r"([^>]*+)>")
_UNENDED = re.compile(r"<[/a-zA-Z!?][^<>]*+\Z")  # a tag that the page's end cuts off
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Element:
    """An open element and what it inherits: the nearest shown tag, and what it and those around it are for.

    ``marks`` lists, nearest first, what the element and its ancestors say they hold: a tag that says so itself or the
    group of their names; each at most once, so the list is bounded.
    """

    __slots__ = ("tag", "own", "marks", "block_at", "holder_at", "p_at")

    def __init__(self, tag: str, mark: str | None, depth: int, parent: Element | None) -> None:
        self.tag = tag
        self.own = tag if tag in SHOWN else parent.own if parent else "none"
        around = parent.marks if parent else ()
        self.marks = around if mark is None or (around and around[0] == mark) else (mark, *(m for m in around if m != mark))
        # depths of the nearest block, container and, above no other block, paragraph
        self.block_at = depth if tag in BLOCK else parent.block_at if parent else -1
        self.holder_at = depth if tag in _HOLDERS else parent.holder_at if parent else -1
        self.p_at = depth if tag == "p" else -1 if tag in BLOCK or not parent else parent.p_at


class Block:
    """The text of a leaf block, the element it stands in, and how many of its characters are links."""

    __slots__ = ("text", "element", "link_chars")

    def __init__(self, text: str, element: Element, link_chars: int) -> None:
        self.text, self.element, self.link_chars = text, element, link_chars


_ROOT = Element("none", None, -1, None)


@lru_cache(maxsize=1 << 14)
def _mark_of(tag: str, attributes: str) -> str | None:
    """What an element says it holds; the names of the page's own elements describe the page instead."""
    if tag in ("html", "body"):
        return None
    if attributes:
        if "hidden" in attributes.lower() or "none" in attributes.lower():
            if _HIDDEN.search(attributes):
                return "hidden"
        if "=" in attributes:
            group = group_of_names(["".join(found) for found in _NAMES.findall(attributes)])
            if group == "main" and tag in MARKS and tag not in ("article", "main"):
                return tag
            if group:
                return group
    return tag if tag in MARKS else None


class _Page:
    def __init__(self) -> None:
        self.open: list[Element] = []
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_chars = 0

    def top(self) -> Element:
        return self.open[-1] if self.open else _ROOT

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.top(), self.link_chars))
            self.parts = []
        self.link_chars = 0

    def text(self, raw: str) -> None:
        if raw:
            plain = unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.depths["a"]:
                self.link_chars += len(plain.strip())

    def _cut(self, at: int) -> None:
        for element in reversed(self.open[at:]):
            self.depths[element.tag].pop()
        del self.open[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.top().p_at >= 0:  # an open paragraph ends where a block starts
                self._cut(self.top().p_at)
            if tag in _CLOSES:
                nearest = max((self.depths[t][-1] for t in _CLOSES[tag] if self.depths[t]), default=-1)
                if nearest > self.top().holder_at:
                    self._cut(nearest)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID and not attributes.endswith("/"):
            depth = len(self.open)
            self.depths[tag].append(depth)
            self.open.append(Element(tag, _mark_of(tag, attributes), depth, self.top()))

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.depths[tag] and (tag in BLOCK or self.depths[tag][-1] > self.top().block_at):
            self._cut(self.depths[tag][-1])


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks in page order. White space in a block is one space; references are decoded; scripts, styles,
    titles and comments have no text. Tags that are never closed end where their container does."""
    page, at, told = _Page(), 0, 0  # told: up to where text has been taken
    last, strict = html.rfind(">"), True
    while at <= last and (opening := html.find("<", at)) >= 0:
        if html.startswith("<!--", opening):
            page.text(html[told:opening])
            end = html.find("-->", opening + 4)
            at = told = end + 3 if end >= 0 else len(html)
            continue
        at = opening + 1
        if opening > last:
            break
        if html.startswith(("!", "?"), at):
            page.text(html[told:opening])
            at = told = html.find(">", at) + 1
            continue
        name = _NAME.match(html, at)
        if name is None:
            continue
        rest = _STRICT.match(html, name.end()) if strict else None
        if rest is None:
            strict = False  # a quote is never closed: from here on tags end at the next bracket, quoted or not
            rest = _LENIENT.match(html, name.end())
        if rest is None:
            break
        page.text(html[told:opening])
        at = told = rest.end()
        closing, tag, attributes = name[1], name[2].lower(), rest[1]
        if closing:
            page.end(tag)
        elif tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(html, at) if at <= last else None
            at = told = end.end() if end else len(html)
        else:
            page.start(tag, attributes)
    page.text(_UNENDED.sub("", html[told:]) if "<" in html[told:] else html[told:])
    page.flush()
    return page.blocks
