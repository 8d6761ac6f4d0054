"""Blocks of text of an HTML page, with what the labelling of page_text needs to know of each."""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
UNSEEN = set("script style noscript template iframe object svg canvas audio video title textarea select datalist map".split())
ASIDE = set("nav aside footer form button label fieldset legend menu dialog output".split())
MAIN = {"article", "main"}
CELLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words in class, id and role that mark what is not the article, what readers wrote, and what is the article.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert banner bar breadcrumb breadcrumbs complementary consent"
    " contentinfo cookie cookies copyright dialog disclaimer footer form gdpr legal links login menu modal more nav navbar"
    " navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted"
    " promotion recommended related search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe"
    " subscription tags teaser toc toolbar topbar widget widgets".split()
)
COMMENT_WORDS = set("comment comments commentlist discussion disqus replies reply respond".split())
MAIN_WORDS = set("article body content entry main post story text".split())
NOT_WORDS = {"with", "has", "no", "without"}
_MARKS = re.compile(r"[©|·»›]|\b(?:copyright|rights reserved|cookies?|subscribe|sign (?:up|in)|log in|advertisement|sponsored)\b", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
_TAG_START = re.compile("<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in UNSEEN}


@dataclass
class Block:
    """Text of one block, its element, and how many of its characters are links."""

    text: str
    element: int
    linked: int


@dataclass
class Page:
    """Elements in page order (tag, parent, own hint) and the blocks of text."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    hints: list[str] = field(default_factory=lambda: [""])
    holds_main: set[int] = field(default_factory=set)
    blocks: list[Block] = field(default_factory=list)

    def add(self, tag: str, parent: int, hint: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.hints.append(hint)
        new = len(self.tags) - 1
        if tag in MAIN and hint == "main":
            up = parent
            while up >= 0 and up not in self.holds_main:
                self.holds_main.add(up)
                up = self.parents[up]
        return new

    def places(self) -> list[str]:
        """Per element `aside`, `main` or neither; `aside` holds for all inside it."""
        found: list[str] = []
        for at, hint in enumerate(self.hints):
            above = found[self.parents[at]] if at else ""
            if hint == "aside" and at in self.holds_main or hint == "top" and above == "main":
                hint = ""
            found.append("aside" if above == "aside" or hint in ("aside", "comment", "top") else hint or above)
        return found


def hint_of(tag: str, attributes: str) -> str:
    """What an element's tag and names say of the text inside it."""
    if tag in ("html", "body", "head"):
        return ""
    words: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        for one in "".join(values).split():
            parts = [w.lower() for w in _WORDS.findall(one)]
            words += [w for before, w in zip(["", *parts], parts) if before not in NOT_WORDS]
    if COMMENT_WORDS & set(words):
        return "comment"
    if tag in ASIDE or _HIDDEN.search(attributes):
        return "aside"
    is_main = tag in MAIN or bool(MAIN_WORDS & set(words))
    if tag == "header" or "header" in words or "masthead" in words:
        return "" if is_main else "top"
    if tag not in MAIN and ASIDE_WORDS & set(words):
        return "aside"
    return "main" if is_main else ""


def parse(html: str) -> Page:
    """Elements and blocks of a page; unclosed, misnested and cut-off markup included."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]
    parts: list[str] = []
    state = {"element": 0, "linked": 0, "links": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append(Block(text, state["element"], min(state["linked"], len(text))))
        parts.clear()
        state["linked"] = 0

    def say(raw: str) -> None:
        text = entities.unescape(raw)
        if not parts:
            state["element"] = stack[-1][1]
        parts.append(text)
        if state["links"]:
            state["linked"] += len(text.strip())

    def close(names: set[str] | tuple, until: tuple = ()) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                state["links"] -= sum(tag == "a" for tag, _ in stack[at:])
                del stack[at:]
                return
            if stack[at][0] in until:
                return

    def inline_top() -> list[tuple[str, int]]:
        """The inline elements open within the innermost block."""
        low = len(stack)
        while stack[low - 1][0] in INLINE:
            low -= 1
        return stack[low:]

    at, end, last = 0, len(html), html.rfind(">") + 1
    while at < end:
        found = _TOKEN.search(html, at, last)
        if found is None:  # what a cut-off tag begins is no text
            say(_TAG_START.split(html[at:], maxsplit=1)[0])
            break
        if found.start() > at:
            say(html[at:found.start()])
        at = found.end()
        ends, tag = found[1], (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                break
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
        elif ends:
            if tag in INLINE:
                if any(t == tag for t, _ in inline_top()):
                    close({tag})
            else:
                flush()
                close({tag})
        elif tag in UNSEEN:
            if not found[3].endswith("/"):
                over = _CLOSING[tag].search(html, at)
                at = over.end() if over else end
        elif tag in INLINE:
            if tag not in VOID:
                stack.append((tag, stack[-1][1]))
                state["links"] += tag == "a"
        else:
            flush()
            if tag in CELLS:
                close({tag} | ({"dt", "dd"} if tag[0] == "d" else {"td", "th"} if tag[0] == "t" and tag != "tr" else set()), CELLS[tag])
            else:
                close({"p"}, ("td", "th", "li", "article", "main", "section", "div", "body"))
            if tag not in VOID:
                stack.append((tag, page.add(tag, stack[-1][1], hint_of(tag, found[3]) if found[3] or tag in ASIDE or tag in MAIN or tag == "header" else "")))
    flush()
    return page


FEATURES = (
    "bias chars linked ends_sentence punctuation words capitals digits marks heading paragraph item neighbour siblings"
).split()
#: Where learning starts, and what holds where no page says otherwise.
FIRST_WEIGHTS = [-1.5, 2.0, -4.0, 1.0, 1.0, 1.0, -1.0, -1.0, -3.0, 0.5, 0.8, -0.8, 0.5, 1.5]


def features(page: Page) -> list[list[float]]:
    """What the text of each block looks like, without the hints of its elements."""
    sizes = [len(b.text) for b in page.blocks]
    around: dict[int, int] = {}
    for block, size in zip(page.blocks, sizes):
        up = page.parents[block.element]
        around[up] = around.get(up, 0) + size
    total, out = sum(sizes), []
    for at, (block, size) in enumerate(zip(page.blocks, sizes)):
        text, tag = block.text, page.tags[block.element]
        words = text.count(" ") + 1
        near = max(sizes[at - 1] if at else 0, sizes[at + 1] if at + 1 < len(sizes) else 0)
        stops = sum(map(text.count, ".,;:!?"))
        out.append([
            1.0, math.log1p(size) / 5, block.linked / size, float(text[-1] in ".!?…\"'”»)"), min(1.0, stops / words),
            math.log1p(words) / 4, sum(map(str.isupper, text)) / size, sum(map(str.isdigit, text)) / size,
            float(_MARKS.search(text) is not None), float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(tag in ("p", "blockquote", "pre")), float(tag in CELLS), math.log1p(near) / 5,
            around[page.parents[block.element]] / total,
        ])
    return out
