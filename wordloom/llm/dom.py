"""Web pages as flat trees: elements in the order of the page, each with its parent and the end of its subtree, and the texts between them.

Made for damaged pages: elements that end by implication (paragraphs, list items, cells, options) do, end tags without a beginning count for nothing, an
end tag of an inline element doesn't reach beyond its block, open elements end with the page, and a tag that the page's end cuts off is dropped.
Scripts, styles, titles, comments and the like leave no text. Inline elements without a class, id or role aren't nodes: their text belongs to the node around them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<[!?][^>]*>", re.S)
CUT_OFF = re.compile(r"<[/A-Za-z!?][^>]*\Z")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no mark-up, and no text of the page.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
#: Their content is mark-up, but no text of the page.
HIDDEN = frozenset("head noscript template svg math object audio video canvas select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_BREAK = INLINE | HIDDEN
#: A beginning of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: What a beginning ends, and what keeps it from looking further out.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: A paragraph isn't looked for beyond these.
SCOPE = frozenset("td th caption table button html template body".split())
#: A piece that separates blocks.
BREAK = -1


@dataclass
class Page:
    """Node 0 is the page. pieces: (node, text) in order; (BREAK, "") where a block begins or ends. marks: links, fields and images as (node, kind)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])
    ends: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)
    marks: list[tuple[int, str]] = field(default_factory=list)


def names(attributes: str) -> str:
    """Values of class, id, role and itemprop, and hidden where it stands."""
    return " ".join(m[2] or m[3] or m[4] or ("hidden" if m[1].lower() == "hidden" else "") for m in ATTRIBUTE.finditer(attributes)).strip()


def parse(source: str) -> Page:
    page = Page()
    pieces = page.pieces
    stack: list[tuple[str, int]] = []  # open elements: tag, and its node or the one around it
    opened: dict[str, int] = {}
    node = links = hidden = 0
    at = 0

    def close(size: int) -> None:
        nonlocal node, links, hidden
        while len(stack) > size:
            tag, own = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            hidden -= tag in HIDDEN
            if own >= 0:
                page.ends[own] = len(page.tags)
                node = page.parents[own]
            if tag not in NO_BREAK:
                pieces.append((BREAK, "", False))

    def text(part: str) -> None:
        if part and not hidden:
            pieces.append((node, html.unescape(part) if "&" in part else part, links > 0))

    end = len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if tag in INLINE and stack[i][0] not in INLINE:
                        break
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag in ("img", "input"):
                page.marks.append((node, tag))
            elif tag == "hr":
                pieces.append((BREAK, "", False))
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else end
            if tag in ("textarea", "iframe"):
                page.marks.append((node, tag))
            continue
        if tag in ENDS_PARAGRAPH and opened.get("p"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in IMPLIED:
            ended, limits = IMPLIED[tag]
            if any(opened.get(x) for x in ended):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        close(i)
                        break
                    if stack[i][0] in limits:
                        break
        if tag == "body" and opened.get("head"):
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))
        inline = tag in INLINE
        named = names(m[3]) if m[3] else ""
        own = -1
        if not inline or named:
            own = len(page.tags)
            page.tags.append(tag)
            page.parents.append(node)
            page.depths.append(page.depths[node] + 1)
            page.attributes.append(named)
            page.ends.append(0)
            node = own
        if tag == "a":
            links += 1
            page.marks.append((node, "a"))
        elif tag in ("button", "select", "label"):
            page.marks.append((node, tag))
        hidden += tag in HIDDEN
        if tag not in NO_BREAK:
            pieces.append((BREAK, "", False))
        stack.append((tag, own))
        opened[tag] = opened.get(tag, 0) + 1
    if at < end:
        rest = source[at:]
        cut = CUT_OFF.search(rest)
        text(rest[: cut.start()] if cut else rest)
    close(0)
    page.ends[0] = len(page.tags)
    return page


def joined(page: Page, kept: list[bool]) -> str:
    """The blocks of the kept nodes' texts, a line each, white space inside a block as single spaces."""
    lines, block = [], []
    for node, part, _ in page.pieces:
        if node < 0:
            if block:
                line = " ".join("".join(block).split())
                if line:
                    lines.append(line)
                block = []
        elif kept[node]:
            block.append(part)
    if block:
        line = " ".join("".join(block).split())
        if line:
            lines.append(line)
    return "\n".join(lines)
