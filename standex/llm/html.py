"""A small, tolerant HTML tree: one pass over the markup, no recursion, in time linear in its length.

Defined results: anything parses. The empty text is a root without children; a "<" that begins no tag, and a
tag that never ends, are text; an end tag without an open one is dropped; what is open at the end is closed.
Once a quote in a tag turns out never to end, quotes no longer hide the ">" of the tags after it.
"""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_QUOTE = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul video audio".split()
)
_ENDS_P = BLOCK - frozenset("br option optgroup select title body html head".split())
#: An opening tag closes an open one of the first set, the outermost that no one of the second encloses.
_CLOSES = {
    "p": (frozenset(["p"]), frozenset("td th caption button object table html body div section article main aside li dd dt form fieldset blockquote".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_RULE = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_RULES = list(_CLOSES)
_MATTERS = frozenset().union(*[a | b for a, b in _CLOSES.values()])


class Node:
    __slots__ = ("tag", "raw", "parent", "children", "marks", "open")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent = tag, raw, parent
        #: While the tree is built: for each of _RULES, the node that it would close.
        self.open: tuple[Node | None, ...] = parent.open if parent is not None else (None,) * len(_RULES)
        if tag in _MATTERS:
            self.open = tuple(None if tag in stops else x or (self if tag in closes else None) for x, (closes, stops) in zip(self.open, _CLOSES.values(), strict=True))
        self.children: list[Node | str] = []
        self.marks: tuple = ()

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.raw):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out

    def walk(self):
        """The nodes of the subtree, parents first, in page order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if not isinstance(x, str))


def _tag_end(html: str, pos: int, quotes: bool) -> tuple[int, bool]:
    """The place of the ">" that ends the tag whose attributes begin at pos, -1 without; and whether quotes
    still hide others. There is a ">" after pos."""
    at = pos
    while quotes:
        m = _QUOTE.search(html, at)
        if m is None:
            quotes = False
        elif m[0] == ">":
            return m.start(), True
        else:
            at = html.find(m[0], m.end()) + 1
            quotes = at > 0
    return html.find(">", pos), False


def parse(html: str) -> Node:
    root = Node("#root", "", None)
    at, pos, text, end, last = root, 0, 0, len(html), html.rfind(">")
    open_tags: dict[str, int] = {}
    quotes = comments = True

    def up_to(node: Node) -> Node:
        """Closes all that is open, the node included; each is closed once."""
        x = at
        while True:
            open_tags[x.tag] -= 1
            if x is node:
                return x.parent
            x = x.parent

    def flush(stop: int) -> None:
        if stop > text:
            at.children.append(unescape(html[text:stop]))

    while (pos := html.find("<", pos)) >= 0 and pos < last:
        start, c = pos, html[pos + 1 : pos + 2]
        if c in ("!", "?"):
            stop = -1
            if comments and html.startswith("<!--", pos):
                stop = min((x for x in (html.find("-->", pos + 2), html.find("--!>", pos + 4)) if x >= 0), default=-1)
                comments = stop >= 0  # one that never ends holds all the rest
                flush(start)
                text = pos = end if stop < 0 else html.find(">", stop) + 1
                continue
            flush(start)
            text = pos = html.find(">", pos) + 1
            continue
        closing = c == "/"
        m = _NAME.match(html, pos + 1 + closing)
        if m is None:
            pos += 1
            continue
        stop, quotes = _tag_end(html, m.end(), quotes)
        if stop < 0:
            pos += 1
            continue
        flush(start)
        text = pos = stop + 1
        tag = m[0].lower()
        if closing:
            if open_tags.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = up_to(node)
            continue
        raw = html[m.end() : stop]
        if tag in _ENDS_P and at.open[0] is not None:
            at = up_to(at.open[0])
        if tag in _RULE and (closed := at.open[_RULES.index(_RULE[tag])]) is not None:
            at = up_to(closed)
        node = Node(tag, raw, at)
        at.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            stop = close.start() if close else end
            if stop > pos:
                node.children.append(unescape(html[pos:stop]) if tag in ("title", "textarea") else html[pos:stop])
            text = pos = (html.find(">", stop) + 1 or end) if close else end
            continue
        if not raw.endswith("/") or tag not in ("svg", "path", "g"):
            at = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush(end)
    return root


def written(node: Node, skipped) -> str:
    """The subtree's text in page order, with a space where a block begins, ends, or is skipped."""
    parts: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if skipped(x):
            parts.append(" ")
            continue
        if x.tag in BLOCK:
            parts.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    return "".join(parts)


def text_of(node: Node, skipped) -> str:
    """The subtree's text: white space collapsed, one space between blocks."""
    return " ".join(written(node, skipped).split())
