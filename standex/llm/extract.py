"""Main text of a page by composite text density.

1. Menus, page headers and footers, sidebars, forms, scripts and styles are marked by their elements and roles,
   and comment threads by structure (three or more like blocks, each with an author and a time) or by
   a name that nothing else has; they take no further part, unless they hold an article, or (forms) more than
   half of the page's text.
2. Every other node gets its characters per tag, adjusted for links:
   C/T x log base ln(C/NLC x LC + LCb/Cb x C + e) of (C/LC x T/LT), with C characters, T tags, L those
   in links, N not, b of the whole body; zero denominators count as 1, and the base as e at least (where
   a page has hardly a link, it would approach 1 and the shortest blocks win).
3. The node with the largest sum of its blocks' densities heads the main text. Its blocks are the nearest nodes
   below that aren't inline (a, b, span, ...), so that a paragraph isn't preferred to what holds it. No
   element's name picks it. If it is the body, blocks beside the dense ones are left out as in 4.
4. The threshold is the least density on the path from it to the body: at each node of that path, what
   is as dense, or lies between two blocks that are, is taken too; and so are headings, paragraphs
   and articles next to what is taken, unless most of them is links.
5. A class or id never drops a block by itself. A block that is named like an advert, a notice or a menu has to be as
   dense as the densest block of the chosen text, and small beside it; one whose name may also be a section's (discussion, related,
   share) has to reach the threshold of 4 and half of the chosen node's density, wherever it stands.

Defined results: null and empty pages, and pages without text, give the empty string. Pages of any
length are parsed whole, in linear time. Rows are independent: repeated rows get equal texts, and nothing is
shuffled. Of nodes with equal sums the first in page order is taken. Columns named text and n_chars
must not be among those given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import widened
from .html import Node, parse, text_of, written

#: Elements that never hold main text.
DROPPED_TAGS = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav aside footer annotation annotation-xml "
    "button select option input textarea label dialog menu noframes noembed xmp".split()
)
#: Elements that some pages are wrapped in whole.
FORMS = frozenset(["form", "fieldset"])
#: Roles of such parts.
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split()
)
#: Words in a class or id that name such parts and hardly a section of an article.
BOILERPLATE_NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense adbox adslot breadcrumb breadcrumbs gdpr "
    "masthead modal nav navbar offcanvas pager pagination paywall popup promo sidebar sidenav subnav toast topbar topnav".split()
)
#: Words that name such parts or sections. Two of them in one name (cookie-banner) count as one of the above.
DOUBTFUL_NAMES = frozenset(
    "banner consent cookie cookies discussion feedback footer login menu navigation newsletter notice notification overlay recommended related "
    "replies reply respond responses share sharing signup social sponsored subscribe toolbar widget".split()
)
#: Words that name readers' comments alone.
COMMENT_NAMES = frozenset("comment comments commentlist disqus guestbook".split())
#: Words in a class, id, rel or itemprop that mark an entry's author, and its time.
AUTHOR_NAMES = frozenset("author avatar by byline commenter name nick poster user username vcard".split())
TIME_NAMES = frozenset("ago date datetime posted published time timestamp".split())
#: A block named like an advert is at most one in so many of the chosen text's characters, or it isn't a part of it.
PART = 4
#: Like blocks that make a thread, and the longest name of an author.
THREAD, AUTHOR = 3, 40
#: Names that mean a page's head unless they stand in the article.
HEADER_NAMES = frozenset(["header"])

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ARTICLE = frozenset(["article", "main"])
_NAMED = frozenset("a b cite em i span strong".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Text that may be short and yet belong to what it stands next to.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p article blockquote pre".split())
#: Elements within a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr math maction merror mfrac mi mn mo mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext mover munder "
    "munderover semantics".split()
)
#: Blocks that may be menus without a name that says so.
LINK_BLOCKS = frozenset("ul ol dl div section table p center span".split())


def _names(attributes: dict[str, str]) -> set[str]:
    """The words of class and id, and neighbouring words of one name as one ("side-bar")."""
    out: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [x.lower() for x in _NAME.findall(name)]
        out.update(words)
        out.update(a + b for a, b in zip(words, words[1:], strict=False))
    return out


def _words_of(node: Node, *attributes: str) -> set[str]:
    a = node.attributes() if node.raw else {}
    return {w.lower() for x in attributes for w in _NAME.findall(a.get(x, ""))}


def _is_entry(node: Node) -> bool:
    """Whether a block looks like a reader's comment: an author and a time, no heading."""
    author = time = False
    first = None
    for x in node.walk():
        if x.tag in HEADINGS:
            return False
        words = _words_of(x, "class", "id", "rel", "itemprop") if x is not node else set()
        author = author or bool(words & AUTHOR_NAMES)
        time = time or x.tag == "time" or bool(words & TIME_NAMES)
        if first is None and x is not node and any(isinstance(y, str) and y.strip() for y in x.children):
            first = x  # what a comment begins with, if not by its text
            author = author or x.tag in _NAMED and len(" ".join(y for y in x.children if isinstance(y, str))) <= AUTHOR
    return author and time


def _is_thread(node: Node) -> bool:
    """Whether a node's blocks are mostly like ones (by element and class) that look like comments."""
    blocks = [x for x in node.children if not isinstance(x, str) and x.tag not in INLINE]
    if len(blocks) < THREAD:
        return False
    like: dict[tuple[str, str], list[Node]] = {}
    for x in blocks:
        like.setdefault((x.tag, (x.attributes() if x.raw else {}).get("class", "")), []).append(x)
    most = max(like.values(), key=len)
    return len(most) >= max(THREAD, len(blocks) / 2) and all(_is_entry(x) for x in most[:THREAD])


def _mark(root: Node) -> None:
    """marks = (dropped, in an article or main, 2 if named like boilerplate or 1 if perhaps)."""
    nodes = list(root.walk())
    named: dict[int, int] = {}
    comments: set[int] = set()
    threads: set[int] = set()  # in a comment thread, or in something dropped
    holds: set[int] = set()  # usable articles, and nodes with one below
    articles: list[Node] = []
    for node in nodes:
        a = node.attributes() if node.raw else {}
        up = node.parent
        within = up is not None and (up.marks[1] or up.tag in _ARTICLE)
        role = a.get("role", "").lower()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
        whole = node.tag in ("html", "body")  # some pages hide these until a script has run
        quoted = node.tag == "footer" and up is not None and up.tag == "blockquote"  # whom it quotes
        strong = node.tag in DROPPED_TAGS and not quoted or node.tag == "header" and not within or not whole and (role in DROPPED_ROLES or hidden)
        node.marks = (strong, within, 0)
        if (a.get("class") or a.get("id")) and node.tag not in ("html", "body", "main"):
            names = _names(a)
            doubtful = len(names & DOUBTFUL_NAMES)
            sure = names & BOILERPLATE_NAMES or doubtful > 1 or names & HEADER_NAMES and not within
            if sure or doubtful:
                named[id(node)] = 2 if sure else 1
            if names & COMMENT_NAMES:
                comments.add(id(node))
        in_thread = up is not None and id(up) in threads
        if not strong and not in_thread and not whole and id(node) not in comments and _is_thread(node):
            comments.add(id(node))
        if strong or id(node) in comments or in_thread:
            threads.add(id(node))
        elif node.tag in _ARTICLE or role in ("main", "article"):
            articles.append(node)
    for node in articles:
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    size: dict[int, int] = {}
    for node in reversed(nodes):
        size[id(node)] = sum(len(x) if isinstance(x, str) else size[id(x)] for x in node.children) if not node.marks[0] else 0
    body = size[id(root)]
    for node in nodes:
        if node.marks[0] or id(node) in holds:
            continue  # or it wraps an article
        small = 2 * size[id(node)] <= body
        if node.tag in FORMS and small or id(node) in comments:
            node.marks = (True, *node.marks[1:])
        elif kind := named.get(id(node)):
            beside = not node.marks[1] and holds  # beside an article, which the page itself marks
            node.marks = (*node.marks[:2], 2 if beside else kind if small else 0)


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    base = max(math.log(c / max(c - lc, 1) * lc + share * c + math.e), math.e)
    x = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    return c / max(t, 1) * math.log(x) / math.log(base) if x > 1 else 0.0


def _counted(body: Node) -> dict[int, tuple[int, int, int, int]]:
    """(characters, tags, characters in links, links) of every node, without what is dropped below it."""
    counts: dict[int, tuple[int, int, int, int]] = {}
    for node in reversed(list(body.walk())):
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                c += len(" ".join(x.split()))
            elif not x.marks[0]:
                a, b, d, e = counts[id(x)]
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        if node.tag == "a":
            lc, lt = c, lt + 1
        counts[id(node)] = (c, t, lc, lt)
    return counts


def _link_share(body: Node) -> float:
    """Of all the body's characters, menus included, those in links."""
    c = lc = 0
    stack: list[tuple[Node | str, bool]] = [(body, False)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            c, lc = c + n, lc + n * link
        elif x.tag not in ("script", "style"):
            stack.extend((y, link or x.tag == "a") for y in x.children)
    return lc / max(c, 1)


def densities(body: Node) -> tuple[list[Node], dict[int, tuple[int, int, int, int]], dict[int, float]]:
    """The nodes that aren't dropped, in page order, the counts, and each one's density."""
    nodes, stack = [], [body]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str) and not x.marks[0])
    counts, share = _counted(body), _link_share(body)
    return nodes, counts, {id(n): _density(*counts[id(n)], share) for n in nodes}


def _sums(nodes: list[Node], density: dict[int, float]) -> dict[int, float]:
    """The sum of the densities of each node's blocks; inline nodes hand theirs on."""
    sums: dict[int, float] = {}
    for node in reversed(nodes):
        sums[id(node)] = sum(
            sums[id(x)] if x.tag in INLINE else density[id(x)] for x in node.children if not isinstance(x, str) and not x.marks[0] and x.marks[2] < 2
        )
    return sums


def _blocks(node: Node) -> Iterator[Node]:
    """What a node's sum is made of."""
    stack = list(node.children)
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.marks[0] or x.marks[2] > 1:
            continue
        if x.tag in INLINE:
            stack.extend(x.children)
        else:
            yield x


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _mark(root)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    nodes, counts, density = densities(body)
    if not counts[id(body)][0]:
        return ""
    half = ceiling = part = math.inf

    def outside(node: Node) -> bool:
        """Dropped, by its links a menu, or named like one and not dense enough."""
        c, _, lc, lt = counts[id(node)]
        if node.marks[0] or node.marks[2] and density[id(node)] < (ceiling if node.marks[2] > 1 else half) or node.marks[2] > 1 and c > part:
            return True
        return lt > 1 and 5 * lc >= 3 * c and node.tag in LINK_BLOCKS

    sums = _sums(nodes, density)
    fit = [n for n in nodes if n.tag not in INLINE and n.marks[2] < 2]
    best = max(fit or [body], key=lambda n: sums[id(n)])  # the first in page order on ties
    if not sums[id(best)]:
        return text_of(body, outside)
    path, node = [best], best
    while node is not body:
        node = node.parent
        path.append(node)
    threshold = min(density[id(n)] for n in path)
    part = counts[id(best)][0] / PART
    half = max(threshold, density[id(best)] / 2)
    ceiling = max(density[id(n)] for n in _blocks(best))

    def level(outer: Node, inner: Node | None) -> tuple[str, str]:
        """The text taken of outer's children, before and after inner."""
        beside = list(outer.children)
        out = [not isinstance(x, str) and outside(x) for x in beside]
        good = [x is inner or not isinstance(x, str) and not o and density[id(x)] >= threshold for x, o in zip(beside, out, strict=True)]
        if True not in good:
            return written(outer, outside), ""
        first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
        while first and (out[first - 1] or _goes_along(beside[first - 1], counts)):
            first -= 1
        while last + 1 < len(beside) and (out[last + 1] or _goes_along(beside[last + 1], counts)):
            last += 1
        parts, side = ([], []), 0
        for x, dense, gone in zip(beside[first : last + 1], good[first : last + 1], out[first : last + 1], strict=True):
            if x is inner:
                side = 1
            elif isinstance(x, str):
                parts[side].append(x)
            elif gone or not dense and 2 * counts[id(x)][2] > counts[id(x)][0]:
                parts[side].append(" ")
            else:
                parts[side].append(written(x, outside))
        return "".join(parts[0]), "".join(parts[1])

    middle = [written(best, outside)] if best is not body else list(level(body, None))
    before, after = [], []
    for inner, outer in zip(path, path[1:], strict=False):
        left, right = level(outer, inner)
        before.append(left)
        after.append(right)
    return " ".join(" ".join([*reversed(before), *middle, *after]).split())


def _goes_along(x: Node | str, counts: dict[int, tuple[int, int, int, int]]) -> bool:
    """Text next to what is taken: headings, paragraphs, articles, and loose text, if most of it isn't links."""
    if isinstance(x, str):
        return True
    c, _, lc, _ = counts[id(x)]
    return (x.tag in TEXTS and not x.marks[2] or x.tag in INLINE) and 2 * lc <= c


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without its html, with text and n_chars."""
    names = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*names, "text", "n_chars"],
            )

    kept = pages.select(*names, html)
    return kept.mapInArrow(run, widened(pages.select(*names).schema, ("text", T.StringType()), ("n_chars", T.LongType())))
