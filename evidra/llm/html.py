"""A tolerant HTML reader: blocks of text with the containers they stand in.

Reading takes time in proportion to the page, however deep its elements are
nested.  A path is the hash of the path above and the element's own step, so
it is as long on a deep page as on a flat one.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import xxhash

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'>/]+)")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text of their own, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
#: Elements whose content is never main text.
SECTIONS = frozenset("nav footer aside menu dialog".split())
SMALL = frozenset("button select option datalist map template noscript svg math object canvas video audio head".split())
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: An open element that a new block of this kind closes.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_BREAKS_OUT = _CLOSES_P | {"p", "body"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "aside", "footer", "header", "nav", "form", "table"}}

#: Words in classes and ids that say what an element is for, and words that only hint at it.
CERTAIN = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsors sponsored promo promos
    nav navbar navigation menu menus topbar breadcrumb breadcrumbs pager pagination toolbar masthead header footer sidebar sidebars widget widgets
    cookie cookies consent gdpr popup modal overlay paywall comment comments commentlist disqus respond
    share sharing social newsletter subscribe signup login related recommended""".split()
)
HINTS = frozenset(
    """aside rail notice notices alert alerts reply replies discussion follow subscription recommendations trending popular teaser teasers
    copyright legal print hidden skip foot disclaimer promotion promoted""".split()
)
TALK = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words that say an element holds the text itself, unless one of the second kind says otherwise.
_MAIN = frozenset("content article main post entry story".split())
_NOT_MAIN = frozenset("ad ads advert comment comments related sidebar nav menu footer share notice promo sponsored".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog tooltip".split())


class Node:
    """An element; what is below ``noise`` is filled in by ``settle``."""

    __slots__ = ("tag", "parent", "path", "depth", "hard", "open_ended", "certain", "hint", "talk", "within", "noise", "length", "link", "anchors", "core")

    def __init__(self, tag: str, parent: "Node | None", raw: str = ""):
        self.tag, self.parent = tag, parent
        self.open_ended = self.certain = self.hint = self.talk = self.noise = self.core = False
        self.hard = tag in SECTIONS or tag in SMALL
        self.length = self.link = self.anchors = 0
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        step = tag
        if raw and not raw.isspace():
            at = _attributes(raw)
            classes = sorted({_DIGITS.sub("#", c.lower()) for c in at.get("class", "").split()})
            if classes:
                step = tag + "." + ".".join(classes)
            if tag not in ("html", "body", "article", "main"):
                names = {w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", f"{at.get('class', '')} {at.get('id', '')}").lower()) if w}
                if not (names & _MAIN and not names & _NOT_MAIN):
                    self.certain, self.hint, self.talk = bool(names & CERTAIN), bool(names & HINTS), bool(names & TALK)
                self.hard |= at.get("role", "").lower() in _ROLES
            self.hard |= "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        if tag == "header":
            self.hard |= not self.within
        elif tag in ("form", "fieldset"):
            self.certain = True
        elif tag == "a":
            self.hard |= self.certain or "skip" in step
        self.hard |= parent is not None and parent.hard
        self.path = xxhash.xxh3_64_intdigest(step, parent.path if parent is not None else 0)
        self.depth = parent.depth + 1 if parent is not None else 0


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link: int
    anchors: int

    @property
    def weight(self) -> int:
        """Characters that speak for a container: text, with links against it."""
        return max(0, len(self.text) - 2 * self.link)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = (m[1] or m[5] or "").lower()
        if name and name not in out:
            out[name] = _html.unescape(m[2] or m[3] or m[4] or "")
    return out


class _Ends:
    """Where an element's next end tag is; looks at no part of the page twice for one tag."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, tuple[int, int, int]] = {}  # tag -> searched from, start and end of what was found; -1: none

    def after(self, tag: str, at: int) -> tuple[int, int]:
        since, start, end = self.known.get(tag, (at + 1, 0, 0))
        if since <= at and (start < 0 or at <= start):
            return start, end
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(self.page, at)
        start, end = m.span() if m else (-1, -1)
        self.known[tag] = at, start, end
        return start, end


def read(page: str | None) -> tuple[list[Node], list[Block]]:
    """The page's elements and its blocks of text, both in page order.

    Malformed and cut-off markup is read as far as it goes.  An element with
    text of its own (``RAW``) that has no end tag hides no more than what
    stands before the next tag; a section or small element without an end tag
    ends where main text or a block begins.
    """
    blocks: list[Block] = []
    root = Node("", None)
    nodes, stack, parts = [root], [root], []
    open_tags: dict[str, int] = {}
    loose = {False: 0, True: 0}  # open elements without an end tag: sections, small ones
    link = anchors = 0
    page = page or ""
    ends = _Ends(page)

    def end() -> None:
        nonlocal link, anchors
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = stack[-1]
                blocks.append(Block(text, node.parent if node.tag == "a" and node.parent is not None else node, link, anchors))
            parts.clear()
        link = anchors = 0

    def add(raw: str) -> None:
        nonlocal link
        node = stack[-1]
        if not node.hard:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if node.tag == "a":
                link += len(text)

    def push(tag: str, raw: str) -> Node:
        node = Node(tag, stack[-1], raw)
        nodes.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        return node

    def cut(i: int) -> None:
        """Close the elements from the i-th on."""
        for node in stack[i:]:
            open_tags[node.tag] -= 1
            if node.open_ended:
                loose[node.tag in SMALL] -= 1
        del stack[i:]

    def cut_loose(small: bool) -> None:
        while loose[small]:
            i = len(stack) - 1
            while not (stack[i].open_ended and (stack[i].tag in SMALL) == small):
                i -= 1
            cut(i)

    def last(tags) -> int:
        """The place of the innermost open element of these; only if one is open."""
        i = len(stack) - 1
        while stack[i].tag not in tags:
            i -= 1
        return i

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a bare < is text
            add(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            add(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a" and stack[-1].tag == "a":
                    cut(len(stack) - 1)
            elif open_tags.get(tag):
                end()
                cut(last((tag,)))
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                parts.append(" ")
            elif tag == "a":
                if stack[-1].tag == "a":
                    cut(len(stack) - 1)
                anchors += 1
                push(tag, m[3])
            continue
        end()
        if tag in VOID:
            continue
        if stack[-1].tag == "a":
            cut(len(stack) - 1)
        if tag in _BREAKS_OUT:
            cut_loose(True)
        if tag in ("article", "main", "h1"):
            cut_loose(False)
        shut = {"p"} if tag in _CLOSES_P else CLOSES.get(tag, ())
        if any(open_tags.get(x) for x in shut):
            scope = _SCOPE.get(tag, _SCOPE["p"])
            i = last({*shut, *scope, ""})
            if stack[i].tag in shut:
                cut(i)
        if tag in RAW:
            start, stop = ends.after(tag, at)
            at = stop if start >= 0 else page.find("<", at)
            if at < 0:
                break
            continue
        if m[3].endswith("/") and (tag in FOREIGN or tag not in CONTAINERS):
            continue
        node = push(tag, m[3])
        if tag == "head" or tag in SECTIONS or tag in SMALL or tag in ("header", "form"):
            node.open_ended = tag == "head" or ends.after(tag, at)[0] < 0
            loose[tag in SMALL] += node.open_ended
    end()
    return nodes, blocks


#: On a page without article and main elements, an element whose name says what it is for is main text all the same from this share of the
#: page's text (the second, where readers talk).  A name that hints counts below the third share only, for short or link-heavy text.
RESCUED, TALKED, HINTED, SHORT = 0.6, 0.95, 1 / 3, 200


def settle(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks outside what the page itself shows to be no main text: names, links, shares of the text."""
    for b in blocks:
        b.node.length += len(b.text)
        b.node.link += b.link
        b.node.anchors += b.anchors
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.length += node.length
            up.link += node.link
            up.anchors += node.anchors
            up.core |= node.core or node.tag in ("article", "main")
    total = nodes[0].length
    named = any(n.tag in ("article", "main") and n.length and not n.hard for n in nodes)
    for node in nodes[1:]:
        up = node.parent
        node.noise = up.noise
        if node.noise or node.core:
            continue
        share = node.length / total if total else 0.0
        menu = node.link > 0.7 * node.length
        if node.certain:
            node.noise = named or share < (TALKED if node.talk else RESCUED)
        elif node.hint:
            node.noise = share < HINTED and (node.length < SHORT or node.link > 0.3 * node.length)
        if menu and node.anchors > 2 and share < HINTED and not node.within and node.tag not in ("article", "main", "body", "html"):
            node.noise = True
    return [b for b in blocks if not b.node.noise]
