"""Text blocks of an HTML page with their place in the document tree."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# ---- fixed values: element names of HTML and words that name parts of pages ----

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not page text: it ends at their end tag, whatever stands inside.
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp svg math object canvas audio video".split())
DRAWN = frozenset("svg math object canvas audio video".split())         # of these, only if they do end
BLOCK = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split())
IGNORED = frozenset("html head body".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre blockquote dd".split())
ITEM = frozenset("li td th dt option button legend label summary".split())
# An element that is open ends where another of these starts, unless the list or table around it is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
# Parts of a page that are never its article.
APART_TAGS = frozenset("nav footer aside menu dialog".split())
APART_ROLES = frozenset("navigation contentinfo complementary search banner menu menubar dialog alertdialog alert".split())
APART_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions".split())
# Parts that a wrapper round the whole page may be called by as well.
SIDE_TAGS = frozenset("form button select fieldset label option".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert aside banner bottombar breadcrumb breadcrumbs consent cookie cookies "
    "copyright feedback foot footer footnav form gdpr legal login masthead menu modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup promo promotion rail recommended related search share sharing side sidebar signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar topbar trending warning widget widgets".split())
HEAD_WORDS = frozenset("header head hd".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody main content post entry story maintext bodytext prose".split())
MODIFIERS = ("has", "no", "with", "without", "is", "js", "not", "hide", "show")

NONE, MAIN, STRONG, SIDE, APART = range(5)

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|!--|[!?/])")
_LOOSE = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)>|!--|[!?/])")
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    """A run of text between the edges of block elements."""

    text: str
    tag: str
    node: int               # number of the element that holds it
    mark: int               # kind of the nearest marked part
    part: int               # number of that part's element
    strong: bool            # inside an article or main element
    link_chars: int


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])     # of each element; element 0 is the page
    depth: list[int] = field(default_factory=lambda: [0])


def mark_of(name: str, attrs: str, outer: int, strong: bool) -> int:
    """The kind of part that an element starts (``NONE``: it goes on with the part around it)."""
    words, own = [], NONE
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" and name != "br":
                own = SIDE
            elif key == "role":
                if value in APART_ROLES and not (value == "banner" and strong):
                    own = APART
                elif value in ("main", "article"):
                    words.append("main")
            else:
                for token in value.split():
                    found = _WORDS.findall(token)
                    if found and found[0] not in MODIFIERS:
                        words += found
    if own == APART or name in APART_TAGS or not APART_WORDS.isdisjoint(words):
        return APART
    if own == SIDE or name in SIDE_TAGS or not SIDE_WORDS.isdisjoint(words):
        # An article is one whatever else its class says ("has a sidebar", "promoted").
        return STRONG if name in MAIN_TAGS and outer != APART else SIDE
    if name in MAIN_TAGS:
        return NONE if outer == APART else STRONG
    if name == "header" or not HEAD_WORDS.isdisjoint(words):
        return NONE if strong or not MAIN_WORDS.isdisjoint(words) else SIDE
    if not MAIN_WORDS.isdisjoint(words):
        return NONE if outer in (APART, SIDE, STRONG) else MAIN
    return NONE


def parse(html: str) -> Page:
    """The blocks of a page, in page order.

    Broken markup never raises: end tags without a start are ignored, open
    elements end with the page, a tag or comment that never ends takes the
    rest of the page with it.  Text stands with character references decoded
    and white space made one space; empty blocks are left out.
    """
    page = Page()
    names, nodes, marks, parts, strongs, block_at = [""], [0], [NONE], [0], [False], [0]
    open_names: Counter[str] = Counter()
    links = 0
    texts: list[str] = []
    link_chars = 0
    pattern = _TAG

    def flush() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                at = block_at[-1]
                page.blocks.append(Block(text, names[at], nodes[at], marks[-1], parts[-1], strongs[-1], link_chars))
            texts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        text = unescape(raw) if "&" in raw else raw
        texts.append(text)
        if links:
            link_chars += len(text)

    def pop() -> None:
        nonlocal links
        if names[-1] in BLOCK or marks[-1] != marks[-2] or parts[-1] != parts[-2]:
            flush()
        name = names.pop()
        open_names[name] -= 1
        links -= name == "a"
        for column in (nodes, marks, parts, strongs, block_at):
            column.pop()

    pos, size = 0, len(html)
    while pos < size:
        lt = html.find("<", pos)
        if lt < 0:
            add(html[pos:])
            break
        if lt > pos:
            add(html[pos:lt])
        m = pattern.match(html, lt)
        if m is None:
            following = html[lt + 1:lt + 2]
            if not (following.isascii() and following.isalpha()):
                add("<")
                pos = lt + 1
                continue
            if pattern is _TAG:             # a quote is never closed: from here on quotes mean nothing
                pattern = _LOOSE
                pos = lt
                continue
            break
        name = m[2]
        if name is None:
            opener = m[0]
            if opener == "<!--":
                end = html.find("-->", lt + 2)
                pos = size if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                pos = size if end < 0 else end + 1
            continue
        pos = m.end()
        name = name.lower()
        if name in IGNORED:
            if name == "body" or m[1]:
                flush()
            continue
        if m[1]:
            if not open_names[name]:
                if name == "p" or name == "br":
                    flush() if name == "p" else add(" ")
                continue
            if name in BLOCK:
                while names[-1] != name:
                    pop()
                pop()
            else:
                # An inline element ends inside its block only.
                at = len(names) - 1
                while at > block_at[-1] and names[at] != name:
                    at -= 1
                if names[at] == name and at > 0:
                    while len(names) > at:
                        pop()
            continue
        if name == "br":
            texts.append(" ")
            continue
        block = name in BLOCK
        if block:
            if names[block_at[-1]] == "p" and block_at[-1] > 0:
                while len(names) > block_at[-1] + 1:
                    pop()
                pop()
            if name in ENDS:
                same, around = ENDS[name]
                if any(open_names[x] for x in same):
                    at = len(names) - 1
                    while at > 0 and names[at] not in same and names[at] not in around:
                        at -= 1
                    if names[at] in same:
                        while len(names) > at:
                            pop()
            flush()
        if name in VOID:
            continue
        if name in RAW:
            if name in DRAWN and m[3].endswith("/"):
                continue
            end = _RAW_END[name].search(html, pos)
            if end is not None:
                pos = end.end()
            elif name not in DRAWN:
                break
            continue
        attrs = m[3]
        mark = mark_of(name, attrs, marks[-1], strongs[-1])
        if mark != NONE and not block:
            flush()
        page.parent.append(nodes[-1])
        page.depth.append(page.depth[nodes[-1]] + 1)
        node = len(page.parent) - 1
        names.append(name)
        open_names[name] += 1
        links += name == "a"
        nodes.append(node)
        marks.append(mark or marks[-1])
        parts.append(node if mark else parts[-1])
        strongs.append(strongs[-1] or mark == STRONG)
        block_at.append(len(names) - 1 if block or mark else block_at[-1])
    flush()
    return page
