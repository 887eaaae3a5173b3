"""A small, forgiving HTML reader: the leaf blocks of a page with their ancestors, in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<",
    re.S,
)
#: One attribute of any name, with its value; a quoted value without its end is a value up to the next space.
_ATTR = re.compile(r"""([^\s"'/=>][^\s"'/=>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)?+)?+|"[^"]*+"|'[^']*+'""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SKIP = frozenset("script style noscript template iframe svg annotation annotation-xml object canvas audio video head title textarea select button datalist xmp noembed noframes".split())
#: Content in which no tag counts until their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math semantics mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mfenced menclose mpadded mphantom mspace mstyle mtable mtr mtd".split())
#: Open elements that a start tag closes, up to the nearest of the boundaries.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass(frozen=True)
class Block:
    """A leaf block: its text, the share of it inside links, its ancestors' tags, their whole class names and ids."""

    text: str
    linked: float
    tags: tuple[str, ...]
    terms: frozenset[str]
    ids: frozenset[str] = frozenset()


def leaf_blocks(page: str | None) -> list[Block]:
    """All visible leaf blocks of a page. Broken, empty and very deep markup is read as far as it goes."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool, frozenset[str]]] = []  # tag, class names of it and its ancestors, inside skipped content, ids
    text: list[str] = []
    linked = links = pos = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            tags = tuple(t for t, *_ in stack if t not in INLINE)
            out.append(Block(words, min(1.0, linked / len(words)), tags, *((stack[-1][1], stack[-1][3]) if stack else (frozenset(), frozenset()))))
        text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        for tag, *_ in stack[upto:]:
            links -= tag == "a"
        del stack[upto:]

    size = len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        token = m.group()
        tag = m.group(2) or m.group(5)
        if not tag:
            if token[0] == "<" and len(token) > 1 and token[1] in "!?":
                continue
            if not (stack and stack[-1][2]):
                plain = html.unescape(token) if "&" in token else token
                text.append(plain)
                if links:
                    linked += len(plain.strip())
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):  # an end tag
            if tag == "br":
                text.append(" ")
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or all(t in INLINE for t, *_ in stack[i + 1 :]):
                        close(i)
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        attrs = m.group(3) or m.group(6) or ""
        if tag not in INLINE and tag not in SKIP:
            flush()
        if tag == "body":  # ends an unclosed head
            close(0)
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in shut:
                    close(i)
                    break
        elif tag not in INLINE and tag not in SKIP:  # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        terms, ids = (stack[-1][1], stack[-1][3]) if stack else (frozenset(), frozenset())
        hidden = bool(stack and stack[-1][2]) or tag in SKIP
        if attrs and "=" in attrs or "hidden" in attrs.lower():
            for a in _ATTR.finditer(attrs):
                name, value = (a.group(1) or "").lower(), (a.group(2) or "").strip("\"'").lower()
                if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif name in ("class", "role", "itemprop"):
                    terms = terms | frozenset(value.split())
                elif name == "id":
                    ids = ids | frozenset(value.split())
        if attrs.endswith("/") and tag in SKIP:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            pos = page.find(">", end.end()) + 1 if end else size
            pos = pos or size
            continue
        links += tag == "a"
        stack.append((tag, terms, hidden, ids))
    flush()
    return out
