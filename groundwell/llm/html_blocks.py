"""HTML to leaf blocks: a forgiving tokenizer that keeps each block's tag path.

Time and memory grow with the length of the page, however deep, unclosed or
quote-broken it is: an open element knows its path as a bit set shared with its
blocks, the stack keeps the places of each open tag, and what a scan for the end
of a tag has ruled out is remembered.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

#: Elements that hold no text of the page, dropped with all they hold; of these svg may be empty.
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "textarea")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements within a line of text; every other tag ends the block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msup msub msubsup munder mover munderover mmultiscripts mprescripts"
    " mtable mtr mlabeledtr mtd semantics annotation annotation-xml".split()
)
#: Start tags that close an open paragraph, besides headings.
CLOSES_P = frozenset("p div ul ol dl table section article nav header footer aside form blockquote pre hr main figure fieldset address details h1 h2 h3 h4 h5 h6".split())
#: Elements that an open element of their own kind ends at, unless one of these lies between.
WITHIN = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table",), "th": ("table",)}
#: Start tags that end an unclosed head.
PAGE_PARTS = frozenset("body article nav main header footer".split())
#: A whole tag without ``<`` in it, or any ``<``.
_TOKEN = re.compile(r"<(?:(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>\"'<]*+)(?=[\s/>])(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>)?")
_NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
#: Bits of a path's set: a mark's bit is its hash.
PATH_BITS = 384


@dataclass(slots=True)
class Block:
    """White space inside ``text`` is one space; ``path`` is the bit set of the marks (tags, and ``@name`` of attributes) around it, ``marks`` their number."""

    text: str
    path: int
    marks: int
    linked: int


class _Bits(dict):
    """A mark's bit, remembered for a bounded number of them."""

    def __missing__(self, name: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[name] = bit = 1 << zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH_BITS
        return bit


_BITS = _Bits()


def _marks(tag: str, attrs: str) -> tuple[int, int]:
    """(bit set, number) of an element's own marks."""
    bits, n = _BITS[tag], 1
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            for part in _NAME.findall(m[2] or m[3] or m[4] or ""):
                bits |= _BITS[f"@{part.lower()}"]
                n += 1
    return bits, n


class _Ends:
    """Where tags end, asked at rising places of one page; no part of the page is scanned more than a few times."""

    def __init__(self, html: str) -> None:
        self.html, self.special, self.gt, self.hopeless = html, -1, -1, set()

    def first_gt(self, at: int) -> int:
        """The first ``>`` at or after ``at``; -1 for none."""
        if self.gt < at:
            found = self.html.find(">", at)
            self.gt = found if found >= 0 else len(self.html)
        return self.gt if self.gt < len(self.html) else -1

    def of_tag(self, at: int) -> int:
        """The first ``>`` outside quotes; -1 for none. A quote from which there is none is not tried again."""
        html, tried = self.html, []
        if self.special < at:
            m = _SPECIAL.search(html, at)
            self.special = m.start() if m else len(html)
        place = self.special
        while place < len(html):
            if html[place] == ">":
                return place
            close = -1 if place in self.hopeless else html.find(html[place], place + 1)
            if close < 0:
                break
            tried.append(place)
            m = _SPECIAL.search(html, close + 1)
            place = m.start() if m else len(html)
        if place < len(html):
            tried.append(place)
        self.hopeless.update(tried)
        return -1


class _Stack:
    """Open elements: (tag, bits, marks) with the path's bits and marks summed, and the places of each tag."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, int, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of elements that are not inline

    def push(self, tag: str, bits: int, n: int) -> None:
        _, _, _, path, marks = self.open[-1] if self.open else ("", 0, 0, 0, 0)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.outer.append(len(self.open))
        self.open.append((tag, bits, n, path | bits, marks + n))

    def cut(self, depth: int) -> list[tuple[str, int, int, int, int]]:
        """Closes all from ``depth`` on."""
        gone = self.open[depth:]
        del self.open[depth:]
        for tag, *_ in gone:
            self.places[tag].pop()
        while self.outer and self.outer[-1] >= depth:
            self.outer.pop()
        return gone

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``; -1 for none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def without(self, *tags: str) -> None:
        """Takes all open ``tags`` out and leaves what is inside them open."""
        at = min((self.places[t][0] for t in tags if self.places.get(t)), default=-1)
        if at >= 0:
            for tag, bits, n, _, _ in self.cut(at):
                if tag not in tags:
                    self.push(tag, bits, n)


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order. Text of ``head`` and of elements that do not render is left out."""
    out: list[Block] = []
    stack, ends = _Stack(), _Ends(html)
    places = stack.places
    parts: list[str] = []
    linked = at = seen = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text and not (places.get("head") or places.get("title")):
                out.append(Block(text, *(stack.open[-1][3:] if stack.open else (0, 0)), linked))
            parts = []
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if places.get("a"):
                linked += len(s.strip())

    # ``seen`` is where the search goes on, ``at`` where text begins that is not yet taken
    while (m := _TOKEN.search(html, seen)) is not None:
        start = m.start()
        if m["tag"] is not None:
            end, tag, attrs, after = m["end"], m["tag"].lower(), m["attrs"], m.end()
        else:
            tag = after = None
            c = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                found = html.find("-->", start + 4)
                after = found + 3 if found >= 0 else len(html)
            elif (gt := ends.first_gt(start + 1)) < 0:
                # only comments can follow
                seen = html.find("<!--", start + 1)
                if seen < 0:
                    break
                continue
            elif n := _NAME_OF_TAG.match(html, start + 1):
                found = ends.of_tag(n.end())
                if found >= 0:
                    end, tag, attrs, after = n[1], n[2].lower(), html[n.end() : found], found + 1
                else:
                    after = gt + 1  # no end outside quotes: dropped up to the first one inside
            elif c and c in "!?/":
                after = gt + 1
            else:
                seen = start + 1
                continue
        text(html[at:start])
        if tag in _RAW_END and not end:
            if not (tag == "svg" and attrs.endswith("/")):
                found = _RAW_END[tag].search(html, after)
                after = found.end() if found else len(html)
            tag = None
        at = seen = after
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
        elif end:
            inline = tag in INLINE
            if not inline:
                flush()
            depth = stack.last(tag)
            if depth >= 0 and not (inline and stack.outer and stack.outer[-1] >= depth):
                stack.cut(depth)
        else:
            if tag not in INLINE:
                flush()
            if tag in PAGE_PARTS:
                stack.without("head", "title")
            if tag in CLOSES_P:
                if (depth := stack.last("p")) >= 0:
                    stack.cut(depth)
            elif tag in WITHIN and (depth := stack.last(tag)) > max(map(stack.last, WITHIN[tag])):
                stack.cut(depth)
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.push(tag, *_marks(tag, attrs))
    text(html[at:])
    flush()
    return out
