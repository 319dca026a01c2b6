"""HTML as a stream of tags and texts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Elements without content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements that flow inside a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
# A start tag that closes an open element of the same kind first.
_CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
}
_LIMITS = frozenset("ul ol dl table select menu nav article section main body div".split())

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""  # comment
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>"""  # tag
    r"""|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)"""  # declaration, or a comment by mistake
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",  # tag that is cut off
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_KEPT = ("id", "class", "role", "itemprop", "hidden", "aria-hidden", "style")


@dataclass(frozen=True)
class Tag:
    name: str
    end: bool
    attributes: tuple[tuple[str, str], ...] = ()


@lru_cache(maxsize=10_000)
def _tag(name: str, end: bool) -> Tag:
    return Tag(name, end)


def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for name, value in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in _KEPT:
            out.append((name, html.unescape(value.strip("\"'")).lower()))
    return tuple(out)


def tokens(source: str) -> Iterator[Tag | str]:
    """Tags, and texts with character references decoded. Comments, declarations and the
    content of raw elements are left out."""
    at, n = 0, len(source)
    begin = 0  # of the text that is not yet given out
    while True:
        found = _MARKUP.search(source, at)
        if found is None:
            break
        start, at = found.span()
        if start > begin:
            yield html.unescape(source[begin:start])
        begin = at
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            yield _tag(name, True)
            continue
        rest = found[3] or found[6]
        kept = _attributes(rest) if rest and "=" in rest or rest and "hidden" in rest else ()
        yield Tag(name, False, kept) if kept else _tag(name, False)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = begin = close.start() if close else n
    if begin < n:
        yield html.unescape(source[begin:])


def balanced(stream: Iterator[Tag | str]) -> Iterator[Tag | str]:
    """The same stream with every start tag closed, in the right order: void elements are
    closed at once, end tags without a start are left out, a block element closes a
    paragraph that is still open together with what is open inside it."""
    opened: list[str] = []

    def close_to(depth: int) -> Iterator[Tag]:
        while len(opened) > depth:
            yield _tag(opened.pop(), True)

    for token in stream:
        if isinstance(token, str):
            yield token
        elif token.end:
            if token.name in opened:
                depth = len(opened) - 1 - opened[::-1].index(token.name)
                # an inline end tag does not close blocks
                if token.name not in INLINE or all(x in INLINE for x in opened[depth:]):
                    yield from close_to(depth)
        else:
            if token.name not in INLINE and "p" in opened:
                yield from close_to(opened.index("p"))
            same = _CLOSES.get(token.name)
            if same:
                for depth in range(len(opened) - 1, -1, -1):
                    if opened[depth] in same:
                        yield from close_to(depth)
                        break
                    if opened[depth] in _LIMITS:
                        break
            yield token
            if token.name in VOID:
                yield _tag(token.name, True)
            else:
                opened.append(token.name)
    yield from close_to(0)
