"""Wrappers: union-free regular expressions over the tags and texts of a host's pages.

A wrapper is a sequence of elements, each with a sequence inside, and texts. Neighbours
that repeat (one element, or a group of up to three) are one repeated item. Two sequences
are aligned by their keys; what is in one of them only becomes optional (it was seen on
fewer pages than what holds it), and texts that differ become slots. Aligning a wrapper
with page after page, or with a wrapper of other pages, gives the wrapper of all.

An item is a list, so that it can be sent as JSON: ``[key, pages, repeated, items]`` for an
element, ``["(", pages, True, items]`` for a repeated group and
``["#", pages, hash or None for a slot, characters, characters in links]`` for text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from zlib import crc32

from .html_tokens import INLINE, Tag, balanced, tokens

TEXT, GROUP = "#", "("
LONGEST_PERIOD = 3

# A node of a page: an element (key, children) or a text (TEXT, text, characters in links).
Node = tuple


def _key(tag: Tag) -> str:
    """Element name, and the words of its id, class and role without numbers."""
    if not tag.attributes:
        return tag.name
    parts = [tag.name]
    for name, value in tag.attributes:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            parts.append("!hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            parts.append("!hidden")
        elif name in ("id", "class", "role", "itemprop"):
            parts += sorted(set(re.sub(r"\d+", "0", value).split()))
    return " ".join(parts)


def page_tree(source: str) -> list[Node]:
    """The blocks of a page: inline elements are part of the text around them, a line break
    is white space in it."""
    top: list[Node] = []
    stack: list[tuple[str, list[Node]]] = [("", top)]
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                stack[-1][1].append((TEXT, line, min(linked, len(line))))
        linked = 0

    for token in balanced(tokens(source)):
        if isinstance(token, str):
            text.append(token)
            if links:
                linked += len(token)
        elif token.name in INLINE:
            if token.name == "br":
                text.append(" ")
            elif token.name == "a":
                links += -1 if token.end else 1
            if not token.end and token.attributes and "!hidden" in _key(token):
                text.append(" ")
        else:
            flush()
            if token.end:
                stack.pop()
            else:
                inside: list[Node] = []
                key = _key(token)
                stack[-1][1].append((key, inside))
                stack.append((key, inside))
    flush()
    return top


def _item(node: Node) -> list:
    if node[0] == TEXT:
        return [TEXT, 1, crc32(node[1].encode()), len(node[1]), node[2]]
    return [node[0], 1, False, fold([_item(x) for x in node[1]])]


def _joined(a: list, b: list, same_page: bool) -> list:
    """Two items of the same key as one."""
    pages = max(a[1], b[1]) if same_page else a[1] + b[1]
    if a[0] == TEXT:
        return [TEXT, pages, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4]]
    return [a[0], pages, a[2] or b[2] or same_page, align(a[3], b[3], same_page)]


def _keys(items: list) -> list:
    return [(GROUP, *(x[0] for x in i[3])) if i[0] == GROUP else i[0] for i in items]


def _alike(a: list, b: list) -> bool:
    """Whether two items of the same key may be repetitions: they hold much the same."""
    if a[0] in (TEXT, GROUP):
        return a[0] == TEXT
    x, y = {i[0] for i in a[3]}, {i[0] for i in b[3]}
    return 2 * len(x & y) >= len(x | y)


def fold(items: list) -> list:
    """Items of one page with neighbours that repeat made one."""
    for period in range(1, LONGEST_PERIOD + 1):
        out: list = []
        at = 0
        while at < len(items):
            run = items[at : at + period]
            keys = [i[0] for i in run]
            stop = at + period
            if len(run) == period and GROUP not in keys and (period == 1) == (len(set(keys)) == 1):
                while [i[0] for i in items[stop : stop + period]] == keys and all(
                    map(_alike, run, items[stop : stop + period])
                ):
                    run = [_joined(a, b, True) for a, b in zip(run, items[stop : stop + period])]
                    stop += period
            if period == 1:
                out += run
                at = stop
            elif stop > at + period:
                out.append([GROUP, 1, True, run])
                at = stop
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _grouped(items: list, groups: list[tuple]) -> list:
    """Items with single occurrences of the other side's groups made groups too."""
    for group in groups:
        n = len(group) - 1
        out: list = []
        at = 0
        while at < len(items):
            if tuple(i[0] for i in items[at : at + n]) == group[1:]:
                run = items[at : at + n]
                out.append([GROUP, max(i[1] for i in run), True, run])
                at += n
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _common(a: list, b: list) -> Iterator[tuple[int, int]]:
    """Positions of a common subsequence of two lists of keys."""
    if a == b:
        yield from ((i, i) for i in range(len(a)))
        return
    # Longest common subsequence. Bit n - 1 - i of a row j is 0 if a[i:] and b[j:] have one
    # key more in common than a[i + 1:] and b[j:]; of the rows every ``step``-th is kept.
    n, whole = len(a), (1 << len(a)) - 1
    places: dict = {}
    for i, key in enumerate(a):
        places[key] = places.get(key, 0) | 1 << (n - 1 - i)

    def before(row: int, j: int) -> int:
        same = row & places.get(b[j], 0)
        return (row + same | row - same) & whole

    step = isqrt(len(b)) + 1
    kept, row = {len(b): whole}, whole
    for j in range(len(b) - 1, -1, -1):
        row = before(row, j)
        if j % step == 0:
            kept[j] = row
    i = j = 0
    rows: dict[int, int] = {}
    while i < n and j < len(b):
        if j not in rows:
            stop = min(j // step * step + step, len(b))
            rows = {stop: kept[stop]}
            for k in range(stop - 1, j - 1, -1):
                rows[k] = before(rows[k + 1], k)
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif rows[j] >> (n - 1 - i) & 1:
            i += 1
        else:
            j += 1


def align(a: list, b: list, same_page: bool = False) -> list:
    """The union-free expression of two sequences."""
    a_keys, b_keys = _keys(a), _keys(b)
    if a_keys != b_keys:
        a_groups = [k for k in a_keys if isinstance(k, tuple)]
        b_groups = [k for k in b_keys if isinstance(k, tuple)]
        if a_groups != b_groups:
            a, b = _grouped(a, b_groups), _grouped(b, a_groups)
            a_keys, b_keys = _keys(a), _keys(b)
    out: list = []
    i = j = 0
    for x, y in [*_common(a_keys, b_keys), (len(a), len(b))]:
        out += a[i:x]
        out += b[j:y]
        if x < len(a) and y < len(b):
            out.append(_joined(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    # what stands side by side after this may repeat
    for k in range(len(out) - 1, 0, -1):
        if out[k][0] == out[k - 1][0] and _alike(out[k - 1], out[k]):
            out[k - 1 : k + 1] = [_joined(out[k - 1], out[k], True)]
    return out


def page_wrapper(tree: list[Node]) -> list:
    """The wrapper of one page: pages seen, and its items."""
    return [1, fold([_item(x) for x in tree])]


def merge(a: list, b: list) -> list:
    return [a[0] + b[0], align(a[1], b[1])]


# Words of ids, classes and roles of what is not the article.
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion
    banner nav navbar navigation menu submenu sidebar aside footer masthead breadcrumb
    breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal
    overlay dialog newsletter subscribe subscription signup login search share sharing social
    related recommended recommendations comment comments commentlist reply replies respond
    disqus discussion pagination pager toolbar widget skip copyright contentinfo complementary
    sitenav topbar !hidden""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADER_WORDS = frozenset("header banner masthead topbar".split())
# Elements that are not the article.
OTHER_ELEMENTS = frozenset(
    """head nav footer aside form button select input fieldset menu dialog script style noscript
    template svg canvas iframe object applet embed audio video map frameset""".split()
)
# Words of ids and classes that the article's element may have.
CONTENT_WORDS = frozenset(
    "article articlebody content post entry story main maincontent text body page".split()
)

DROP, PLAIN, WEAK, MAIN, ARTICLE = -1, 0, 1, 2, 3


@lru_cache(maxsize=100_000)
def role(key: str) -> tuple[int, bool]:
    """What an element is by its key, and whether it is a header (one of the page unless it
    is inside the article)."""
    name, *rest = key.split(" ")
    words = {w for part in rest for w in re.split(r"[^a-z!]+", part) if w}
    whole = {re.sub(r"[^a-z]", "", part) for part in rest}
    if name in ("article", "main", "body", "html"):
        if words & COMMENT_WORDS and name == "article" or "!hidden" in words:
            return DROP, False
        return {"article": ARTICLE, "main": MAIN}.get(name, PLAIN), False
    if "articlebody" in whole:
        return ARTICLE, False
    if name == "header" or words & HEADER_WORDS:
        return (DROP if words & (OTHER_WORDS - HEADER_WORDS) else PLAIN), True
    if name in OTHER_ELEMENTS or words & OTHER_WORDS:
        return DROP, False
    if "main" in rest:
        return MAIN, False
    return (WEAK if words & CONTENT_WORDS or whole & CONTENT_WORDS else PLAIN), False


def _flat(items: list) -> list:
    out = []
    for i in items:
        out += i[3] if i[0] == GROUP else [i]
    return out


# A text that is the same on so many different pages of a host, and on such a share of them,
# is part of the template.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.5
# Of a slot without an article's element around it, at most this share is links.
LINK_SHARE = 0.5


def blocks(tree: list[Node], wrapper: list) -> list[str]:
    """The texts of the article, in page order: the slots of the wrapper, and texts that few
    of the host's pages have, in the article's element or, on a page without one, in the
    rest. An article of template texts alone is one that the pages repeat, and is kept."""
    found: list[tuple[int, str, bool]] = []
    often = max(TEMPLATE_PAGES, TEMPLATE_SHARE * wrapper[0])

    def walk(nodes: list[Node], items: list, level: int) -> None:
        flat = _flat(items)
        at = -1
        for node in nodes:
            own = None
            # the expression goes on at the same item (if repeated), a later, an earlier one
            again = (at,) if at >= 0 and flat[at][0] != TEXT and flat[at][2] else ()
            for k in (*again, *range(at + 1, len(flat)), *range(at + 1)):
                if flat[k][0] == node[0]:
                    own, at = flat[k], k
                    break
            if node[0] == TEXT:
                constant = own is not None and own[2] is not None and own[1] >= often
                if level == PLAIN and own is not None:
                    if constant or own[4] > LINK_SHARE * own[3]:
                        continue
                found.append((level, node[1], constant))
                continue
            what, header = role(node[0])
            if what == DROP or header and level < MAIN:
                continue
            walk(node[1], own[3] if own is not None else [], max(level, what))

    walk(tree, wrapper[1], PLAIN)
    best = max((level for level, *_ in found), default=PLAIN)
    own_texts = [text for level, text, constant in found if level == best and not constant]
    return own_texts or [text for level, text, _ in found if level == best]
