"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream is nested by element. Streams of one host are aligned level by level: equal
elements match; an element that one side lacks becomes optional; the same elements in a row (up to
``PERIOD`` of them) become a repeated group; texts that differ become a slot, equal ones stay constant.

Pages of a host whose streams are equal but for texts have one shape. Shapes are summed over all pages first
(sums, smallest hashes and equality of texts, in any order), so a host with a third of all pages is no larger
than another one. Then all of a host's shapes are aligned in the order of their hashes, so the wrapper does not
depend on how pages lie in partitions: up to ``SHAPES`` of them one after another, more in rounds, in which shapes
whose hashes begin alike become one pattern, and those meet by fewer bits. A pattern keeps all elements; a node holds
at most ``ROW`` of them, more are on shelves. So the wrapper of a host grows with the elements in which its shapes differ.

The wrapper tells which part of the host's pages is the article: the element named so that holds the
most slot text, else the smallest element that holds most of it. A page that lacks this part is read
with a wrapper of its own. From the part, elements that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments by their tags are left out, and by their classes if each word of
one says so. Where no element is named as the article, the wrapper's own evidence goes further, whatever
things are called: nodes of constant text and nodes that hold links for the most part are left out too,
by aligned node. A node is constant if its text is equal wherever it occurs, and it occurs in ``SHARE`` of
the host's distinct pages or more; pages are distinct by their whole text, so that copies of a page count
once. The share is exact up to ``SKETCH`` distinct pages and estimated from as many beyond.

Edge cases: null or empty html gives an empty text; a null url belongs to the host ''; texts of any length
are read whole, in linear time; text nested deeper than ``DEPTH`` levels counts for the last of them and is
extracted all the same; of parts of equal weight the first is the article; repeated rows are read each; an
empty table gives an empty result; other columns are ignored, whatever their names; tags that are never
closed end with their block.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, partitions, prepare, table

#: Longest repeated group, in elements.
PERIOD = 3
#: Levels that a wrapper keeps apart; text below counts for the last of them.
DEPTH = 120
#: Shapes of a host that are aligned in one round, and the bits by which each further round parts them (in ``2 ** BITS`` groups).
SHAPES, BITS = 128, 5
#: Nodes that a node of a pattern holds: more of a level are on shelves of so many, under this key.
ROW, SHELF = 200, "(+)"
#: Pairs of elements up to which two streams are aligned by one table; longer streams are halved first.
CELLS = ROW * ROW
#: Patterns, and nodes of them, that a task holds before it passes them on, bytes that it passes on at once, and salts of a shape.
HELD, HELD_NODES, PASSED, SALTS = 5_000, 250_000, 8 << 20, 16
#: Share of a node's text that is in links, if it is a menu.
MENU = 0.8
#: Distinct pages of a host before a text that never changes counts as constant, and the share of them that have it.
CONSTANT, SHARE = 4, 0.5
#: Smallest hashes of distinct pages that a node keeps.
SKETCH = 64
#: Hosts, bytes of their parts, and bytes of one of them, up to which the parts are broadcast and go with each page.
BROADCAST_HOSTS, BROADCAST_BYTES, PART_BYTES = 50_000, 16 << 20, 64 << 10

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "iframe", "textarea", "title", "select")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that are never part of an article.
OUT_TAGS = frozenset("nav header footer aside form button menu dialog input option datalist fieldset script style head".split())
#: Words of a class, id or role that name what is not the article.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist reply replies discussion disqus respond responses notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations widget toolbar pagination pager copyright contentinfo complementary form skip".split()
)
#: Words beside them in a name that do not change what it says.
FILLER = frozenset("area bar block bottom box container content el inner item items left link links list main middle outer page panel right row section site slot text top unit wrap wrapper x".split())
ARTICLE_WORDS = frozenset("article articlebody content post entry story maincontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open element of the second tags, up to an element of the third.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
#: What any other element that is not inline ends.
_PARAGRAPH = (("p",), ("div", "article", "section", "main", "td", "th", "li", "blockquote", "body", "aside", "form", "nav", "header", "footer"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"(?i)^[^:]*?://([^/?#]*)"


@lru_cache(20_000)
def key_of(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's key (its tag and classes), whether it is left out, and whether it names an article."""
    names: list[str] = []
    for _, value in _ATTR.findall(attributes) if "=" in attributes else ():
        names += value.strip("\"'").split()
    sets = [{w.lower() for w in _WORDS.findall(n)} for n in names]
    named = tag in ("article", "main") or tag in ("div", "section", "td") and any(x & ARTICLE_WORDS and x <= ARTICLE_WORDS | FILLER for x in sets)
    said = tag not in ("html", "body", "article", "main") and tag not in HEADINGS and any(x & OUT_WORDS and x <= OUT_WORDS | FILLER for x in sets)
    return f"{tag}.{'.'.join(sorted({re.sub('[0-9]+', '9', n) for n in names}))}", tag in OUT_TAGS or said, named


class Element:
    """An element of a page: children are elements and texts, in order."""

    __slots__ = ("children", "key", "named", "out", "tag")

    def __init__(self, tag: str, key: str, out: bool, named: bool):
        self.tag, self.key, self.out, self.named, self.children = tag, key, out, named, []


def parse(text: str) -> Element:
    """The page as a tree; html, head and body add no level. The places of each tag's open elements are kept, so none is searched for."""
    root = Element("", "", False, False)
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements with a tag, in ``stack``
    at, low = 0, None
    final, opened = text.rfind(">"), text.rfind("<")  # no tag ends after the one, or begins after the other
    start = 0  # of text that no element has yet

    def add(end: int) -> None:
        if end > start:
            stack[-1].children.append(text[start:end])

    def last(tags: tuple[str, ...]) -> int:
        """The place of the innermost open element with one of the tags, or 0."""
        return max((own[-1] for t in tags if (own := places.get(t))), default=0)

    def close(k: int) -> None:
        """Ends the element at a place, and all in it."""
        while len(stack) > k:
            places[stack.pop().tag].pop()

    while True:
        at = text.find("<", at)
        if at < 0:
            add(len(text))
            return root
        if text.startswith("<!--", at):
            add(at)
            end = text.find("-->", at + 4)
            at = start = len(text) if end < 0 else end + 3
            continue
        after = text[at + 1 : at + 3]
        letter = after[1:] if after[:1] == "/" else after[:1]
        if after[:1] in ("!", "?") and at < final:
            add(at)
            at = start = text.index(">", at) + 1
            continue
        if not (letter.isascii() and letter.isalpha()):
            at += 1
            continue
        m = (_TAG.match(text, at) or _PLAIN_TAG.match(text, at)) if at < final else None
        if m is None:  # a tag that the page's end cuts off, or no tag
            if at == opened:
                add(at)
                return root
            at += 1
            continue
        add(at)
        at = start = m.end()
        tag = m[2].lower()
        if tag in ("html", "body"):
            continue
        if m[1]:
            if own := places.get(tag):
                close(own[-1])
            continue
        attributes = m[3] or ""
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                low = text.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == len(text) else -1
                if end < 0:
                    found = re.compile(f"</{tag}", re.I).search(text, at)
                    end = found.start() if found else len(text)
                at = start = end
            if tag != "title":
                stack[-1].children.append(" ")
            continue
        if tag not in INLINE:
            targets, stops = CLOSES.get(tag, _PARAGRAPH)
            if (k := last(targets)) > last(stops):
                close(k)
        e = Element(tag, *key_of(tag, attributes))
        stack[-1].children.append(e)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(e)


# -- wrappers ---------------------------------------------------------------------------------------


#: Stands for the text of a node that is a menu.
MENU_TEXT = -2


class Pattern:
    """A node of a wrapper. ``text``: None without text, a hash while all texts are equal, -1 for a slot.

    ``seen``: the smallest hashes of the distinct pages that have it (of the root, and while the text is
    constant); ``of``: the elements that it stands for, in a page's own wrapper if asked for.
    """

    __slots__ = ("children", "key", "linked", "named", "of", "optional", "out", "pages", "repeated", "seen", "size", "text")

    def __init__(self, key: str, out: bool, named: bool):
        self.key, self.out, self.named, self.optional, self.repeated = key, out, named, False, False
        self.pages, self.size, self.linked, self.text, self.children = 1, 0, 0, None, []
        self.seen, self.of = [], []

    def dump(self) -> list:
        return [self.key, self.out, self.named, self.optional, self.repeated, self.pages, self.size, self.linked, self.text, self.seen, [c.dump() for c in self.children]]


def load(x: list) -> Pattern:
    p = Pattern(x[0], x[1], x[2])
    p.optional, p.repeated, p.pages, p.size, p.linked, p.text, p.seen = x[3:10]
    p.children = [load(c) for c in x[10]]
    return p


def _text_hash(parts: list[str]) -> int | None:
    joined = " ".join(" ".join(parts).split())
    return (hash_of(joined) & 0x7FFFFFFFFFFFFFFF) if joined else None


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def text_of(root: Element) -> str:
    """All text of a page."""
    texts, todo = [], list(reversed(root.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            texts.append(c)
        else:
            todo += reversed(c.children)
    return " ".join(" ".join(texts).split())


def of_page(e: Element, depth: int = 0, page: int | None = None, keep: bool = False) -> Pattern:
    """A page's own wrapper: inline elements are text; the same elements in a row are a repeated group."""
    page = hash_of(text_of(e)) & 0x7FFFFFFFFFFFFFFF if page is None else page
    p = Pattern(e.key, e.out, e.named)
    if keep:
        p.of.append(e)
    texts: list[str] = []
    children: list[Pattern] = []

    def gather(x: Element, linked: bool) -> None:
        todo = [(c, linked) for c in reversed(x.children)]
        while todo:
            c, link = todo.pop()
            if isinstance(c, str):
                texts.append(c)
                n = len(c.strip())
                p.size += n
                p.linked += n * link
            elif c.tag in INLINE or depth >= DEPTH:
                todo += [(y, link or c.tag == "a") for y in reversed(c.children)]
                if keep and c.tag not in INLINE:
                    p.of.append(c)
            else:
                children.append(of_page(c, depth + 1, page, keep))

    gather(e, e.tag == "a")
    p.text = _text_hash(texts)
    p.seen = [page] if p.text is not None or not depth else []
    p.children = collapsed(children)
    return p if keep else shelved(p)


def collapsed(row: list[Pattern]) -> list[Pattern]:
    """Resolves repeats: any ``PERIOD`` or fewer patterns that follow themselves become one group, until there are none."""
    while True:
        before = len(row)
        for period in range(1, PERIOD + 1):
            i, out = 0, []
            while i < len(row):
                unit = row[i : i + period]
                keys = [x.key for x in unit]
                j = i + period
                while len(unit) == period and [x.key for x in row[j : j + period]] == keys:
                    unit = [merged(a, b, True) for a, b in zip(unit, row[j : j + period], strict=True)]
                    j += period
                if j > i + period:
                    if period == 1:
                        unit[0].repeated = True
                        out.append(unit[0])
                    else:
                        group = Pattern("(" + "|".join(keys) + ")", False, False)
                        group.repeated, group.children, group.pages = True, unit, unit[0].pages
                        out.append(group)
                    i = j
                else:
                    out.append(row[i])
                    i += 1
            row = out
        if len(row) == before:
            return row


def shelved(p: Pattern) -> Pattern:
    """Puts a level of more than ``ROW`` nodes on shelves, and those on further ones, until none holds more."""
    while len(p.children) > ROW:
        shelves = []
        for i in range(0, len(p.children), ROW):
            shelves.append(Pattern(SHELF, False, False))
            shelves[-1].children = p.children[i : i + ROW]
        p.children = shelves
    return p


def level(p: Pattern) -> list[Pattern]:
    """The elements and groups below a node, in order, from all shelves."""
    if p.children and p.children[0].key == SHELF:  # then all are shelves
        return [c for shelf in p.children for c in level(shelf)]
    return p.children


def nodes(p: Pattern) -> int:
    n, todo = 0, [p]
    while todo:
        n, x = n + 1, todo.pop()
        todo += x.children
    return n


def whole_size(p: Pattern) -> tuple[int, int]:
    """Characters of a node's text, and of that in links, with all below it."""
    size, linked, todo = 0, 0, [p]
    while todo:
        x = todo.pop()
        size, linked = size + x.size, linked + x.linked
        todo += x.children
    return size, linked


def shape_of(p: Pattern) -> int:
    """A hash of a pattern without its texts."""
    parts, todo = [], [p]
    while todo:
        x = todo.pop()
        parts.append(f"{x.key}\x00{x.repeated:d}{len(x.children)}")
        todo += x.children
    return hash_of("\x01".join(parts)) & 0x7FFFFFFFFFFFFFFF


def add_to(a: Pattern, b: Pattern) -> None:
    """Sums pattern b, which has the same shape, into a."""
    a.pages, a.size, a.linked = a.pages + b.pages, a.size + b.size, a.linked + b.linked
    a.text, a.optional = a.text if a.text == b.text else -1, a.optional or b.optional
    a.seen = sorted({*a.seen, *b.seen})[:SKETCH] if a.key == "" or a.text not in (None, -1) else []
    for x, y in zip(a.children, b.children, strict=True):
        add_to(x, y)


def _by_table(x: list, y: list) -> list[tuple[int | None, int | None]]:
    """The places of two streams of keys with their longest common subsequence matched, by a table of all pairs."""
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list[tuple[int | None, int | None]] = []
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out + [(k, None) for k in range(i, n)] + [(None, k) for k in range(j, m)]


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each head of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for key in x:
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == key)), out=row[1:])
    return row


def _by_halves(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """The same for long streams, in memory that is linear in their length: one is halved, and the other where the halves match most."""
    numbers = {k: i for i, k in enumerate({*x}.intersection(y))}
    # only keys of both streams can match
    places = [[i for i, k in enumerate(keys) if k in numbers] for keys in (x, y)]
    p, q = (np.array([numbers[keys[i]] for i in own], np.int32) for keys, own in zip((x, y), places, strict=True))
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and p[i] == q[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and p[n - 1] == q[m - 1]:
            n, m = n - 1, m - 1
            pairs.append((n, m))
        if (n - i) * (m - j) <= CELLS or min(n - i, m - j) == 1:
            pairs += [(i + k, j + h) for k, h in _by_table(p[i:n].tolist(), q[j:m].tolist()) if k is not None and h is not None]
        elif n - i <= m - j:
            half = (i + n) // 2
            cut = j + int(np.argmax(_lengths(p[i:half], q[j:m]) + _lengths(p[half:n][::-1], q[j:m][::-1])[::-1]))
            todo += [(i, half, j, cut), (half, n, cut, m)]
        else:
            half = (j + m) // 2
            cut = i + int(np.argmax(_lengths(q[j:half], p[i:n]) + _lengths(q[half:m][::-1], p[i:n][::-1])[::-1]))
            todo += [(i, cut, j, half), (cut, n, half, m)]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for n, m in [*((places[0][k], places[1][h]) for k, h in sorted(pairs)), (len(x), len(y))]:
        out += [*((k, None) for k in range(i, n)), *((None, k) for k in range(j, m)), (n, m)]
        i, j = n + 1, m + 1
    return out[:-1]


def aligned(a: list[Pattern], b: list[Pattern]) -> list[tuple[Pattern | None, Pattern | None]]:
    """The two streams with their longest common subsequence of keys matched."""
    x, y = [p.key for p in a], [p.key for p in b]
    if x == y:
        return list(zip(a, b, strict=True))
    places = _by_table(x, y) if len(x) * len(y) <= CELLS else _by_halves(x, y)
    return [(None if i is None else a[i], None if j is None else b[j]) for i, j in places]


def merged(a: Pattern, b: Pattern, same_page: bool = False) -> Pattern:
    """One pattern that both match: mismatched texts become slots, mismatched elements optional."""
    p = Pattern(a.key, a.out, a.named)
    p.optional, p.repeated = a.optional or b.optional, a.repeated or b.repeated
    p.pages = a.pages if same_page else a.pages + b.pages
    p.size, p.linked = a.size + b.size, a.linked + b.linked
    p.text = a.text if a.text == b.text else -1
    if a.key == "" or p.text not in (None, -1):
        p.seen = a.seen if a.seen == b.seen else sorted({*a.seen, *b.seen})[:SKETCH]
    p.of = a.of + b.of
    rows: list[Pattern] = []
    for x, y in aligned(level(a), level(b)):
        if x is not None and y is not None:
            rows.append(merged(x, y, same_page))
        else:
            one = x if x is not None else y
            one.optional = True
            rows.append(one)
    p.children = collapsed(rows)
    return shelved(p)


def is_constant(p: Pattern, pages: frozenset[int]) -> bool:
    """Whether a node has the same text in ``SHARE`` or more of the host's distinct pages (their smallest hashes)."""
    # a page among the host's smallest hashes that has the node is among the node's smallest too
    return p.text not in (None, -1) and len(pages) >= CONSTANT and len(pages.intersection(p.seen)) >= max(CONSTANT, SHARE * len(pages))


def is_menu(p: Pattern, pages: frozenset[int]) -> bool:
    """Whether a node of a host with enough distinct pages is a block of links for the most part."""
    size, linked = whole_size(p)
    return len(pages) >= CONSTANT and p.pages >= CONSTANT and size > 0 and linked >= MENU * size and p.key.split(".")[0] in ("ul", "ol", "div", "section", "table", "dl", "center")


def part_of(wrapper: Pattern) -> dict:
    """Where the article is: the keys on the way to its element, whether an element is named so, and the wrapper's nodes as far as they lead to constant texts."""
    pages = frozenset(wrapper.seen)
    named: list[tuple[int, bool, tuple[str, ...]]] = []
    weight: dict[int, int] = {}

    def weigh(p: Pattern) -> int:
        w = 0 if is_constant(p, pages) or p.out else max(0, p.size - 2 * p.linked)
        if not p.out:
            w += sum(map(weigh, p.children))
        else:
            for c in p.children:
                weigh(c)
        weight[id(p)] = w
        return w

    def own(p: Pattern) -> int:
        return p.size + sum(map(own, p.children))

    def walk(p: Pattern, path: tuple[str, ...], out: bool) -> None:
        for c in p.children:
            way = path if c.key.startswith("(") else (*path, c.key)
            gone = out or c.out
            if c.named and not c.out:
                named.append((weight[id(c)] or own(c), gone, way))
            walk(c, way, gone)

    weigh(wrapper)
    walk(wrapper, (), False)
    real = [n for n in named if not n[1]] or named
    strict = [n for n in real if n[2][-1].split(".")[0] in ("article", "main")] or real
    if strict:
        most = max(n[0] for n in strict)
        # of nested parts the deepest that holds nearly all of the text
        return {"path": max((n for n in strict if n[0] >= 0.8 * most), key=lambda n: (len(n[2]), n[0]))[2], "named": True, "constant": None}
    here, path = wrapper, []
    while True:
        fit = [c for c in level(here) if not c.out and weight[id(c)] >= 0.75 * weight[id(here)] > 0 and c.key.split(".")[0] in ("div", "section", "table", "tbody", "tr", "td", "center")]
        if not fit or here.text == -1 and here.size > 80:
            break
        here = fit[0]
        path.append(here.key)

    def fixed(p: Pattern, way: tuple[str, ...]) -> list:
        """The node as [key, text if it is constant (MENU_TEXT: a menu), children if any of them leads to such a node]."""
        inside = list(way[: len(path)]) == path
        text = p.text if way and inside and is_constant(p, pages) and not p.repeated and weight[id(wrapper)] and p.key.split(".")[0] not in HEADINGS else None
        if way and len(way) > len(path) and inside and is_menu(p, pages):
            return [p.key, MENU_TEXT, []]
        rows = [fixed(c, way if c.key.startswith("(") else (*way, c.key)) for c in level(p)] if inside or path[: len(way)] == list(way) else []
        return [p.key, text, rows if any(r[1] is not None or r[2] for r in rows) else []]

    found = fixed(wrapper, ())
    return {"path": path, "named": False, "constant": found if found[2] else None}


# -- extraction -------------------------------------------------------------------------------------


def bare(x: list) -> Pattern:
    """The nodes of a part as patterns."""
    p = Pattern(x[0], False, False)
    p.text, p.children = x[1], [bare(c) for c in x[2]]
    return p


def constants(root: Element, constant: Pattern | list | None) -> set[int]:
    """The page's elements (by id) whose own text is constant: aligned with such a node, and of its text."""
    out: set[int] = set()

    def match(w: Pattern, p: Pattern) -> None:
        if w.text == MENU_TEXT:
            everything(p)
        elif w.text is not None and w.text == p.text:
            out.update(map(id, p.of))
        if w.children:
            for x, y in aligned(w.children, p.children):
                if x is not None and y is not None:
                    match(x, y)

    def everything(p: Pattern) -> None:
        out.update(map(id, p.of))
        for c in p.children:
            everything(c)

    if constant:
        match(bare(constant) if isinstance(constant, list) else constant, of_page(root, 0, 0, True))
    return out


def blocks(e: Element, named: bool, constant: set[int]) -> Iterator[str]:
    """Texts of the blocks of an element, in page order. Of ``constant`` elements their own texts are left out."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join(_html.unescape("".join(held)).split())
        held.clear()
        if text:
            yield text

    # a node, and whether its own texts are left out
    todo: list[tuple[object, bool]] = [(c, id(e) in constant) for c in reversed(e.children)]
    while todo:
        c, mute = todo.pop()
        if c is None:
            yield from flush()
        elif isinstance(c, str):
            if not mute:
                held.append(c)
        elif c.tag == "br":
            held.append(" ")
        elif c.tag in INLINE and not c.out:
            todo += [(x, mute) for x in reversed(c.children)]
        else:
            yield from flush()
            if not c.out:
                todo += [(None, False), *((x, id(c) in constant) for x in reversed(c.children))]
    yield from flush()


def elements_at(root: Element, path: tuple[str, ...]) -> list[Element]:
    found = [root]
    for key in path:
        found = [c for e in found for c in e.children if not isinstance(c, str) and c.key == key]
    return found


def extract(text: str | None, part: dict | None) -> str:
    """The article of a page, with the part that its host's wrapper names."""
    if not text:
        return ""
    root = parse(text)
    found = elements_at(root, tuple(part["path"])) if part else []
    if part is None or not found or part["named"] is False and not part["path"]:
        own = part_of(of_page(root))
        if part is None or not found or own["named"]:
            part = own
            found = elements_at(root, tuple(part["path"]))
    constant = constants(root, part["constant"])
    return "\n".join(b for e in found for b in blocks(e, part["named"], constant))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of shapes: host, shape, pattern."""
    found: dict[tuple[str, int], Pattern] = {}
    held = 0
    for b in batches:
        for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                page = of_page(parse(text))
                key = host, shape_of(page)
                if key in found:
                    add_to(found[key], page)
                else:
                    found[key] = page
                    held += nodes(page)
            if len(found) > HELD or held > HELD_NODES:
                yield from _shapes(found)
                found, held = {}, 0
    yield from _shapes(found)


def _shapes(found: dict[tuple[str, int], Pattern]) -> Iterator[pa.RecordBatch]:
    hosts, shapes, texts, size = [], [], [], 0
    for (host, shape), p in found.items():
        hosts.append(host)
        shapes.append(shape)
        texts.append(json.dumps(p.dump()))
        size += len(texts[-1])
        if len(texts) == 256 or size > PASSED:
            yield _rows(hosts, shapes, texts)
            hosts, shapes, texts, size = [], [], [], 0
    if texts:
        yield _rows(hosts, shapes, texts)


def _rows(hosts: list[str], shapes: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.int64()), pa.array(texts, pa.string())], names=["host", "shape", "pattern"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and shape: their sums."""
    last, found = None, None
    for b in batches:
        for host, shape, pattern in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            p = load(json.loads(pattern))
            if (host, shape) == last:
                add_to(found, p)
            else:
                if found is not None:
                    yield from _shapes({last: found})
                last, found = (host, shape), p
    if found is not None:
        yield from _shapes({last: found})


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, group and shape: the groups' patterns, each with the first shape of its group. A group of one passes as it is."""
    last, first, found = None, None, None  # found: a pattern, or its text while it is alone

    def done() -> pa.RecordBatch:
        text = found if isinstance(found, str) else json.dumps(found.dump())
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int32()), pa.array([text], pa.string())], names=["host", "shape", "rounds", "pattern"])

    for b in batches:
        for host, group, shape, rounds, pattern in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (host, group) == last:
                found = merged(load(json.loads(found)) if isinstance(found, str) else found, load(json.loads(pattern)))
            else:
                if found is not None:
                    yield done()
                last, first, found = (host, group), (shape, rounds), pattern
    if found is not None:
        yield done()


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(part_of(load(json.loads(w)))) for w in b.column(1).to_pylist()], pa.string())], names=["host", "part"])


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def wrappers_of(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON), from all pages (url, html) and all their shapes. Tasks' sums merge in groups before they meet."""
    prepare(pages.sparkSession)
    n, names, schema = partitions(pages.sparkSession), ("host", "shape"), "host string, shape long, pattern string"
    own = in_arrow(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")), _infer, schema)
    for salt in (F.pmod(F.xxhash64("pattern"), F.lit(SALTS)), F.lit(0)):  # a shape of a large host comes from every task
        own = in_arrow(own.withColumn("salt", salt).repartition(n, *names, "salt").sortWithinPartitions(*names, "salt").drop("salt"), _add, schema)
    own = Store(pages.sparkSession).keep(own)
    # hosts of more shapes than one round takes, with the rounds before the last that they need
    large = own.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > SHAPES)
    most, depth = large.agg(F.max("n")).first()[0] or 0, 0
    while most > SHAPES << BITS * depth:
        depth += 1
    rows = own.withColumn("rounds", F.lit(0))
    if depth:  # a host's shapes meet their number of rounds in SALTS places
        needed = sum(((F.col("n") > SHAPES << BITS * k).cast("int") for k in range(depth)), F.lit(0))
        needed = large.select("host", needed.alias("rounds"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        rows = own.withColumn("salt", F.pmod("shape", F.lit(SALTS)).cast("int")).join(needed, ["host", "salt"], "left").select(*names, F.coalesce("rounds", F.lit(0)).alias("rounds"), "pattern")
    for k in range(depth, -1, -1):
        # in round 0 all shapes of a host are one group, in round k those whose hashes begin with the same bits; others wait
        group = F.when(F.col("rounds") >= k, F.shiftright("shape", 63 - BITS * k)).otherwise(F.col("shape")) if k else F.lit(0).cast("long")
        rows = rows.withColumn("group", group).repartition(n, "host", "group").sortWithinPartitions("host", "group", "shape")
        rows = in_arrow(rows.select("host", "group", "shape", "rounds", "pattern"), _align, "host string, shape long, rounds int, pattern string")
    return rows.select("host", F.col("pattern").alias("wrapper"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h, json.loads(p) if p else None) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for rows that are sorted: a host's part, in a row of its own, and its pages."""
    last, part = None, None
    for b in batches:
        rows = []
        for page_id, url, html, text, host, is_page in zip(*b.columns, strict=True):
            if is_page.as_py():
                rows.append((page_id.as_py(), url.as_py(), extract(html.as_py(), part if host.as_py() == last else None)))
            else:
                last, part = host.as_py(), json.loads(text.as_py())
                part["constant"] = part["constant"] and bare(part["constant"])
        ids, urls, texts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_articles(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    parts = Store(pages.sparkSession).keep(in_arrow(wrappers_of(pages), _locate, "host string, part string"))
    n, size, most = parts.agg(F.count("*"), *(F.coalesce(f(F.length("part")), F.lit(0)) for f in (F.sum, F.max))).first()
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    if n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES and most <= PART_BYTES:
        return in_arrow(rows.join(F.broadcast(parts), "host", "left").select("page_id", "url", "html", "part"), _extract, schema)
    # a host's pages meet its part in SALTS places, where it is read once before them
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).withColumn("part", F.lit(None).cast("string")).withColumn("is_page", F.lit(True))
    heads = parts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).withColumn("is_page", F.lit(False))
    rows = rows.unionByName(heads, allowMissingColumns=True).repartition(partitions(pages.sparkSession), "host", "salt").sortWithinPartitions("host", "salt", "is_page")
    return in_arrow(rows.select("page_id", "url", "html", "part", "host", "is_page"), _extract_sorted, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article of every row of ``pages``."""
    return extract_articles(table(spark, sf_dir, "pages"))
