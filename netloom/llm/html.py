"""Main text of web pages by wrapper induction over the pages of one host.

A page is parsed into a tree of its block elements; inline elements only pass their text on. The outline of the upper
elements is a page's layout. A host has a seed for its most common layout and for each other that MIN_PAGES pages and a
tenth of the host have: the page of the least hash. Every page is aligned with the seed of its layout, else with that
of the most common one, by simple tree matching: the largest number of node pairs of equal tags that keeps parents and
the order of siblings. Over the pages that fit a seed it is counted for each seed node how often and with how many
characters it was matched with the seed's own text, and how much other text stood in it. A node with the same text on
nearly all pages is template. The spine leads from the root to the node below which no child holds most of the text that
varies. What varies beside the spine is content too, unless it stands in a child that is mostly template (a bar with a
date in it). The content slot is the smallest node that holds all content, so no varying text is lost by its share.
Empty pages and those of another layout fit no seed.

Markup helps in three places: varying slots whose names, classes or roles say that they are menus, adverts, forms,
comments and the like are left out; where article or main elements hold half of what varies, they are the content slots
in full, with constant headings of theirs; and where there is no content slot (hosts of few pages, pages that fit no
seed) the article or main element is taken if there is one.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import small_batches, table
from netloom.llm.urls import split_url

MIN_PAGES = 5
SHARE = 0.9
#: a layout of at least this share of a host's pages has a seed of its own
LAYOUT_SHARE = 0.1
#: a slot number for pages whose article or main elements are the content
ARTICLES = -2
MAX_SEED_BYTES = 32 << 20

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: elements that an opening block element ends, and those that /> ends
ENDED = ("svg", "math", "select")
CLOSABLE = frozenset("svg math iframe object canvas".split())
NEVER = RAW | frozenset("noscript template iframe svg math object canvas select head nav footer aside form button menu dialog fieldset input option datalist audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|notification|"
    r"sidebar|aside|comment|comments|disqus|footer|masthead|topbar|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|"
    r"share|sharing|social|newsletter|subscribe|subscription|signup|login|popup|modal|pagination|pager|toolbar|copyright)(?:$|[\s_-])",
    re.I,
)
#: names that mean a bar of the page, but inside an article may be a part of it
BARS = re.compile(r"(?:^|[\s_-])(?:banner|alert|side|respond|reply|replies|foot|header|related|recommended|overlay|search|widget|skip)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3".split())
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
#: most tags: all quotes closed and without angle brackets in them; what this doesn't take is read step by step
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    never: bool = False
    bar: bool = False  # named like a bar of the page; counts outside of the content slot only
    kids: list[Node] = field(default_factory=list)
    parts: list[str | Node] = field(default_factory=list)  # texts and kids in page order
    number: int = -1

    def own(self) -> str:
        return " ".join("".join(x for x in self.parts if isinstance(x, str)).split())


def _never(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never content, and whether it is named like a bar of the page."""
    if tag in NEVER:
        return True, False
    if not attributes.strip(" /\n\t"):
        return False, False
    bar = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if NAMES.search(value):
                return True, False
            bar = bar or BARS.search(value) is not None
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, bar


class _Open:
    """The open elements of a page, with counts by tag for the whole stack and for each scope, so that looking for one
    that isn't open costs nothing however deep the page is."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        if node.tag in SCOPES:
            self.scopes.append({})
        else:
            self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.count[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def close(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def close_in_scope(self, tags: frozenset[str] | set[str]) -> None:
        """Closes the innermost of the tags that is open in this scope, and what is in it."""
        if any(self.scopes[-1].get(t, 0) for t in tags):
            while self.pop() not in tags:
                pass


class _Tokens:
    """Tags of a page from the left: (first place, end, closing, name, attributes); comments have no name.

    A quote that nothing closes is a character like others. That is known once for each kind of quote, so that the time
    is linear in the page.
    """

    def __init__(self, text: str):
        self.text, self.lost = text, {'"': len(text) + 1, "'": len(text) + 1}

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        text, n = self.text, len(self.text)
        at = text.find("<", at)
        if at < 0:
            return None
        m = PLAIN.match(text, at)
        if m is not None:
            return at, m.end(), m[1] != "", m[2].lower(), m[3]
        m = OPENING.search(text, at)
        if m is None:
            return None
        if m[2] is None:
            end = text.find("-->", m.end()) if m[0] == "<!--" else text.find(">", m.end())
            return m.start(), n if end < 0 else end + (3 if m[0] == "<!--" else 1), False, "", ""
        p = m.end()
        while True:
            stop = STOP.search(text, p)
            if stop is None:
                return m.start(), n, bool(m[1]), m[2].lower(), text[m.end() :]
            p = stop.end()
            if stop[0] == ">":
                return m.start(), p, bool(m[1]), m[2].lower(), text[m.end() : p - 1]
            if p < self.lost[stop[0]]:
                close = text.find(stop[0], p)
                if close < 0:
                    self.lost[stop[0]] = p
                else:
                    p = close + 1


def parse(text: str) -> Node:
    """The tree of block elements; character references are decoded in the texts. Nothing in a page is an error."""
    root = Node("#page")
    open_, at, n = _Open(root), 0, len(text)
    stack = open_.stack
    quiet: list[str] = []  # open inline elements that are never content
    foreign = False
    tokens = _Tokens(text)
    while at < n:
        token = tokens.next(at)
        if token is None:
            break
        start, end, closing, tag, attributes = token
        if start > at and not quiet:
            stack[-1].parts.append(_html.unescape(text[at:start]))
        at = end
        if not tag:
            continue
        if closing:
            if tag in INLINE:
                if quiet and tag in quiet:
                    del quiet[quiet.index(tag) :]
                continue
            if open_.has(tag):
                open_.close(tag)
                quiet = []
            stack[-1].parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(text, at)
            at = n if close is None else close.end()
            stack[-1].parts.append("" if tag in ("script", "style") else " ")
            continue
        if tag in ("br", "hr"):
            stack[-1].parts.append(" ")
            if tag == "br":
                continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if (quiet and tag == quiet[0]) or (attributes and any(_never(tag, attributes))):
                quiet.append(tag)
            continue
        if tag in CLOSES_P:
            if foreign:
                for ended in ENDED:
                    if open_.has(ended):
                        open_.close(ended)
            if open_.scopes[-1].get("p", 0):
                open_.close("p")
        if tag in CLOSABLE and attributes.endswith("/"):
            stack[-1].parts.append(" ")
            continue
        if peers := PEERS.get(tag):
            open_.close_in_scope(peers)
        quiet = []
        foreign = foreign or tag in ENDED
        never, bar = (tag in NEVER, False) if not attributes else _never(tag, attributes)
        never = never or stack[-1].never or tag == "header" and not (open_.has("article") or open_.has("main"))
        node = Node(tag, never, bar or stack[-1].bar)
        stack[-1].kids.append(node)
        stack[-1].parts += [" ", node]
        open_.push(node)
    if at < n and not quiet:
        stack[-1].parts.append(_html.unescape(text[at:]))
    for number, x in enumerate(_in_order(root)):
        x.number = number
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def skeleton(root: Node) -> str:
    """Depths, tags, hashes and lengths of own texts and flags (1: never content, 2: named like a bar) of the nodes in the
    order of the page, as flat JSON arrays."""
    return json.dumps(_flat(root), separators=(",", ":"))


def _flat(root: Node) -> list[list]:
    depth, tags, hashes, sizes, flags = [], [], [], [], []
    todo = [(root, 0)]
    while todo:
        x, d = todo.pop()
        own = x.own() if x.parts else ""
        depth.append(d)
        tags.append(x.tag)
        hashes.append(xxhash.xxh32_intdigest(own) if own else 0)
        sizes.append(len(own))
        flags.append(x.never + 2 * x.bar)
        todo += [(k, d + 1) for k in reversed(x.kids)]
    return [depth, tags, hashes, sizes, flags]


def pieces(root: Node) -> tuple[list[int], list[str]]:
    """The texts of a page in their order, each with the number of the node that it stands in."""
    owners: list[int] = []
    texts: list[str] = []
    todo: list[tuple[str | Node, int]] = [(root, 0)]
    while todo:
        x, owner = todo.pop()
        if isinstance(x, str):
            if owners and owners[-1] == owner:
                texts[-1] += x
            else:
                owners.append(owner)
                texts.append(x)
        else:
            todo += [(y, x.number) for y in reversed(x.parts)]
    return owners, texts


class _Shapes:
    """Numbers for tree shapes: two trees have one number if their tags and structure are equal."""

    def __init__(self, base: _Shapes | None = None):
        self.base, self.known = base, {}
        self.first = base.first + len(base.known) if base else 0
        self.rows: list[tuple[str, tuple[int, ...], int]] = []  # tag, kids' numbers, size

    def number(self, tag: str, kids: tuple[int, ...]) -> int:
        key = (tag, kids)
        if self.base and key in self.base.known:
            return self.base.known[key]
        if key not in self.known:
            self.known[key] = self.first + len(self.known)
            self.rows.append((tag, kids, 1 + sum(self[k][2] for k in kids)))
        return self.known[key]

    def __getitem__(self, number: int) -> tuple[str, tuple[int, ...], int]:
        return self.base[number] if self.base and number < self.first else self.rows[number - self.first]


class Seed:
    """A page's skeleton as numbered nodes, in the order of the page."""

    def __init__(self, text: str | Node):
        depth, self.tags, self.hashes, self.sizes, self.flags = json.loads(text) if isinstance(text, str) else _flat(text)
        self.kids: list[list[int]] = [[] for _ in self.tags]
        self.parent = [-1] * len(self.tags)
        path: list[int] = []
        for number, d in enumerate(depth):
            del path[d:]
            if path:
                self.kids[path[-1]].append(number)
                self.parent[number] = path[-1]
            path.append(number)
        self.owners: list[int] = []
        self.texts: list[str] = []

    @cached_property
    def numbers(self) -> tuple[_Shapes, list[int]]:
        shapes = _Shapes()
        return shapes, self.numbered(shapes)

    @property
    def shape(self) -> list[int]:
        return self.numbers[1]

    @classmethod
    def page(cls, text: str | Node, owners: list[int], texts: list[str]) -> Seed:
        """A page with its texts."""
        out = cls(text)
        out.owners, out.texts = owners, texts
        return out

    def end(self, node: int) -> int:
        """One more than the last number below the node."""
        while self.kids[node]:
            node = self.kids[node][-1]
        return node + 1

    def text_of(self, node: int, skip: set[int], drop: set[int] | frozenset[int] = frozenset(), bars: int | None = None) -> str:
        """The text below a node, without elements that are never content, those of the numbers in drop, and the own texts of
        those in skip; bars: below the node of this number elements named like bars are content."""
        end = self.end(node)
        shown, inner = [False] * (end - node), [False] * (end - node)
        for i in range(node, end):
            up = self.parent[i] - node
            inner[i - node] = i == bars or (up >= 0 and inner[up])
            ok = i == node or shown[up]
            shown[i - node] = ok and not (self.flags[i] & 1 or self.flags[i] & 2 and not inner[i - node] or i in drop)
        out = []
        for owner, text in zip(self.owners, self.texts, strict=True):
            if node <= owner < end:
                out.append(text if shown[owner - node] and owner not in skip else " ")
        return " ".join("".join(out).split())

    def numbered(self, shapes: _Shapes) -> list[int]:
        shape = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            shape[i] = shapes.number(self.tags[i], tuple([shape[k] for k in self.kids[i]]))
        return shape


def _middle(a: list, b: list) -> tuple[int, int]:
    """How many of two lists are equal at the front, and how many of the rest at the back."""
    lo, least = 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return lo, hi


def _last_row(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[x, b]))
    return row


def _heaviest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j), rising in both, of the largest total weight[a[i], b[j]]; memory is linear in the lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if (k - i) * (m - j) > 1 << 20 and k - i > 1:
            half = (i + k) // 2
            split = j + int((_last_row(a[i:half], b[j:m], weight) + _last_row(a[half:k][::-1], b[j:m][::-1], weight)[::-1]).argmax())
            todo += [(i, half, j, split), (half, k, split, m)]
            continue
        best = np.zeros((k - i + 1, m - j + 1), np.int64)
        for r in range(k - i):
            best[r + 1, 1:] = np.maximum.accumulate(np.maximum(best[r, 1:], best[r, :-1] + weight[a[i + r], b[j:m]]))
        x, y = k - i, m - j
        while x and y:
            w = weight[a[i + x - 1], b[j + y - 1]]
            if w and best[x, y] == best[x - 1, y - 1] + w:
                x, y = x - 1, y - 1
                out.append((i + x, j + y))
            elif best[x, y] == best[x - 1, y]:
                x -= 1
            else:
                y -= 1
    return out


def tree_match(seed: Seed, page: Seed | Node) -> list[tuple[int, int]]:
    """Pairs (seed node, page node), by number, of a largest simple tree matching of the two trees; the roots must have equal tags.

    Weights are kept for pairs of tree shapes. Trees of one shape match in full, and siblings of equal shape at the
    front and the back of two lists are paired at once, which loses nothing, as such a pair uses all nodes of both;
    the dynamic programme runs on what is between. Nothing is recursive, so depth doesn't matter.
    """
    page = page if isinstance(page, Seed) else Seed(page)
    shapes = _Shapes(seed.numbers[0])
    shape = page.numbered(shapes)
    if shape[0] == seed.shape[0]:
        return [(i, i) for i in range(len(shape))]
    known: dict[tuple[int, int], int] = {}

    def weigh(a: int, b: int) -> int | None:
        if a == b:
            return shapes[a][2]
        return 0 if shapes[a][0] != shapes[b][0] else known.get((a, b))

    def inner(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        x, y = sorted(set(a)), sorted(set(b))
        return np.searchsorted(x, a), np.searchsorted(y, b), x, y

    def weigh_all(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if weigh(a, b) is not None:
                todo.pop()
                continue
            ka, kb = shapes[a][1], shapes[b][1]
            lo, hi = _middle(ka, kb)
            total = 1 + sum(shapes[k][2] for k in ka[:lo]) + sum(shapes[k][2] for k in ka[len(ka) - hi :])
            ka, kb = ka[lo : len(ka) - hi], kb[lo : len(kb) - hi]
            if ka and kb:
                open_ = [(p, q) for p in set(ka) for q in set(kb) if weigh(p, q) is None]
                if open_:
                    todo += open_
                    continue
                if len(ka) == len(kb) == 1:
                    total += weigh(ka[0], kb[0])
                else:
                    i, j, x, y = inner(ka, kb)
                    total += int(_last_row(i, j, np.array([[weigh(p, q) for q in y] for p in x], np.int64))[-1])
            known[a, b] = total
            todo.pop()

    if seed.tags[0] != page.tags[0]:
        return []
    weigh_all(seed.shape[0], shape[0])
    out, todo = [], [(0, 0)]

    def take(a: list[int], b: list[int]) -> None:
        """Pairs of trees of one shape, node by node."""
        for i, j in zip(a, b, strict=True):
            size = shapes[shape[j]][2]
            out.extend(zip(range(i, i + size), range(j, j + size), strict=True))

    while todo:
        s, p = todo.pop()
        out.append((s, p))
        a, b = seed.kids[s], page.kids[p]
        sa, sb = [seed.shape[i] for i in a], [shape[q] for q in b]
        lo, hi = _middle(sa, sb)
        take(a[:lo], b[:lo])
        take(a[len(a) - hi :], b[len(b) - hi :])
        a, b, sa, sb = (x[lo : len(x) - hi] for x in (a, b, sa, sb))
        if len(a) == len(b) == 1:
            todo += zip(a, b, strict=True) if weigh(sa[0], sb[0]) else []
        elif a and b:
            i, j, x, y = inner(sa, sb)
            weight = np.array([[weigh(p, q) or 0 for q in y] for p in x], np.int64)
            todo += [(a[k], b[m]) for k, m in _heaviest(i, j, weight)]
    return out


def aligned(seed: Seed, page: Seed | Node) -> list[tuple[int, int, bool]]:
    """Matched pairs with a mark for equal non-empty own texts."""
    page = page if isinstance(page, Seed) else Seed(page)
    return [(s, p, page.sizes[p] > 0 and page.hashes[p] == seed.hashes[s] and page.sizes[p] == seed.sizes[s]) for s, p in tree_match(seed, page)]


def layout(root: Node) -> str:
    """A hash of the upper elements, equal neighbours counted once; '' for an empty page.

    Two levels below html and body count; these two may be nested or missing.
    """
    if not (root.kids or root.own()):
        return ""
    seen, todo = [], [(root, 2)]
    while todo:
        x, depth = todo.pop()
        seen.append((x, depth))
        if depth:
            todo += [(k, depth if k.tag in ("html", "body") else depth - 1) for k in x.kids if k.tag != "head"]
    done: dict[int, str] = {}
    for x, depth in reversed(seen):
        inner = [done[k.number] for k in x.kids if k.number in done] if depth else []
        inner = [a for a, b in zip(inner, [None, *inner], strict=False) if a != b]
        done[x.number] = xxhash.xxh64_hexdigest(f"{x.tag}({','.join(inner)})")
    return done[root.number]


def varying(pairs: list[tuple[int, int, bool]], page: Seed) -> dict[int, int]:
    """Characters of text other than the seed's by seed node; text of a page node that isn't matched counts for the
    matched one around it. What is never content or named like a bar doesn't count."""
    at = {p: (s, equal) for s, p, equal in pairs}
    out: dict[int, int] = {}
    around = [0] * len(page.tags)
    for p, size in enumerate(page.sizes):
        if page.flags[p]:  # so are all below
            continue
        s, equal = at.get(p, (around[page.parent[p]] if p else 0, False))
        around[p] = s
        if size and not equal:
            out[s] = out.get(s, 0) + size
    return out


def content_slot(seed: Seed, mass: dict[int, int], constant: dict[int, int]) -> tuple[int, int, frozenset[int]]:
    """The slot of the content, the end of the spine and the nodes in the slot that are left out, from the varying and
    the constant text counted at each node. The slot is -1 if nothing varies, ARTICLES if article and main elements
    hold at least half of what varies.
    """
    total, fixed = [0] * len(seed.tags), [0] * len(seed.tags)
    for i in range(len(seed.tags) - 1, -1, -1):
        total[i] = mass.get(i, 0) + sum(total[k] for k in seed.kids[i])
        fixed[i] = constant.get(i, 0) + sum(fixed[k] for k in seed.kids[i])
    if not total[0]:
        return -1, -1, frozenset()
    found, todo = 0, [0]
    while todo:
        i = todo.pop()
        if seed.tags[i] in ("article", "main") and not seed.flags[i]:
            found += total[i]
        else:
            todo += seed.kids[i]
    if 2 * found >= total[0]:
        return ARTICLES, -1, frozenset()
    at, drop = 0, set()
    while True:
        most = max(seed.kids[at], key=lambda i: total[i], default=None)
        if most is None or 2 * total[most] <= total[at]:
            break
        drop |= {k for k in seed.kids[at] if k != most and 0 < total[k] <= fixed[k]}
        at = most
    # the smallest node that holds the end of the spine and all other content
    slot = 0
    while slot != at:
        left = mass.get(slot, 0) + sum(total[k] > 0 for k in seed.kids[slot] if k not in drop)
        inner = next(k for k in seed.kids[slot] if _holds(seed, k, at))
        if left != 1 or mass.get(slot, 0):
            break
        slot = inner
    return slot, at, frozenset(drop)


def _holds(seed: Seed, outer: int, node: int) -> bool:
    while node > outer:
        node = seed.parent[node]
    return node == outer


def fits(seed: Seed, page: Seed, matched: int) -> bool:
    """Whether half of the smaller of the two trees was matched, the roots aside."""
    return matched >= 1 and 2 * (matched - 1) >= min(len(seed.tags), len(page.tags)) - 1


def _region(page: Seed) -> list[int]:
    """The outermost article or main elements that may be content, else the page."""
    found, todo = [], [0]
    while todo:
        i = todo.pop()
        if page.flags[i]:
            continue
        if page.tags[i] in ("article", "main"):
            found.append(i)
        else:
            todo += reversed(page.kids[i])
    return found or [0]


@dataclass
class Wrapper:
    """What was learned from the pages that fit a seed: its template nodes, its content slot (-1: none), the end of the
    spine and the nodes in the slot that are no content."""

    seed: Seed
    template: frozenset[int] = frozenset()
    slot: int = -1
    spine: int = -1
    drop: frozenset[int] = frozenset()


def main_text(page: str, wrapper: Wrapper | None = None) -> str:
    """The content of a page; without a wrapper markup alone decides."""
    root = parse(page)
    return _text(Seed.page(root, *pieces(root)), wrapper)


def _headings(page: Seed, regions: list[int]) -> set[int]:
    """The headings in article and main elements: they belong to what they stand over, also where they are constant."""
    return {i for r in regions if page.tags[r] in ("article", "main") for i in range(r, page.end(r)) if page.tags[i] in HEADINGS}


def _text(page: Seed, wrapper: Wrapper | None) -> str:
    skip: set[int] = set()
    regions = _region(page)
    if wrapper is not None and (wrapper.template or wrapper.slot != -1):
        pairs = aligned(wrapper.seed, page)
        skip = {p for s, p, equal in pairs if equal and s in wrapper.template}
        if wrapper.slot >= 0 and fits(wrapper.seed, page, len(pairs)):
            at = {s: p for s, p, _ in pairs}
            mine = at.get(wrapper.slot)
            if mine is not None and not page.flags[mine]:
                drop = {at[s] for s in wrapper.drop if s in at}
                inner = None if wrapper.seed.tags[wrapper.spine] in ("#page", "html", "body") else at.get(wrapper.spine)
                if text := page.text_of(mine, skip, drop, inner):
                    return text
    for left_out in (skip - _headings(page, regions), set()):
        # with nothing left out: a page all of whose slots are constant is a copy of the others, not a template without content
        if text := " ".join(x for x in (page.text_of(r, left_out, bars=r or None) for r in regions) if x):
            return text
    return ""


def _text_bytes(df: DataFrame, *columns: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(0)))).first()[0] or 0


class _Wrappers:
    """The wrappers of hosts: a broadcast map if they are small, else a column that is joined to the pages."""

    def __init__(self, spark: SparkSession, known: DataFrame):
        """known (host, layout, n, seed, template, slot, spine, dropped); a host's most common layout comes first."""
        ranked = F.sort_array(F.collect_list(F.struct("n", "layout", "seed", "template", "slot", "spine", "dropped")), asc=False).alias("wrappers")
        self.by_host = known.groupBy("host").agg(ranked)
        self.shared = None
        if _text_bytes(known, "host", "seed") + 4 * (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= MAX_SEED_BYTES:
            self.shared = spark.sparkContext.broadcast({r.host: [tuple(w) for w in r.wrappers] for r in self.by_host.collect()})

    def beside(self, pages: DataFrame, how: str) -> DataFrame:
        """pages with a column wrappers, null if they are broadcast; an inner join leaves hosts without wrappers out."""
        if self.shared is None:
            return pages.join(self.by_host, "host", how)
        return pages.withColumn("wrappers", F.lit(None).cast(self.by_host.schema["wrappers"].dataType))


#: parsed wrappers of this worker, by broadcast and contents
_known: dict[tuple, Wrapper] = {}


def _find(shared, host: str, joined: list | None, mine: str) -> tuple[str, Wrapper] | None:
    """The wrapper for a page of the layout `mine`, from the broadcast map or the wrappers column's value."""
    rows = (shared.value.get(host) or []) if shared is not None else [tuple(w.values()) for w in joined or []]
    if not rows or not mine:
        return None
    row = next((w for w in rows if w[1] == mine), rows[0])
    key = (row[2], tuple(row[3]), *row[4:6], tuple(row[6]))
    if key not in _known:
        if len(_known) > 2000:
            _known.clear()
        _known[key] = Wrapper(Seed(row[2]), frozenset(row[3]), row[4], row[5], frozenset(row[6]))
    return row[1], _known[key]


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), one row for each row of pages.

    Null and empty html give an empty text. Pages without a host (null url or no ://) are one host. Character
    references are decoded, white space is turned into one space, blocks are joined by one space in page order.
    Seeds to which fewer than MIN_PAGES pages fit have no template and no content slot. Pages may be of any length and
    nested to any depth; parsing is linear, the time of an alignment grows with the product of two lists of siblings of unlike
    shapes. Constant headings of article and main elements are content, other constant text of theirs is template.
    Repeated rows are pages like any other; further columns are ignored. Pages are parsed once; their
    skeletons and texts are written as a table. Seeds are broadcast if all together are under MAX_SEED_BYTES,
    else joined by host, where Spark splits hosts that have very many pages. Both ways give the same rows.
    """
    small_batches(spark)
    host, _ = split_url()
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [parse(t) for t in batch.column(4).to_pylist()]
            owners, texts = zip(*map(pieces, roots), strict=True) if roots else ((), ())
            columns = [pa.array([layout(r) for r in roots], pa.string()), pa.array([skeleton(r) for r in roots], pa.string())]
            columns += [pa.array(owners, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["page_id", "url", "host", "h", "layout", "seed", "owners", "texts"])

    kind = dict(pages.dtypes)["page_id"]
    parsed = own.select("page_id", "url", "host", F.xxhash64("html").alias("h"), "html")
    parsed = parsed.mapInArrow(outline, f"page_id {kind}, url string, host string, h long, layout string, seed string, owners array<int>, texts array<string>")
    parsed = table(spark, parsed, "parsed")
    outlines = parsed.where("layout <> ''").select("host", "h", "layout", "seed")
    kinds = outlines.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    kinds = table(spark, kinds, "layouts")
    hosts = kinds.groupBy("host").agg(F.sum("n").alias("total"), F.max(F.struct("n", "layout")).alias("most")).where(F.col("total") >= MIN_PAGES)
    common = (F.col("layout") == F.col("most.layout")) | ((F.col("n") >= MIN_PAGES) & (F.col("n") >= LAYOUT_SHARE * F.col("total")))
    first = table(spark, kinds.join(hosts, "host").where(common).select("host", "h", "layout", "n"), "first")
    small = _text_bytes(first, "host", "layout") + 16 * first.count() <= MAX_SEED_BYTES
    seeds = outlines.join(F.broadcast(first) if small else first, ["host", "h", "layout"]).dropDuplicates(["host", "layout"])
    seeds = table(spark, seeds.select("host", "layout", "n", "seed"), "seeds")
    none = F.array().cast("array<int>")
    counted = _Wrappers(spark, seeds.select("*", none.alias("template"), F.lit(-1).alias("slot"), F.lit(-1).alias("spine"), none.alias("dropped")))
    shared_seeds = counted.shared

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str, int], list[int]] = {}
            for h, mine, text, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _find(shared_seeds, h, joined, mine)
                if found is None:
                    continue
                own_ = Seed(text)
                pairs = aligned(found[1].seed, own_)
                if fits(found[1].seed, own_, len(pairs)):
                    for s in [-1, *(s for s, _, equal in pairs if equal)]:
                        x = total.setdefault((h, found[0], s), [0, 0, 0])
                        x[0] += 1
                        if s >= 0 and not found[1].seed.flags[s]:
                            x[2] += found[1].seed.sizes[s]
                    for s, size in varying(pairs, own_).items():
                        total.setdefault((h, found[0], s), [0, 0, 0])[1] += size
            if total:
                columns = [pa.array([k[i] for k in total], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                columns += [pa.array([v[i] for v in total.values()], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "node", "equal", "mass", "constant"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned: list[tuple] = []
            for seed, nodes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                fit = max((x["equal"] for x in nodes or [] if x["node"] < 0), default=0)
                if fit < MIN_PAGES:
                    learned.append(([], -1, -1, []))
                    continue
                template = {x["node"] for x in nodes if x["node"] >= 0 and x["equal"] >= SHARE * fit}
                slot, spine, drop = content_slot(Seed(seed), {x["node"]: x["mass"] for x in nodes if x["node"] >= 0}, {x["node"]: x["constant"] for x in nodes if x["node"] in template})
                learned.append((sorted(template), slot, spine, sorted(drop)))
            kinds_ = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            columns = [*batch.columns[:4], *(pa.array([x[i] for x in learned], t) for i, t in enumerate(kinds_))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "n", "seed", "template", "slot", "spine", "dropped"])

    paired = counted.beside(outlines, "inner").select("host", "layout", "seed", "wrappers")
    nodes = paired.mapInArrow(count, "host string, layout string, node int, equal long, mass long, constant long")
    nodes = nodes.groupBy("host", "layout", "node").agg(F.sum("equal").alias("equal"), F.sum("mass").alias("mass"), F.sum("constant").alias("constant"))
    nodes = nodes.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "equal", "mass", "constant")).alias("nodes"))
    # seeds without a template stay, so that a page takes the seed that it was counted with
    known = seeds.join(nodes, ["host", "layout"], "left").select("host", "layout", "n", "seed", "nodes")
    made = "host string, layout string, n long, seed string, template array<int>, slot int, spine int, dropped array<int>"
    known = table(spark, known.mapInArrow(decide, made), "wrappers")
    learned = _Wrappers(spark, known)
    shared_wrappers = learned.shared

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, mine, seed, owners, parts, w in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                found = _find(shared_wrappers, h, w, mine)
                texts.append(_text(Seed.page(seed, owners, parts), found[1] if found else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = learned.beside(parsed, "left").select("page_id", "url", "host", "layout", "seed", "owners", "texts", "wrappers")
    return rows.mapInArrow(take, f"page_id {kind}, url string, text string, n_chars long")
