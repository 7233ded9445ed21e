"""Pages as trees of blocks, and simple tree matching between two of them."""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"caption", "tbody", "tfoot", "thead", "tr", "legend", "summary", "body", "html", "head"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody"}}
SCOPE = frozenset("ul ol dl menu table".split())

# Words of tags, classes, ids and roles that mark what is not the article.
NOT_CONTENT_TAGS = frozenset("head nav aside footer form menu dialog button select fieldset".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies discussion disqus footer login masthead menu modal nav navbar navigation newsletter notice overlay pager "
    "pagination popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget complementary contentinfo search alert".split()
)
NEGATIONS = frozenset("no has with without".split())
REGION_WORDS = frozenset(["articlebody", "main"])

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_MARKS = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(slots=True)
class Block:
    """A block element: its label for matching, its children, and in order its texts and children."""

    label: str
    parent: Block | None
    excluded: bool
    region: bool
    children: list[Block] = field(default_factory=list)
    parts: list[str | Block] = field(default_factory=list)
    slot: int = -1


class LinkText(str):
    """A run of text inside a link."""


def _attributes(source: str) -> dict[str, str]:
    if "=" not in source and not source.strip(" /"):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(source)}


def _open(tag: str, attributes: dict[str, str], parent: Block) -> Block:
    marks = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower()
    words = re.split(r"[^a-z0-9]+", marks)
    named = any(w in NOT_CONTENT_WORDS and words[i - 1] not in NEGATIONS for i, w in enumerate(words))
    region = tag in ("article", "main") or attributes.get("role") == "main" or (
        attributes.get("itemprop", "").lower() in REGION_WORDS
    )
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    )
    inside = parent.region
    is_header = not inside and (tag == "header" or "header" in words)
    out = tag in NOT_CONTENT_TAGS or hidden or is_header
    if named and tag not in ("html", "body", "main") and not (tag == "article" and "comment" not in words and "comments" not in words):
        out = True
    excluded = parent.excluded or out
    # words with digits (post-123) differ from page to page and would keep equal places apart
    stable = [w for w in attributes.get("class", "").lower().split() if not any(c.isdigit() for c in w)]
    return Block(f"{tag}.{' '.join(stable)}", parent, excluded, (inside or region) and not excluded)


def parse(source: str) -> Block:
    """The tree of block elements. Unclosed and crossed tags are mended as browsers do, in the simplest cases."""
    root = Block("", None, False, False)
    now, names = root, [""]  # names: open block elements, from the root to ``now``
    quiet: list[str] = []  # open inline elements whose text is left out
    link = 0  # number of open blocks when a link was opened, 0 outside of links
    at, size = 0, len(source)
    while at < size:
        less = source.find("<", at)
        if less < 0:
            less = size
        if less > at and not quiet:
            now.parts.append(LinkText(source[at:less]) if link else source[at:less])
        if less == size:
            break
        following = source[less + 1 : less + 2]
        if following == "!":
            if source.startswith("<!--", less):
                end = source.find("-->", less + 4)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", less)
                at = size if end < 0 else end + 1
            continue
        if following == "?":
            end = source.find(">", less)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(source, less)
        if tag is None:
            if following.isalpha() or following == "/":  # a tag without its end, or an end tag without a name
                end = source.find(">", less)
                at = size if end < 0 else end + 1
            else:
                if not quiet:
                    now.parts.append("<")
                at = less + 1
            continue
        at, closing, name = tag.end(), bool(tag[1]), tag[2].lower()
        if name in RAW and not closing:
            if not tag[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = size if end is None else end.end()
            continue
        if name not in BLOCK:
            if name in ("br", "td", "th", "option") and not quiet:
                now.parts.append(" ")
            if name == "a":
                link = 0 if closing else len(names)
            if name in ("button", "select", "label") and not closing:
                quiet.append(name)
            elif closing and quiet and quiet[-1] == name:
                quiet.pop()
            continue
        quiet.clear()
        if name == "hr":
            now.parts.append(Block("hr", now, now.excluded, now.region))
            continue
        if closing:
            if name in names[1:]:
                while True:
                    closed = names.pop()
                    now = now.parent
                    if closed == name:
                        break
                link = link if link <= len(names) else 0
            continue
        if name in CLOSES_P and names[-1] == "p":
            names.pop()
            now = now.parent
        ends = SAME_ENDS.get(name)
        if ends:
            depth = len(names) - 1
            while depth > 0 and names[depth] not in ends and names[depth] not in SCOPE:
                depth -= 1
            if depth > 0 and names[depth] in ends:
                while len(names) > depth:
                    names.pop()
                    now = now.parent
        child = _open(name, _attributes(tag[3]), now)
        now.children.append(child)
        now.parts.append(child)
        if not tag[3].rstrip().endswith("/") or name not in VOID:
            names.append(name)
            now = child
    return root


def numbered(root: Block) -> Block:
    """The tree with every block's position in page order as its slot."""
    todo, number = [root], 0
    while todo:
        block = todo.pop()
        block.slot = number
        number += 1
        todo.extend(reversed(block.children))
    return root


def layout(root: Block) -> int:
    """A number for the page's frame: the labels of the blocks below the body, in order of their first appearance."""
    body = root
    while len(body.children) == 1 or any(c.label.startswith("body.") for c in body.children):
        body = next((c for c in body.children if c.label.startswith("body.")), body.children[0])
    return zlib.crc32("\n".join(dict.fromkeys(c.label for c in body.children)).encode("utf-8", "replace"))


def is_empty(root: Block) -> bool:
    """Whether the page has no text but white space."""
    todo = [root]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, Block):
                todo.append(part)
            elif part.strip():
                return False
    return True


def _shapes(root: Block, known: dict[tuple, int], children: list[tuple[int, ...]]) -> dict[int, int]:
    """A number for each block's labels down to ``DEEPEST`` levels: equal numbers, equal subtrees."""
    order, todo = [], [(root, 0)]
    while todo:
        block, depth = todo.pop()
        order.append((block, depth))
        if depth < DEEPEST:
            todo.extend((c, depth + 1) for c in block.children)
    found: dict[int, int] = {}
    for block, depth in reversed(order):
        below = tuple(found[id(c)] for c in block.children) if depth < DEEPEST else ()
        key = (block.label, below)
        if key not in known:
            known[key] = len(children)
            children.append(below)
        found[id(block)] = known[key]
    return found


def _same_ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
    """How many shapes are equal from the front, and how many of the rest from the back.

    Some largest matching pairs them: nothing matches a subtree better than its equal, and pairing the outermost of two
    lists keeps no other pair from being made but those it can stand for.
    """
    most = min(len(x), len(y))
    first = 0
    while first < most and x[first] == y[first]:
        first += 1
    last = 0
    while last < most - first and x[-1 - last] == y[-1 - last]:
        last += 1
    return first, last


def _last_row(weights: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The row of best sums after the children ``a``, from the row before them."""
    for i in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[i, b]))
        row = new
    return row


def _pairs(weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of an order-keeping matching of two child lists with the largest sum of weights.

    Rows are kept at every root of their number and computed again between them, so memory grows with the children, not
    with their product.
    """
    step = max(1, math.isqrt(len(a)))
    kept = [np.zeros(len(b) + 1, np.int32)]
    for i in range(0, len(a), step):
        kept.append(_last_row(weights, a[i : i + step], b, kept[-1]))
    found, j = [], len(b)
    for block in range(len(kept) - 2, -1, -1):
        first = block * step
        rows = [kept[block]]
        for i in a[first : first + step]:
            rows.append(_last_row(weights, np.array([i]), b, rows[-1]))
        i = len(rows) - 1
        while i and j:
            w = weights[a[first + i - 1], b[j - 1]]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                found.append((first + i - 1, j - 1))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j = int(np.searchsorted(rows[i], rows[i][j]))  # the first place with this sum
        if not j:
            break
    return found


class Reference:
    """A numbered page that others are aligned with; what is learnt of shapes and their matches serves all of them."""

    def __init__(self, root: Block):
        self.root = root
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple, int] = {}
        self.children: list[tuple[int, ...]] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.labels: list[str] = []
        self.nodes: list[int] = []  # of each shape: what it has in common with itself
        self.shapes = self._shapes(self.root)

    def _shapes(self, root: Block) -> dict[int, int]:
        found = _shapes(root, self.known, self.children)
        self.labels.extend(key[0] for key in islice(self.known, len(self.labels), None))
        for below in self.children[len(self.nodes) :]:
            self.nodes.append(1 + sum(self.nodes[c] for c in below))
        return found

    def _tables(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights by distinct shapes, and both child lists as places in them."""
        ux, ix = np.unique(x, return_inverse=True)
        uy, iy = np.unique(y, return_inverse=True)
        weights = np.array([[self._size(int(p), int(q)) for q in uy] for p in ux], np.int32)
        return weights, ix, iy

    def _size(self, p: int, q: int) -> int:
        """Matched blocks of two subtrees."""
        if p == q:
            return self.nodes[p]
        if self.labels[p] != self.labels[q]:
            return 0
        x, y = self.children[p], self.children[q]
        if not x or not y:
            return 1
        if (p, q) not in self.sizes:
            first, last = _same_ends(x, y)
            found = 1 + sum(self.nodes[c] for c in (*x[:first], *x[len(x) - last :]))
            x, y = x[first : len(x) - last], y[first : len(y) - last]
            if x and y:
                weights, ix, iy = self._tables(x, y)
                found += int(_last_row(weights, ix, iy, np.zeros(len(iy) + 1, np.int32))[-1])
            self.sizes[p, q] = found
        return self.sizes[p, q]

    def align(self, page: Block) -> None:
        """Simple tree matching: gives every matched block of ``page`` the slot of its partner in the reference.

        Two blocks match if their labels are equal; the largest order-keeping set of matches below them is found by
        dynamic programming over their children. Equal subtrees are compared once. Trees deeper than ``DEEPEST`` are
        matched down to that depth.
        """
        if len(self.known) > MOST_SHAPES:
            self._forget()
        own = self._shapes(page)
        todo = [(self.root, page, 0)]
        while todo:
            a, b, depth = todo.pop()
            if a.label != b.label:
                continue
            b.slot = a.slot
            if a.children and b.children and depth < DEEPEST:
                x, y = tuple(self.shapes[id(c)] for c in a.children), tuple(own[id(c)] for c in b.children)
                first, last = _same_ends(x, y)
                m, n = len(x) - last, len(y) - last
                pairs = [(i, i) for i in range(first)] + [(m + i, n + i) for i in range(last)]
                if first < m and first < n:
                    weights, ix, iy = self._tables(x[first:m], y[first:n])
                    pairs += [(first + i, first + j) for i, j in _pairs(weights, ix, iy)]
                todo.extend((a.children[i], b.children[j], depth + 1) for i, j in pairs)


def align(reference: Block, page: Block) -> None:
    """``Reference.align`` for a single page."""
    Reference(reference).align(page)


MOST_SHAPES = 100_000  # remembered by a reference
DEEPEST = 60


def _slot(block: Block) -> int:
    """The block's slot; for a block without one a negative number for its path below the nearest block that has one."""
    if block.slot >= 0:
        return block.slot
    path = []
    while block is not None and block.slot < 0:
        path.append(block.label)
        block = block.parent
    return _number(f"{-1 if block is None else block.slot}|{'>'.join(path)}")


def _number(mark: str) -> int:
    return -1 - (zlib.crc32(mark.encode("utf-8", "replace")) >> 1)


def texts(root: Block) -> list[tuple[int, int, bool, bool, str, int]]:
    """Every run of text between block boundaries, in page order: its slot, its kin (a number that all blocks of one
    label below one slot share), whether it is excluded or in the article, the text, and its characters in links."""
    found: list[tuple[int, int, bool, bool, str, int]] = []
    todo: list[tuple[Block, int]] = [(root, 0)]
    while todo:
        block, at = todo.pop()
        run: list[str] = []
        while at < len(block.parts) and isinstance(block.parts[at], str):
            run.append(block.parts[at])
            at += 1
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                linked = " ".join(html.unescape("".join(r for r in run if isinstance(r, LinkText))).split())
                kin = _number(f"{_slot(block.parent) if block.parent else -1}:{block.label}")
                found.append((_slot(block), kin, block.excluded, block.region, text, min(len(linked), len(text))))
        if at < len(block.parts):
            todo.append((block, at + 1))
            todo.append((block.parts[at], 0))
    return found
