"""Elements of HTML pages: of one page by a scan, of many pages by array operations over their bytes.

Most pages close their tags in order, so what encloses what follows from counts
of open tags alone. Such pages are read together, with no step per tag; a page
with anything else (a tag left open, closed by another or by itself, nested very
deep, quoted in an attribute, a cell that ends the one before) is scanned by
itself, with the same result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TAGS = ("div", "span", "table", "a", "tr", "th", "td")
# One scan of a page visits only these tags; comments and scripts are stepped over.
_TOKEN = re.compile(
    r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<(/?)(div|span|table|a|tr|th|td)\b([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
# What an opening tag ends, back to the innermost table.
_ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}


@lru_cache(maxsize=4096)
def attributes_of(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


class Element:
    """``start`` and ``end`` bound the content; ``parent`` is a position in the page's list, or -1."""

    __slots__ = ("tag", "attributes", "start", "end", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], start: int, end: int, parent: int) -> None:
        self.tag, self.attributes, self.start, self.end, self.parent = tag, attributes, start, end, parent


def has_class(attributes: dict[str, str], cls: str) -> bool:
    """A one-word class is one of the element's, a longer one is all of them."""
    own = attributes.get("class", "")
    return own == cls or (" " not in cls and cls in own.split())


def elements(html: str) -> list[Element]:
    """Elements of the page in document order, with what encloses them.

    Cells and rows may lack their end tag: the next one ends them.
    """
    found: list[Element] = []
    open_: list[int] = []
    # Per tag the depths at which it is open, so an end tag finds its opener, or that it has none, at once.
    depths: dict[str, list[int]] = defaultdict(list)

    def cut(depth: int, at: int) -> None:
        for i in open_[depth:]:
            found[i].end = at
            depths[found[i].tag].pop()
        del open_[depth:]

    def floor(tag: str) -> int:
        """Cells and rows end inside the innermost table only."""
        return depths["table"][-1] if tag in _ENDS and depths["table"] else -1

    for token in _TOKEN.finditer(html):
        closing, tag, attributes = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if depths[tag] and depths[tag][-1] > floor(tag):
                cut(depths[tag][-1], token.start())
            continue
        if tag in _ENDS:
            least = floor(tag)
            ends = [d[k] for d in map(depths.__getitem__, _ENDS[tag]) if (k := bisect_right(d, least)) < len(d)]
            if ends:
                cut(min(ends), token.start())
        found.append(Element(tag, attributes_of(attributes), token.end(), len(html), open_[-1] if open_ else -1))
        if not attributes.endswith("/"):
            depths[tag].append(len(open_))
            open_.append(len(found) - 1)
    return found


# --- many pages ----------------------------------------------------------------------

_SKIPPED = re.compile(r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>", re.I | re.S)
_TAG = re.compile(
    r"(?:(/?)(div|span|table|a|tr|th|td)\b(?:([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)\Z)?|(!--|(?:script|style)\b))", re.I | re.S
)
# What a name begins with: a letter of TAGS, script or style, the mark of a comment, or a letter that may stand for one of these.
_INITIAL = np.zeros(256, bool)
_INITIAL[[*b"dstaDSTA!", *range(128, 256)]] = True
DEEPEST = 64  # levels of open tags that are read together
AT_ONCE = 1 << 20  # bytes of pages that are read together, or one page


@dataclass
class Elements:
    """Elements of several pages, in their order; ``start`` and ``end`` are bytes of ``data``."""

    data: bytes
    page: np.ndarray
    tag: np.ndarray  # position in TAGS
    kind: np.ndarray  # position in ``attributes``
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray  # position of the element around, or -1
    attributes: list[dict[str, str]]  # the different ones

    def has(self, test) -> np.ndarray:
        """For each element whether its attributes pass."""
        return np.fromiter(map(test, self.attributes), bool, len(self.attributes))[self.kind]

    def is_tag(self, tag: str) -> np.ndarray:
        return self.tag == TAGS.index(tag)

    def around(self, marked: np.ndarray) -> np.ndarray:
        """For each element the nearest marked one that it lies in, or the number of elements."""
        n = len(marked)
        up = np.append(np.where(self.parent < 0, n, self.parent), n)
        near = np.where(np.append(marked, True), np.arange(n + 1), up)
        while True:
            further = near[near]
            if (further == near).all():
                return near[up[:n]]
            near = further

    def texts(self, which: np.ndarray) -> pa.Array:
        """What stands inside these elements."""
        return _cut(np.frombuffer(self.data, np.uint8), self.start[which], self.end[which], pa.string(), np.int32)


def slices(html: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of pages, each of about AT_ONCE bytes or of one page."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(html):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        yield at, upto
        at = upto


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """The C library's allocator keeps the memory of arrays up to the largest block given back so far; the rest it maps anew each time."""
    np.empty(31 << 20, np.uint8)


def read(html: pa.Array) -> Elements:
    """The elements of all pages; null counts as an empty page."""
    _keep_memory()
    pages = pc.fill_null(html.cast(pa.large_binary()), b"")
    _, offsets, content = pages.buffers()
    off = np.frombuffer(offsets, np.int64)[pages.offset : pages.offset + len(pages) + 1] if len(pages) else np.zeros(1, np.int64)
    # Only these pages' bytes: the buffer may hold a whole batch.
    data = content.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if content is not None else b""
    off = off - off[0]
    found, odd = _together(data, off)
    return _with_pages(found, off, odd) if odd.any() else found


@lru_cache(maxsize=4096)
def _tag(text: str) -> tuple[int, bool, bool, bool, dict[str, str]]:
    """Of what stands between "<" and ">": position in TAGS or -1, whether it closes, is to be scanned, hides what follows, attributes."""
    token = _TAG.match(text)
    if token is None:
        return -1, False, False, False, {}
    closing, name, attributes, hides = token.groups()
    if hides:
        return -1, False, False, True, {}
    # Quotes that go on behind the ">", letters that only count as equal, elements that are closed by themselves.
    if attributes is None or name.lower() not in TAGS or (not closing and attributes.endswith("/")):
        return 0, bool(closing), True, False, {}
    return TAGS.index(name.lower()), bool(closing), False, False, {} if closing else attributes_of(attributes)


def _together(data: bytes, off: np.ndarray) -> tuple[Elements, np.ndarray]:
    """The elements of the pages that close their tags in order, and which pages do not."""
    n, odd = len(data), np.zeros(len(off) - 1, bool)
    b = np.frombuffer(data + bytes(2), np.uint8)
    marks = np.flatnonzero((b == ord("<")) | (b == ord(">")))
    at = np.flatnonzero(b[marks] == ord("<"))
    lt, upto = marks[at], np.append(marks, n)[at + 1]
    whole = b[upto] == ord(">")
    bounds = np.searchsorted(lt, off)
    page = np.repeat(np.arange(len(odd)), np.diff(bounds))
    # The last tag of a page ends there.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    beyond = last[upto[last] >= off[1:][page[last]]]
    upto[beyond], whole[beyond] = off[1:][page[beyond]], False

    initial = b[lt + 1]
    may = _INITIAL[initial]
    slash = np.flatnonzero(initial == ord("/"))
    may[slash] = _INITIAL[b[lt[slash] + 2]]
    lt, upto, whole, page = _only(may, lt, upto, whole, page)

    # Each different tag is looked at once.
    texts = _between(data, lt + 1, upto).dictionary_encode()
    kind, different = texts.indices.to_numpy(), [_tag(t) for t in texts.dictionary.to_pylist()]
    tags, closes, scans, hides = np.array([t[:4] for t in different], np.int8).reshape(-1, 4).T
    attributes = [t[4] for t in different]
    keep = (tags >= 0)[kind]
    # Comments and scripts are stepped over.
    if hides.any():
        keep &= ~_hidden(data, off, np.unique(page[(hides != 0)[kind]]), lt)
    lt, upto, whole, page, kind = _only(keep, lt, upto, whole, page, kind)
    # A tag that another one follows before its end, or that has none in its page.
    odd[page[~whole | (scans != 0)[kind]]] = True

    def of_good(*arrays: np.ndarray) -> list[np.ndarray]:
        return _only(~odd[page], *arrays) if odd.any() else list(arrays)

    lt, upto, kind, page = of_good(lt, upto, kind, page)
    closing = (closes != 0)[kind]
    depth, unequal = _levels(page, closing)
    odd[page[(depth < 1) | (depth > DEEPEST)]] = True
    odd[unequal] = True
    lt, upto, kind, closing, depth, page = of_good(lt, upto, kind, closing, depth, page)
    tag, depth = tags[kind], depth.astype(np.int8)
    # On each level of a page, tags open and close by turns.
    end = np.empty(len(lt), np.int64)
    for level in range(1, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == level)
        first, last = here[0::2], here[1::2]
        odd[page[first[tag[first] != tag[last]]]] = True
        end[first] = lt[last]
    tag, kind, upto, depth, page, end = _only(~closing, tag, kind, upto, depth, page, end)
    parent = _parents(depth)
    odd[page[_ends_another(tag, parent)]] = True
    if odd.any():
        parent = _placed(parent, ~odd[page])
    tag, kind, upto, page, end = of_good(tag, kind, upto, page, end)
    return Elements(data, page, tag, kind, upto + 1, end, parent, attributes), odd


def _only(marked: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    if marked.all():
        return list(arrays)
    which = np.flatnonzero(marked)
    return [x[which] for x in arrays]


def _hidden(data: bytes, off: np.ndarray, pages: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions lie in a comment or script of these pages."""
    starts, ends = [], []
    for p in pages.tolist():
        low = int(off[p])
        html = data[low : off[p + 1]].decode()
        bounds = np.array([m.span() for m in _SKIPPED.finditer(html)], np.int64).reshape(-1, 2)
        bounds = low + _byte_places(html, bounds)
        starts.append(bounds[:, 0])
        ends.append(bounds[:, 1])
    starts, ends = np.append(np.concatenate(starts), off[-1]), np.append(0, np.concatenate(ends))
    # The last one that starts at or before a position has not ended yet.
    return at < ends[np.searchsorted(starts[:-1], at, "right")]


def _byte_places(html: str, places: np.ndarray) -> np.ndarray:
    """Positions of characters as positions of bytes."""
    if html.isascii():
        return places
    codes = np.frombuffer(html.encode("utf-32-le"), np.uint32)
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return np.append(0, np.cumsum(sizes))[places]


def _levels(page: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of each tag in its page, from 1, that of an end tag being that of the tag it closes; pages with more of one kind."""
    if not len(page):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    count = np.cumsum(1 - 2 * closing.view(np.int8), dtype=np.int32)
    begins = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    bounds = np.append(0, count)[np.append(begins, len(page))]
    level = count + closing - np.repeat(bounds[:-1], np.diff(np.append(begins, len(page))))
    return level, page[begins[bounds[1:] != bounds[:-1]]]


def _parents(depth: np.ndarray) -> np.ndarray:
    """Of elements in order: the last one before that is a level higher."""
    parent = np.full(len(depth), -1, np.int64)
    for level in range(2, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == level)
        # An element right behind its parent is the first child; others have the parent of the one before on their level.
        first = depth[here - 1] < level
        parent[here] = (here[first] - 1)[np.cumsum(first) - 1]
    return parent


def _ends_another(tag: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Cells and rows that stand in one they end, inside the innermost table."""
    number = TAGS.index
    found = [np.empty(0, np.int64)]
    for t, ended in _ENDS.items():
        cells = np.flatnonzero(tag == number(t))
        up = parent[cells]
        while len(cells):
            inside = (up >= 0) & (tag[up] != number("table"))
            cells, up = cells[inside], up[inside]
            hit = np.isin(tag[up], [number(x) for x in ended])
            found.append(cells[hit])
            cells, up = cells[~hit], parent[up[~hit]]
    return np.concatenate(found)


def _placed(parent: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Parents among the good ones, which have good parents."""
    place = np.cumsum(good) - 1
    parent = parent[good]
    return np.where(parent < 0, -1, place[parent])


def _between(data: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between these positions as texts; none begins before the one before has ended."""
    bounds = np.column_stack((start, end)).ravel()
    if not len(bounds):
        return pa.array([], pa.large_string())
    # What lies between them are the other texts of an array over the same bytes.
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers).take(pa.array(np.arange(0, len(bounds), 2)))


def _cut(b: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType, place: type) -> pa.Array:
    """The bytes between these positions as texts."""
    sizes = end - start
    ends = np.cumsum(sizes)
    content = b[np.repeat(start - ends + sizes, sizes) + np.arange(sizes.sum())]
    buffers = [None, pa.py_buffer(np.append(0, ends).astype(place)), pa.py_buffer(content)]
    return pa.Array.from_buffers(kind, len(sizes), buffers)


def _with_pages(found: Elements, off: np.ndarray, odd: np.ndarray) -> Elements:
    """``found`` with the elements of these pages, read one by one."""
    columns: list[list] = [[] for _ in range(6)]
    n, attributes = len(found.page), list(found.attributes)
    for p in np.flatnonzero(odd).tolist():
        html = found.data[off[p] : off[p + 1]].decode()
        own = elements(html)
        first, here = n + len(columns[0]), int(off[p])
        bounds = here + _byte_places(html, np.array([(e.start, e.end) for e in own], np.int64).reshape(-1, 2))
        values = (
            [p] * len(own), [TAGS.index(e.tag) if e.tag in TAGS else -1 for e in own],
            range(len(attributes), len(attributes) + len(own)), bounds[:, 0].tolist(), bounds[:, 1].tolist(),
            [e.parent + first if e.parent >= 0 else -1 for e in own],
        )
        for column, more in zip(columns, values):
            column.extend(more)
        attributes.extend(e.attributes for e in own)
    own = (found.page, found.tag, found.kind, found.start, found.end, found.parent)
    page, tag, kind, start, end, parent = (np.append(a, np.array(c, np.int64)) for a, c in zip(own, columns))
    order = np.argsort(page, kind="stable")
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    return Elements(found.data, page[order], tag[order], kind[order], start[order], end[order], place[parent[order]], attributes)
