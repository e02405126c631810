"""HTML pages: sold listings, tournament search results, deck pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars, tagger
from marketloom.sources.elements import Elements, has_class, read, slices
from marketloom.sources.elements import elements as _elements  # noqa: F401 - of one page

# Markup of the pages.
ITEM_CLASS = "s-item__info clearfix"
TITLE_CLASS = "s-item__title"
DATE_BOX_CLASS = "s-item__title--tag"
DATE_CLASS = "POSITIVE"
PRICE_BOX_CLASS = "s-item__price"
SHIPPING_CLASS = "s-item__shipping s-item__logisticsCost"
DECK_MARK = "/deck/"
DECK_BOX = ("div", "id", "tab-paper")
CARD_LINK, CARD_COUNT = ("a", "rel", "popover"), ("td", "class", "text-right")
# End of fixed values.

LISTING_FIELDS = {
    "position": "int",
    "title": "string",
    "date_text": "string",
    "spans": "array<struct<cls:string,text:string>>",
    "shipping_text": "string",
}
CARD_FIELDS = {"cardname": "string", "cardquant": "int"}

_ANY_TAG = re.compile(r"<[^>]*>")
# Texts that a cast takes for an integer, of any size.
_INTEGER = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z"
# The same in Python: sign and digits, of which more than ten are too many.
_DIGITS = re.compile(r"[\x00-\x20\x7f]*([+-]?)0*([0-9]{1,10})[\x00-\x20\x7f]*")
_ONE_CHILD = re.compile(r"<([a-z][\w-]*)\b[^>]*>(.*)</\1\s*>", re.I | re.S)


def _plain_text(markup: str) -> str:
    return unescape(_ANY_TAG.sub("", markup) if "<" in markup else markup)


def _only_text(markup: str) -> str | None:
    """The text of an element whose only child is a text, or an element of that kind; else none."""
    while "<" in markup:
        child = _ONE_CHILD.fullmatch(markup)
        if child is None:
            return None
        markup = child[2]
    return unescape(markup) or None


def _items_of(html: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of all items but the first of each page: the page, and the columns LISTING_FIELDS."""
    e = read(html)
    none = len(e.page)
    has = lambda cls: e.has(lambda own: has_class(own, cls))
    div, span = e.is_tag("div"), e.is_tag("span")
    is_item, price_box = div & has(ITEM_CLASS), span & has(PRICE_BOX_CLASS)
    item, date_box = e.around(is_item), e.around(has(DATE_BOX_CLASS) & ~is_item)
    price = e.around(is_item | price_box)  # the price box, if not the item
    inside = (item < none) & ~is_item
    shipping = inside & span & ~price_box & has(SHIPPING_CLASS)
    other = inside & span & ~price_box & ~has(SHIPPING_CLASS)

    def first(marked: np.ndarray) -> np.ndarray:
        """By item, the first marked element in it."""
        of, at = np.full(none + 1, none), np.flatnonzero(marked)[::-1]
        of[item[at]] = at
        return of

    spans = other & (price < none) & (price == first(inside & price_box)[item]) & e.has(lambda own: "class" in own)
    spans &= ~np.append(is_item, False)[price]
    dates = other & ~spans & has(DATE_CLASS) & (date_box < none)

    items = np.flatnonzero(is_item)
    page = e.page[items]
    position = np.arange(len(items)) - np.searchsorted(page, page)
    items, page, position = (x[position > 0] for x in (items, page, position))

    def texts(marked: np.ndarray, read_text) -> pa.Array:
        at = first(marked)[items]
        there = at < none
        return _each(e.texts(at[there]), read_text).take(pa.array(np.cumsum(there) - 1, mask=~there))

    # Spans in the order of their items; an item may lie in another one.
    of = np.flatnonzero(spans)
    of = of[np.isin(item[of], items)]
    of = of[np.argsort(item[of], kind="stable")]
    counts = np.bincount(np.searchsorted(items, item[of]), minlength=len(items))
    classes = pa.array([own.get("class") for own in e.attributes], pa.string()).take(pa.array(e.kind[of]))
    written = pa.StructArray.from_arrays([classes, _each(e.texts(of), _plain_text)], ["cls", "text"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), written)
    title = texts(inside & div & has(TITLE_CLASS), _only_text)
    title = pc.if_else(pc.equal(title, ""), None, title)
    return page, [pa.array(position, pa.int32()), title, texts(dates, _plain_text), lists, texts(shipping, _plain_text)]


def _each(texts: pa.Array, read_text) -> pa.Array:
    """``read_text`` of each text; one without markup or references it leaves as it is."""
    special = pc.or_(pc.match_substring(texts, "<"), pc.match_substring(texts, "&"))
    found = [read_text(t) for t in texts.filter(special).to_pylist()]
    return pc.replace_with_mask(texts, special, pa.array(found, pa.string())) if found else texts


def listing_items(pages: DataFrame) -> DataFrame:
    """The raw texts of each item of ``html``, beside the page's other columns; item 0 of a page is skipped.

    A title with markup beside its text counts as missing.
    """
    return _rows(pages, _items_of, LISTING_FIELDS)


def _rows(pages: DataFrame, read_rows: Callable[[pa.Array], tuple[np.ndarray, list[pa.Array]]], fields: dict[str, str]) -> DataFrame:
    """The rows, with their pages, that ``read_rows`` takes from many pages, beside the page's other columns."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields if f.name != "html"}
    keys = list(types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            page, columns = read_rows(part.column("html"))
            kept = part.select(keys).take(pa.array(page))
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*keys, *fields])

    schema = ", ".join(f"`{k}` {t}" for k, t in (types | fields).items())
    return pages.select(*keys, "html").mapInArrow(parse, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their pages are long."""
    for batch in batches:
        for low, high in slices(batch.column("html")):
            yield batch.slice(low, high - low)


def typed_items(items: DataFrame) -> DataFrame:
    """Raw texts of items as typed values: day, sale type, price and shipping."""
    values = {
        "carddate": scalars.sold_date(F.col("date_text")),
        "saletype": F.col("_sale.saletype"),
        "price": scalars.numeric_text(F.col("_sale.text")),
        "shipping": scalars.shipping_amount(F.col("shipping_text")),
    }
    # The span that counts is looked for once.
    sold = items.withColumn("_sale", tagger.by_price_class(F.col("spans")))
    return sold.withColumns(values).drop("date_text", "spans", "shipping_text", "_sale")


def listing_rows(pages: DataFrame) -> DataFrame:
    """Items that have a title, with typed values."""
    rows = typed_items(listing_items(pages.select("page_id", "html"))).filter(F.col("title").isNotNull())
    return rows.select("page_id", "position", "title", "carddate", "saletype", "price", "shipping")


def hrefs(html: Column) -> Column:
    """Every link target, in page order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("position", "href"))


def result_rows(pages: DataFrame) -> DataFrame:
    """Rows of a search-result table: day, link and title; the header row is skipped."""
    rows = pages.select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("position", "row"),
    )
    return rows.filter(F.col("position") > 0).select(
        "page_id",
        "position",
        F.regexp_extract("row", r'(?is)<a\b[^>]*href="([^"]*)"', 1).alias("href"),
        F.regexp_extract("row", r"(?is)<td\b[^>]*>([^<]*)", 1).alias("entrydate"),
        F.regexp_extract("row", r"(?is)<a\b[^>]*>([^<]*)", 1).alias("tourntitle"),
    )


Wanted = tuple[str, str | None, str | None]  # tag, attribute, one of its words


def _inside(html: pa.Array, container: Wanted, wanted: list[Wanted]) -> tuple[Elements, list[np.ndarray]]:
    """The elements of all pages, and which are the wanted ones inside the first matching container of their page."""
    e = read(html)

    def matches(want: Wanted) -> np.ndarray:
        tag, attribute, value = want
        return e.is_tag(tag) & e.has(lambda own: attribute is None or value in own.get(attribute, "").split())

    regions = np.flatnonzero(matches(container))
    pages, first = np.unique(e.page[regions], return_index=True)
    low, high = np.zeros(len(html), np.int64), np.zeros(len(html), np.int64)
    low[pages], high[pages] = e.start[regions[first]], e.end[regions[first]]
    inside = (low[e.page] <= e.start) & (e.start < high[e.page])
    inside[regions[first]] = False
    return e, [np.flatnonzero(inside & matches(want)) for want in wanted]


def _in_region(html: pa.Array, container: Wanted, wanted: list[Wanted], read_texts) -> list[pa.Array]:
    """By page, lists of what ``read_texts`` takes from the wanted elements inside the first matching container."""
    e, found = _inside(html, container, wanted)

    def lists(which: np.ndarray) -> pa.Array:
        counts = np.bincount(e.page[which], minlength=len(html))
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        return pa.ListArray.from_arrays(ends, read_texts(e, which))

    return [lists(which) for which in found]


def _cards_of(html: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of all pairs of a name and a count: the page, and the columns CARD_FIELDS."""
    e, (links, cells) = _inside(html, DECK_BOX, [CARD_LINK, CARD_COUNT])
    counts = _whole_numbers(_first_texts(e, cells))
    whole = counts.is_valid()
    counts, cells = counts.filter(whole), cells[whole.to_numpy(zero_copy_only=False)]

    def paired(which: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Those that have one of the others at their place in the page."""
        page, other = e.page[which], np.bincount(e.page[others], minlength=len(html))
        own = np.bincount(page, minlength=len(html))
        return np.arange(len(which)) - (np.cumsum(own) - own)[page] < other[page]

    named, counted = links[paired(links, cells)], paired(cells, links)
    return e.page[named], [_first_texts(e, named), counts.filter(pa.array(counted))]


def _first_texts(e: Elements, which: np.ndarray) -> pa.Array:
    """Of each element the text before the first one inside."""
    return _each(e.texts(which), lambda text: unescape(text.partition("<")[0]))


def _targets(e: Elements, which: np.ndarray) -> pa.Array:
    return pa.array([e.attributes[k].get("href") for k in e.kind[which].tolist()], pa.string())


def _page_lists(pages: DataFrame, container, wanted, read_texts, schema: str) -> DataFrame:
    """Per page, the arrays ``read_texts`` takes from the wanted elements."""
    fields = [f.split()[0] for f in schema.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields if f.name != "html"}
    keys = list(types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            lists = _in_region(part.column("html"), container, wanted, read_texts)
            yield pa.RecordBatch.from_arrays([*part.select(keys).columns, *lists], names=[*keys, *fields])

    full = ", ".join([f"`{k}` {t}" for k, t in types.items()] + [schema])
    return pages.select(*keys, "html").mapInArrow(parse, full)


def deck_links(pages: DataFrame, mark: str = DECK_MARK) -> DataFrame:
    """Links of the result table that lead to a deck, beside the page's other columns."""
    keys = [c for c in pages.columns if c != "html"]
    lists = _page_lists(
        pages,
        ("table", "class", "table-tournament"),
        [("a", None, None)],
        _targets,
        "hrefs array<string>",
    )
    links = lists.select(*keys, F.posexplode("hrefs").alias("position", "href"))
    return links.filter(F.contains(F.lower("href"), F.lit(mark)))


def whole_numbers(texts: Column) -> Column:
    """The integers among the texts, in their order; others are left out before the cast, which is slow to refuse them."""
    written = F.filter(texts, lambda t: t.rlike(_INTEGER))
    return F.filter(F.transform(written, lambda t: t.try_cast("int")), lambda n: n.isNotNull())


@lru_cache(maxsize=4096)
def _whole_number(text: str) -> int | None:
    digits = _DIGITS.fullmatch(text)
    number = int(digits[1] + digits[2]) if digits else None
    return number if digits and -(2**31) <= number < 2**31 else None


def _whole_numbers(texts: pa.Array) -> pa.Array:
    """Of each text the integer that ``whole_numbers`` takes it for, or null; each different text is read once."""
    different = texts.dictionary_encode()
    return pa.array(map(_whole_number, different.dictionary.to_pylist()), pa.int32()).take(different.indices)


def deck_cards(pages: DataFrame) -> DataFrame:
    """Cards of a deck page: names and counts are parallel lists.

    Of a cell or link the text before any element inside counts. Counts that are
    no integers are left out first; a pair needs both sides, so the longer list
    is cut to the shorter one.
    """
    return _rows(pages, _cards_of, CARD_FIELDS)
