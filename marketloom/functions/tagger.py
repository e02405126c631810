"""Listing tagger: sale title -> attributes, as native column expressions.

``strict=True`` matches whole words and reads the grading guard the way it was
probably meant; the default follows plain substring matching.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.functions.binding import bind

# The words results depend on, in order of precedence.
QUANTITY_PATTERNS = ("({n})", "×{n}", "{n}×", "{n} ×", "× {n}", "x{n}", "{n}x", "x {n}", "{n} x", "*{n}*")
LARGEST_QUANTITY = 8
LOT_WORDS = ("lot ", " lot ", " lot", "bundle ", " bundle ", " bundle")
GRADE_WORDS = (" PSA ", " Beckett ", " BGS ", " CGC ", "grade")
LANGUAGES = ("english", "korean", "japanese", "chinese", "russian", "spanish")
CONDITIONS = (
    "NM", "LP", "MP", "HP", "Mint", "Lightly Played", "Moderately Played", "Heavily Played", "Damage",
)
SPECIAL_WORDS = (
    "time shifted", "timeshifted", "SDCC", "ugins fate", "wall scroll", "ugin's fate", "summer magic", "proxy",
    "not real", "stained glass", "stained-glass", "borderless", "factory sealed", "godzilla", " plus ",
    "apocalyplse", "showcase", "promo", "expedition", "masterpiece", "mythic edition", "apocalypse", "invocation",
    "invention", "extended art", "constellation", "altered", "minature", "full art", "secret lair",
    "stained glass", "miscut", "alternate art", "alt art", "anime", "poster", "signed", "painted", "custom",
    "alter", "art card", "art series", "comic-con", "comic con", "world magic cup", "ext art", "ext. art",
    "Alter", "autograph", "auto", "extended", "mystery", "50%", "box topper", "boxtopper", "signature spellbook",
    "shirt", "not tournament legal", "damaged", "generic", "checklist", "collection", "assorted", "odyssey",
    "prerelease", "pre-release", "arena code", "game day", "extend art",
)
# End of fixed values.


def _hit(text: Column, word: str, strict: bool) -> Column:
    if strict:
        return text.rlike(r"(?<!\w)" + re.escape(word.strip().lower()) + r"(?!\w)")
    return F.contains(text, F.lit(word.lower()))


def _first_hit(text: Column, name: Column | None, words: list[tuple[Column, str]], strict: bool) -> Column:
    """Value of the first word found in ``text`` and not in ``name``.

    Words sit in one array and a filter walks it, so the expression stays flat
    however long the list is.
    """
    if strict:
        hits = [F.when(_hit(text, w, True) & (~_hit(name, w, True) if name is not None else F.lit(True)), v) for v, w in words]
        return F.coalesce(*hits)
    table = F.array(*[F.struct(v.alias("value"), F.lit(w.lower()).alias("word")) for v, w in words])

    if name is None:
        return bind(lambda t: F.get(F.filter(table, lambda w: F.contains(t, w["word"])), F.lit(0))["value"], t=text)
    return bind(
        lambda t, n: F.get(
            F.filter(table, lambda w: F.contains(t, w["word"]) & ~F.contains(n, w["word"])), F.lit(0)
        )["value"],
        t=text,
        n=name,
    )


def is_word_outside_name(text: Column, name: Column, word: str, strict: bool = False) -> Column:
    return _hit(text, word, strict) & ~_hit(name, word, strict)


def lot(text: Column, name: Column, strict: bool = False) -> Column:
    hits = [is_word_outside_name(text, name, w, strict) for w in LOT_WORDS]
    return F.coalesce(F.array_contains(F.array(*hits), True), F.lit(False))


def quantity(text: Column, strict: bool = False) -> Column:
    words = [
        (F.lit(n), p.format(n=n)) for n in range(LARGEST_QUANTITY, 0, -1) for p in QUANTITY_PATTERNS
    ]
    return F.coalesce(_first_hit(text, None, words, strict), F.when(F.contains(text, F.lit("playset")), F.lit(4)))


def special(text: Column, name: Column, strict: bool = False) -> Column:
    return _first_hit(text, name, [(F.lit(w), w) for w in SPECIAL_WORDS], strict)


def language(text: Column, strict: bool = False) -> Column:
    return _first_hit(text, None, [(F.lit(w), w) for w in LANGUAGES], strict)


def condition(text: Column, strict: bool = False) -> Column:
    return _first_hit(text, None, [(F.lit(w), w) for w in CONDITIONS], strict)


def graded(text: Column, name: Column, strict: bool = False) -> Column:
    """TRUE or NULL. By default the word must also be in the card name."""
    hits = []
    for w in GRADE_WORDS:
        in_name = _hit(name, w, strict)
        hits.append(_hit(text, w, strict) & (~in_name if strict else in_name))
    return F.when(F.array_contains(F.array(*hits), True), F.lit(True))


def booster_box(text: Column, strict: bool = False) -> Column:
    return _hit(text, "booster box", strict) | _hit(text, "boosterbox", strict)


def commander_deck(text: Column, strict: bool = False) -> Column:
    return _hit(text, "commander deck", strict)


def set_code(text: Column, name: Column, by_alias: Column, by_code: Column, by_name: Column) -> Column:
    """The set a title names.

    Each list is ``array<struct<word,code>>`` in order of preference, words in
    lower case. An alias beats a code, a code beats a set name; a code that is
    part of the card name does not count.
    """


    def first(words: Column, keep) -> Column:
        return F.get(F.filter(words, keep), F.lit(0))["code"]

    return bind(
        lambda t, n: F.coalesce(
            first(by_alias, lambda s: F.contains(t, s["word"])),
            first(by_code, lambda s: F.contains(t, s["word"]) & ~F.contains(n, s["word"])),
            first(by_name, lambda s: F.contains(t, s["word"])),
        ),
        t=text,
        n=name,
    )


def sale_type(spans: Column) -> Column:
    """Kind of sale from the price spans ``array<struct<cls,text>>`` of a listing."""
    return by_price_class(spans)["saletype"]


def sale_price(spans: Column) -> Column:
    return scalars.numeric_text(by_price_class(spans)["text"])


# Markup classes of a price, by precedence, and the sale type each one means.
PRICE_CLASSES = (
    ("STRIKETHROUGH POSITIVE ITALIC", "strikethrough italic"),
    ("POSITIVE ITALIC", "italic"),
    ("STRIKETHROUGH POSITIVE", "BO accepted"),
    ("POSITIVE", "normal"),
)
# End of fixed values.


def _has_class(cls: str):
    """A one-word class matches any element that carries it, a longer one only as a whole."""
    if " " in cls:
        return lambda s: s["cls"] == cls
    return lambda s: s["cls"].rlike(rf"(?<!\S){cls}(?!\S)")


def by_price_class(spans: Column) -> Column:
    """Kind of sale and text of the one span of the first class that has just one."""

    def choice(hits: Column, sale: str) -> Column:
        only = F.struct(F.lit(sale).alias("saletype"), F.get(hits, F.lit(0))["text"].alias("text"))
        return F.when(F.size(hits) == 1, only)

    found = [bind(lambda hits, sale=sale: choice(hits, sale), hits=F.filter(spans, _has_class(cls))) for cls, sale in PRICE_CLASSES]
    return F.coalesce(*found)


def tag(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add every title attribute to rows of ``title, cardname``.

    Lower-cased copies are computed once; a row whose title lacks the card name
    is dropped. Attributes that need other tables (set, rarity) are joined by
    ``operators.setmatch``.
    """
    base = df.withColumn("_t", F.lower("title")).withColumn("_n", F.lower("cardname"))
    base = base.filter(F.contains(F.col("_t"), F.col("_n")))
    t, n = F.col("_t"), F.col("_n")
    return base.withColumns(
        {
            "lotis": lot(t, n, strict),
            "cardquantity": quantity(t, strict),
            "isfoil": is_word_outside_name(t, n, "foil", strict),
            "isemblem": is_word_outside_name(t, n, "emblem", strict),
            "istoken": is_word_outside_name(t, n, "token", strict),
            "isboosterbox": booster_box(t, strict),
            "iscommanderdeck": commander_deck(t, strict),
            "cardspecial": special(t, n, strict),
            "cardlanguage": language(t, strict),
            "cardcondition": condition(t, strict),
            "isgraded": graded(t, n, strict),
            "possiblybad": F.lit(False),
            "isbanned": F.lit(False),
        }
    ).drop("_t", "_n")
