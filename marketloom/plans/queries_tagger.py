"""Listing tagger, one query per attribute over all listing titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import tagger
from marketloom.operators import names, setmatch
from marketloom.plans.queries_market import SINCE_SET
from marketloom.plans.registry import query

_TITLES = "(SELECT listing_id, title, lower(title) AS t, lower(cardname) AS n FROM {listings}) x"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_word(word: str, guarded: bool, guard: str = "NOT ") -> str:
    hit = f"contains(t,{sql_text(word.lower())})"
    return f"({hit} AND {guard}contains(n,{sql_text(word.lower())}))" if guarded else hit


def first_word(words: list[tuple[str, str]], guarded: bool, otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {has_word(w, guarded)} THEN {v}" for v, w in words)
    return f"CASE {cases} ELSE {otherwise} END"


def _tag_query(name: str, column: str, expression: Callable[[Column, Column], Column], sql: str) -> None:
    """``expression`` takes the lower-case title and card name."""

    def run(m):
        lowered = m.listings.select("listing_id", "title", F.lower("title").alias("t"), F.lower("cardname").alias("n"))
        return lowered.select("listing_id", "title", expression(F.col("t"), F.col("n")).alias(column))

    query(name, f"SELECT listing_id, title, {sql} AS {column} FROM {_TITLES}")(run)


_tag_query("tag_lot", "lotis", tagger.lot, " OR ".join(has_word(w, True) for w in tagger.LOT_WORDS).join("()"))
_tag_query(
    "tag_quantity",
    "cardquantity",
    lambda t, n: tagger.quantity(t),
    first_word(
        [(str(n), p.format(n=n)) for n in range(tagger.LARGEST_QUANTITY, 0, -1) for p in tagger.QUANTITY_PATTERNS],
        False,
        "CASE WHEN contains(t,'playset') THEN 4 END",
    ),
)
for _word in ("foil", "emblem", "token"):
    _tag_query(f"tag_{_word}", f"is{_word}", lambda t, n, w=_word: tagger.is_word_outside_name(t, n, w), has_word(_word, True))
_tag_query(
    "tag_box",
    "isboosterbox",
    lambda t, n: tagger.booster_box(t),
    "(contains(t,'booster box') OR contains(t,'boosterbox'))",
)
_tag_query(
    "tag_commander_deck", "iscommanderdeck", lambda t, n: tagger.commander_deck(t), "contains(t,'commander deck')"
)
_tag_query("tag_special", "cardspecial", tagger.special, first_word([(sql_text(w), w) for w in tagger.SPECIAL_WORDS], True))
_tag_query("tag_language", "cardlanguage", lambda t, n: tagger.language(t), first_word([(sql_text(w), w) for w in tagger.LANGUAGES], False))
_tag_query("tag_condition", "cardcondition", lambda t, n: tagger.condition(t), first_word([(sql_text(w), w) for w in tagger.CONDITIONS], False))
_tag_query(
    "tag_graded",
    "isgraded",
    tagger.graded,
    "CASE WHEN " + " OR ".join(has_word(w, True, "") for w in tagger.GRADE_WORDS) + " THEN TRUE END",
)
_tag_query(
    "tag_graded_strict",
    "isgraded",
    lambda t, n: tagger.graded(t, n, strict=True),
    "CASE WHEN "
    + " OR ".join(
        rf"(regexp_matches(t,'\b{w.strip().lower()}\b') AND NOT regexp_matches(n,'\b{w.strip().lower()}\b'))"
        for w in tagger.GRADE_WORDS
    )
    + " THEN TRUE END",
)


@query(
    "tag_rarity",
    """SELECT listing_id, title, CASE WHEN EXISTS (SELECT 1 FROM {cards} c WHERE c.name=l.cardname AND c.rarity='rare'
         AND c.setcode IN (SELECT code FROM {recent_sets}))
         THEN 'rare' ELSE 'mythic' END AS rarity FROM {listings} l""",
)
def tag_rarity(m):
    codes = names.sets_since(m["sets"], SINCE_SET)
    return setmatch.with_rarity(m.listings, m["cards"], codes).select("listing_id", "title", "rarity")


@query(
    "tag_all",
    f"""SELECT cardname, COUNT(*) AS n, COUNT(*) FILTER (WHERE {has_word('foil', True)}) AS n_foil,
          COUNT(*) FILTER (WHERE {' OR '.join(has_word(w, True) for w in tagger.LOT_WORDS)}) AS n_lot,
          COUNT({first_word([(sql_text(w), w) for w in tagger.SPECIAL_WORDS], True)}) AS n_special,
          COUNT({first_word([(sql_text(w), w) for w in tagger.CONDITIONS], False)}) AS n_condition,
          SUM({first_word([(str(n), p.format(n=n)) for n in range(tagger.LARGEST_QUANTITY, 0, -1) for p in tagger.QUANTITY_PATTERNS], False, "CASE WHEN contains(t,'playset') THEN 4 END")}) AS copies,
          COUNT({first_word([(sql_text(w), w) for w in tagger.LANGUAGES], False)}) AS n_language,
          COUNT(*) FILTER (WHERE {' OR '.join(has_word(w, True, '') for w in tagger.GRADE_WORDS)}) AS n_graded,
          COUNT(*) FILTER (WHERE {has_word('emblem', True)}) AS n_emblem, COUNT(*) FILTER (WHERE {has_word('token', True)}) AS n_token,
          COUNT(*) FILTER (WHERE {has_word('booster box', False)} OR {has_word('boosterbox', False)}) AS n_box,
          COUNT(*) FILTER (WHERE {has_word('commander deck', False)}) AS n_commander_deck,
          COUNT(*) FILTER (WHERE FALSE) AS n_possibly_bad, COUNT(*) FILTER (WHERE FALSE) AS n_banned
        FROM (SELECT cardname, lower(title) AS t, lower(cardname) AS n FROM {{listings}}) x WHERE contains(t,n) GROUP BY cardname""",
)
def tag_all(m):
    tagged = tagger.tag(m.listings)
    return tagged.groupBy("cardname").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("isfoil").alias("n_foil"),
        F.count_if("lotis").alias("n_lot"),
        F.count("cardspecial").alias("n_special"),
        F.count("cardcondition").alias("n_condition"),
        F.sum("cardquantity").alias("copies"),
        F.count("cardlanguage").alias("n_language"),
        F.count_if("isgraded").alias("n_graded"),
        F.count_if("isemblem").alias("n_emblem"),
        F.count_if("istoken").alias("n_token"),
        F.count_if("isboosterbox").alias("n_box"),
        F.count_if("iscommanderdeck").alias("n_commander_deck"),
        F.count_if("possiblybad").alias("n_possibly_bad"),
        F.count_if("isbanned").alias("n_banned"),
    )
