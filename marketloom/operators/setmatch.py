"""Which set and rarity a listing belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars, tagger
from marketloom.operators.names import rare_in
from marketloom.session import stored


def printings(cards: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ``name, code``: the comma lists of all rows of a card, united."""
    return cards.select(F.col(name).alias("name"), F.explode(scalars.comma_items(F.col("printings"))).alias("code")).distinct()


def candidates(cards: DataFrame, sets: DataFrame, name: str = "name") -> DataFrame:
    """One row per card with the words its sets are known by, at most one per set and list.

    Longer words come first, then code order; words are stored in lower case, so
    that a listing is matched without touching them.
    """
    known = sets.select("code", F.col("name").alias("setname"), F.col("mcmname").alias("alias"))

    def words(column: str) -> Column:
        entry = F.struct(
            (-F.length(column)).alias("rank"), F.col("code").alias("code"), F.lower(column).alias("word")
        )
        return F.array_sort(F.collect_set(F.when(F.col(column).isNotNull(), entry)))

    return (
        printings(cards, name)
        .join(known, "code", "left")
        .groupBy("name")
        .agg(words("alias").alias("by_alias"), words("code").alias("by_code"), words("setname").alias("by_name"))
        .withColumnRenamed("name", "cardname")
    )


def with_set(listings: DataFrame, per_card: DataFrame) -> DataFrame:
    """Add ``cardset``. The sets of a card arrive as short arrays, so a listing
    stays one row and meets no pairs."""
    return add_set(listings, stored(per_card, "card-sets"))


def add_set(listings: DataFrame, per_card: DataFrame) -> DataFrame:
    """``with_set`` for a stored ``per_card``."""
    lists = ["by_alias", "by_code", "by_name"]
    known = listings.join(per_card, "cardname", "left")
    code = tagger.set_code(F.lower("title"), F.lower("cardname"), *[F.col(c) for c in lists])
    return known.withColumn("cardset", code).drop(*lists)


def rare_cards(cards: DataFrame, codes: DataFrame) -> DataFrame:
    """``cardname`` of the cards with a rare printing in one of the sets ``codes``, marked."""
    return rare_in(cards, codes).select(F.col("name").alias("cardname"), F.lit(True).alias("_rare"))


def with_rarity(listings: DataFrame, cards: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``rarity``: ``rare`` if one of the sets ``codes`` has a rare printing of the card."""
    return add_rarity(listings, stored(rare_cards(cards, codes), "rare"))


def add_rarity(listings: DataFrame, rare: DataFrame) -> DataFrame:
    """``with_rarity`` for stored ``rare_cards``."""
    marked = listings.join(rare, "cardname", "left")
    return marked.withColumn("rarity", scalars.rarity_flag(F.col("_rare"))).drop("_rare")
