"""One digital price series per card name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.names import only_names
from marketloom.session import stored

RARITIES = ("Rare", "Mythic")


def priced_versions(prices: DataFrame, defs: DataFrame, universe: DataFrame) -> DataFrame:
    """Prices of plain rare and mythic versions of the cards in ``universe``."""
    wanted = only_names(_plain(defs), universe)
    return prices.join(wanted.select("card_id", "cardname", "cardset"), "card_id").select(
        "id", "card_id", "date", "price", "cardname", "cardset"
    )


def canonical_price(prices: DataFrame, defs: DataFrame, universe: DataFrame) -> DataFrame:
    """All price rows of each name's smallest priced ``card_id``.

    Which version counts is settled on the ids alone (one column, combined
    before the shuffle); the price rows then meet a table of one row per name.
    """
    wanted = only_names(_plain(defs), universe).select("card_id", "cardname", "cardset")
    priced = prices.select("card_id").distinct()
    first = (
        wanted.join(priced, "card_id", "left_semi").groupBy("cardname").agg(F.min("card_id").alias("card_id"))
    )
    versions = stored(wanted.join(first, ["cardname", "card_id"]), "versions")
    return prices.join(versions, "card_id").select("id", "card_id", "date", "price", "cardname", "cardset")


def smallest_version(priced: DataFrame) -> DataFrame:
    """Rows of the smallest ``card_id`` of each name in an already joined table."""
    first = priced.groupBy("cardname").agg(F.min("card_id").alias("card_id"))
    return priced.join(first, ["cardname", "card_id"], "left_semi")


def daily_digital(canonical: DataFrame) -> DataFrame:
    """``cardname, date, price0``: the last stored price where a day has several."""
    last = F.max(F.struct("id", "price"))["price"]
    return canonical.groupBy("cardname", "date").agg(last.alias("price0"))


def _plain(defs: DataFrame) -> DataFrame:
    return defs.filter(F.col("foil").eqNullSafe(F.lit(False)) & F.col("rarity").isin(*RARITIES))
