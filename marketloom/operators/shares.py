"""Play share of a card among all cards of a day's tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators.names import only_names


def day_total(decks: DataFrame) -> DataFrame:
    """Cards per day over all rows, repeats included."""
    return decks.groupBy("entrydate").agg(F.sum("cardquant").alias("aggcount"))


def play_share(decks: DataFrame, universe: DataFrame) -> DataFrame:
    """``entrydate, cardname, ratio`` of the cards in ``universe``.

    Equal rows of one event count once above the line and every time below it.
    They are first folded to one row with its multiplicity, so that numerator and
    denominator come from a single pass over the decks. The day's total is a
    window over one row per card and day.
    """
    dated = decks.filter(F.col("entrydate").isNotNull())
    folded = dated.groupBy("cardname", "entrydate", "cardquant", "tourntitle").agg(F.count(F.lit(1)).alias("_times"))
    per_card = folded.groupBy("cardname", "entrydate").agg(
        F.sum("cardquant").alias("_once"),
        F.sum(F.col("cardquant") * F.col("_times")).alias("_all"),
    )
    total = F.sum("_all").over(W.partitionBy("entrydate"))
    shares = per_card.select("entrydate", "cardname", F.try_divide("_once", total).alias("ratio"))
    return only_names(shares, universe).select("entrydate", "cardname", "ratio")


def event_counts(entries: DataFrame) -> DataFrame:
    """Copies of a card per event, summed over all decks of the event."""
    return entries.groupBy("entrydate", "tourntitle", "cardname").agg(F.sum("cardquant").alias("cardquant"))


def without_titles_like(decks: DataFrame, pattern: str = "(%)") -> DataFrame:
    """Drop rows whose title matches; rows without a title stay."""
    return decks.filter(~F.coalesce(F.col("tourntitle").ilike(pattern), F.lit(False)))
