"""Price-history views: long tables for all cards; filter for one card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import series as S


def sale_history(sale: DataFrame) -> DataFrame:
    """Robust sale price per day; days without a sale stay gaps."""
    low = F.exp(scalars.robust_price(F.col("avge"), F.col("med")))
    return sale.select("cardname", F.col("carddate").alias("date"), low.alias("value")).dropna(subset=["value"])


def digital_history(digital: DataFrame, sale: DataFrame) -> DataFrame:
    """Digital price from the card's first sale on."""
    series = digital.select("cardname", "date", F.col("price0").alias("value"))
    return S.clip_from_first(series, sale, "carddate")


def share_history(share: DataFrame, sale: DataFrame, start: str, end: str) -> DataFrame:
    """Daily play share from ``start`` or the card's first sale, 0 where not played.

    The calendar of each card starts at its own first sale: days before it are
    never made.
    """
    first = sale.groupBy("cardname").agg(F.min("carddate").alias("_first"))
    lo = F.greatest(F.col("_first").cast("date"), F.lit(start).cast("date"))
    days = S.calendar(first, lo, F.lit(end))
    played = share.select("cardname", F.col("entrydate").alias("date"), F.col("ratio").alias("value"))
    return S.reindex(played, days).withColumn("value", S.zero_fill(F.col("value")))
