"""Slope of recent prices per card, and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ranks import global_rank, last_rows
from marketloom.session import stored

PAGE_SIZE = 20
TRAILING_DAYS = 7
LAST_ROWS = 4


def trailing(prices: DataFrame, as_of: str | None, days: int) -> DataFrame:
    """Rows younger than ``days``, counted from ``as_of`` or from each card's last row."""
    if as_of is not None:
        return prices.filter(F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days))
    latest = stored(prices.groupBy("cardname").agg(F.max("date").alias("_last")), "latest")
    return prices.join(latest, "cardname").filter(F.col("date") > F.date_sub("_last", days)).drop("_last")


def momentum(
    prices: DataFrame,
    as_of: str | None = None,
    days: int | None = TRAILING_DAYS,
    n: int = LAST_ROWS,
    compat: bool = False,
) -> DataFrame:
    """``cardname, slope``: least-squares slope per day of each card's last rows.

    ``prices`` is ``cardname, date, id, price``. Rows are taken by day, then id.
    Where all rows share a day the slope is 0. With ``compat`` a card with
    exactly three rows counts only its last one.
    """
    recent = trailing(prices, as_of, days) if days is not None else prices
    recent = recent.select("cardname", "date", "id", "price")
    last = last_rows(recent, "cardname", [F.desc("date"), F.desc("id"), F.desc("price")], n)
    slope = F.coalesce(F.regr_slope(F.col("price"), F.unix_date("date").cast("double")), F.lit(0.0))
    if compat:
        slope = F.when(F.count(F.lit(1)) == n - 1, F.lit(0.0)).otherwise(slope)
    return last.groupBy("cardname").agg(slope.alias("slope"))


def ranked_slopes(slopes: DataFrame) -> DataFrame:
    """``id, cardname, slope`` where ``id`` is the position by rising slope."""
    return global_rank(slopes, [F.asc("slope"), F.asc("cardname")], "id").select("id", "cardname", "slope")


def winners_page(slopes: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` (from 0), steepest rise first. Plans as a top-k, not a full sort."""
    return slopes.orderBy(F.desc("slope"), "cardname").offset(page * size).limit(size)


def losers_page(slopes: DataFrame, page: int, size: int = PAGE_SIZE, compat: bool = False) -> DataFrame:
    """Page ``page`` (from 0), steepest fall first.

    With ``compat`` page 0 has one row and later pages start one row late.
    """
    ordered = slopes.orderBy("slope", "cardname")
    if not compat:
        return ordered.offset(page * size).limit(size)
    if page == 0:
        return ordered.limit(1)
    return ordered.offset(1 + (page - 1) * size).limit(size)
