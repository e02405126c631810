"""What is new since the last run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import stored as written

NEW_CARD_DAYS = 100
KNOWN_CARD_SLACK = 10


def high_water(stored: DataFrame, key: str, day: str) -> DataFrame:
    return stored.groupBy(key).agg(F.max(day).alias("_max"))


def with_bounds(rows: DataFrame, stored: DataFrame, as_of: str, key: str = "cardname", day: str = "carddate") -> DataFrame:
    """Add ``_lo`` (first wanted day), ``_hi`` (yesterday) and ``_slack``.

    A known card continues the day after its last stored one, a new card starts
    100 days back.
    """
    today = F.lit(as_of).cast("date")
    known = rows.join(written(high_water(stored, key, day), "high-water"), key, "left")
    return known.withColumns(
        {
            "_lo": F.coalesce(F.date_add("_max", 1), F.date_sub(today, NEW_CARD_DAYS)),
            "_hi": F.date_sub(today, 1),
            "_slack": F.when(F.col("_max").isNull(), NEW_CARD_DAYS).otherwise(KNOWN_CARD_SLACK),
        }
    ).drop("_max")


def in_range(rows: DataFrame, stored: DataFrame, as_of: str, key: str = "cardname", day: str = "carddate") -> DataFrame:
    """Rows inside their card's wanted days."""
    bounded = with_bounds(rows, stored, as_of, key, day)
    return bounded.filter(F.col(day).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_slack")


def is_stop(day: Column, lo: Column, slack: Column) -> Column:
    """Whether reading a page in order ends here: the day is before ``lo``, by no more than ``slack`` days."""
    return (day < lo) & (F.date_add(day, slack) >= lo)


def until_stop(rows: DataFrame, page: list[str], position: str, day: Column, lo: Column, hi: Column, slack: Column) -> DataFrame:
    """Wanted rows of a page read in order.

    A row a little older than ``lo`` ends the page; a row older by more than
    ``slack`` days is stray and only skipped. The end of each page is one
    minimum per page, combined before the shuffle.
    """
    ends = rows.filter(is_stop(day, lo, slack)).groupBy(*page).agg(F.min(position).alias("_end"))
    kept = rows.join(ends, page, "left").filter(F.col("_end").isNull() | (F.col(position) < F.col("_end")))
    return kept.filter((day >= lo) & (day <= hi)).drop("_end")


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; NULL is a key like any other."""
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(known, same, "left_anti")


def with_several_items(items: DataFrame, page: list[str]) -> DataFrame:
    """Items of pages with more than one item."""
    full = items.groupBy(*page).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return items.join(full, page, "left_semi")
