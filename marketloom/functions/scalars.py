"""Scalar expressions used across jobs. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_price(
    price: Column, shipping: Column, quantities: list[Column]
) -> Column:
    """Price with shipping per card; the first known quantity counts, else 1.

    A quantity of 0 gives NULL instead of an error.
    """
    return F.try_divide(price + shipping, F.coalesce(*quantities, F.lit(1)))


def numeric_text(text: Column) -> Column:
    """The number in a text such as ``$1,234.56``; NULL where there is no single one."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def shipping_amount(text: Column) -> Column:
    return F.coalesce(numeric_text(text), F.lit(0.0))


def sold_date(text: Column) -> Column:
    """The date in characters 7 to 18 of a text such as ``Sold  Jan 12, 2024``."""
    return F.try_to_timestamp(F.trim(F.substring(text, 7, 12)), F.lit("MMM d, yyyy")).cast("date")


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def comma_items(text: Column) -> Column:
    """Distinct, trimmed, non-empty items of a comma list."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def robust_price(avge: Column, med: Column) -> Column:
    """Log of the smaller of average and median; NULL where that is not positive."""
    low = F.least(avge, med)
    return F.when(avge.isNotNull() & med.isNotNull() & (low > 0), F.ln(low))


def nan_for_missing(c: Column) -> Column:
    """NULL and infinities become NaN, which ``to_json`` writes as ``"NaN"``."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, c).otherwise(F.lit(float("nan")))


def local_day(ts_utc: Column, zone: str) -> Column:
    """Calendar day of a UTC timestamp in ``zone``."""
    return F.from_utc_timestamp(ts_utc, zone).cast("date")


def image_markdown(base_url: str, name: Column) -> Column:
    """Markdown image link of a card; blanks in the name become ``+``."""
    return F.concat(F.lit(f"![Unknown]({base_url}"), F.replace(name, F.lit(" "), F.lit("+")), F.lit(".jpg)"))


def rarity_flag(has_rare: Column) -> Column:
    return F.when(has_rare, "rare").otherwise("mythic")
