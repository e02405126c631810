"""Cleaning of sales and the daily sale price per card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import predicates as P
from marketloom.functions import scalars
from marketloom.operators.names import only_names
from marketloom.operators.quantiles import avg_and_median

# Which sales count. A column missing from a table is not tested.
CLEAN_RULES: dict[str, str | tuple] = {
    "possiblybad": "false",
    "ismisprint": "null",
    "isfoil": "false",
    "cardlanguage": ("null_or_in", "english"),
    "cardset": ("null_or_not_in", "LEA", "LEB", "U"),
    "isemblem": "not_true",
    "lotis": "not_true",
    "isboosterbox": "not_true",
    "cardspecial": "null",
    "issleeve": "null",
    "isdeck": "null",
    "isplaymat": "null",
    "isultra": "null",
    "istoken": "not_true",
    "iscommanderdeck": "not_true",
    "isgraded": "null",
    "saletype": ("in", "normal"),
}
SHIPPING_RATIO = 3.0
TOTAL_CAP = 100.0
UNIT_CAP = 50.0


def clean_predicate(columns: list[str], rules: dict[str, str | tuple] = CLEAN_RULES) -> Column:
    """The whole row test but for the card list and the unit cap."""
    tests = [P.from_rules({c: r for c, r in rules.items() if c in columns})]
    if "othercards" in columns:
        tests.append(F.col("othercards").isNull() | P.is_true(F.col("transplit")))
    tests.append(P.ratio_below(F.col("shipping"), F.col("price"), SHIPPING_RATIO))
    tests.append(F.col("price") + F.col("shipping") < TOTAL_CAP)
    return P.all_of(tests)


def with_unit_price(tx: DataFrame) -> DataFrame:
    quantities = [F.col(c) for c in ("availablequant", "cardquantity", "maybecardquantity")]
    return tx.withColumn("unit", scalars.unit_price(F.col("price"), F.col("shipping"), quantities))


def clean_sales(tx: DataFrame, rules: dict[str, str | tuple] = CLEAN_RULES) -> DataFrame:
    """``title, cardname, carddate, unit`` of the sales that pass every row test."""
    return (
        with_unit_price(tx.filter(clean_predicate(tx.columns, rules)))
        .select("title", "cardname", "carddate", "unit")
        .filter(F.col("unit") < UNIT_CAP)
    )


def daily_sale_price(tx: DataFrame, names: DataFrame, rules: dict[str, str | tuple] = CLEAN_RULES) -> DataFrame:
    """``cardname, carddate, avge, med`` of the clean sales of the listed cards.

    Equal title, card, day and unit price count as one sale.
    """
    sales = only_names(clean_sales(tx, rules), names).distinct()
    return avg_and_median(sales, ["cardname", "carddate"], "unit")


def drill_down(tx: DataFrame, cardname: str, day: str, rows: int = 10) -> DataFrame:
    """Cheapest listings of one card on one day, in a fixed order."""
    hits = tx.filter((F.col("cardname") == cardname) & (F.col("carddate") == F.lit(day).cast("date")))
    return hits.select("price", "title").orderBy("price", "title").limit(rows)
