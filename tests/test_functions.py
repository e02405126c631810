import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import predicates as P
from marketloom.functions import scalars, tagger
from marketloom.sources import documents


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values).items()))
    return df.select(expression.alias("v")).first()["v"]


def _types(values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", type(None): "string"}
    return {k: kinds[type(v)] for k, v in values.items()}


@pytest.mark.parametrize(
    "text, number",
    [("$1,234.56", 1234.56), ("Free shipping", None), ("$1.00 to $2.00", None), ("+$0.99 shipping", 0.99)],
)
def test_numeric_text(spark, text, number):
    assert one(spark, scalars.numeric_text(F.col("s")), s=text) == number
    assert one(spark, scalars.shipping_amount(F.col("s")), s=text) == (number or 0.0)


@pytest.mark.parametrize(
    "text, day",
    [("Sold  Jan 12, 2024", dt.date(2024, 1, 12)), ("Sold  Jan 2, 2024", dt.date(2024, 1, 2)), ("Sold", None)],
)
def test_sold_date(spark, text, day):
    assert one(spark, scalars.sold_date(F.col("s")), s=text) == day


def test_tri_state(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    b = F.col("b")
    got = df.select(P.is_false(b), P.not_true(b), P.is_true(b)).collect()
    assert [tuple(r) for r in got] == [(False, False, True), (True, True, False), (False, True, False)]


def test_ratio_guard_and_unit_price_survive_zero(spark):
    df = spark.createDataFrame([(0.0, 4.0, 0), (2.0, 8.0, 4), (None, 1.0, None)], "price double, shipping double, q int")
    got = df.select(
        P.ratio_below(F.col("shipping"), F.col("price"), 3.0),
        scalars.unit_price(F.col("price"), F.col("shipping"), [F.col("q")]),
    ).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, 2.5), (True, None)]


def test_robust_price(spark):
    assert math.isclose(one(spark, scalars.robust_price(F.col("a"), F.col("m")), a=8.25, m=6.0), 1.791759469228055)
    assert one(spark, scalars.robust_price(F.col("a"), F.col("m")), a=8.25, m=0.0) is None


def test_nan_is_written_as_text(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("inf"),)], "v double")
    got = [r[0] for r in df.select(F.to_json(F.struct(scalars.nan_for_missing(F.col("v")).alias("v")))).collect()]
    assert got == ['{"v":1.5}', '{"v":"NaN"}', '{"v":"NaN"}']


TAGGED = [
    ("4x Thoughtseize NM English MTG", 4, "NM", False, False, None, "english"),
    ("Thoughtseize Playset Lightly Played non-foil", 4, "Lightly Played", True, False, None, None),
    ("Foil Alter Thoughtseize x10", 1, None, True, False, "alter", None),
    ("Thoughtseize lot of 3", None, None, False, True, None, None),
    ("Thoughtseize Near Mint Promo", None, "Mint", False, False, "promo", None),
    ("Thoughtseize (2) THS", 2, None, False, False, None, None),
]


def test_tagger(spark):
    df = spark.createDataFrame([(t[0], "Thoughtseize") for t in TAGGED], "title string, cardname string")
    got = tagger.tag(df).select("title", "cardquantity", "cardcondition", "isfoil", "lotis", "cardspecial", "cardlanguage")
    assert {tuple(r) for r in got.collect()} == set(TAGGED)


def test_tagger_drops_titles_without_the_card(spark):
    df = spark.createDataFrame([("Other card", "Thoughtseize")], "title string, cardname string")
    assert tagger.tag(df).count() == 0


def test_strict_tagger_matches_whole_words(spark):
    df = spark.createDataFrame(
        [("Goblin Alchpist x10", "Goblin"), ("Goblin hp x1 PSA 9", "Goblin")], "title string, cardname string"
    )
    got = tagger.tag(df, strict=True).select("cardcondition", "cardquantity", "isgraded").collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("HP", 1, True)]
    loose = tagger.tag(df).select("cardcondition", "cardquantity", "isgraded").collect()
    assert [tuple(r) for r in loose] == [("HP", 1, None), ("HP", 1, None)]


def test_words_of_the_card_name_do_not_count(spark):
    df = spark.createDataFrame([("Foil Promo Painted Foil Golem lot ", "Painted Foil Golem")], "title string, cardname string")
    r = tagger.tag(df).first()
    assert (r["isfoil"], r["cardspecial"], r["lotis"]) == (False, "promo", True)


def test_image_url(spark):
    docs = [
        '{"data":[{"image_uris":{"large":"a"}}]}',
        '{"data":[{"card_faces":[{"image_uris":{"large":"b"}},{"image_uris":{"large":"c"}}]}]}',
        '{"data":[{}]}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = [r[0] for r in df.select(documents.image_url(F.col("d"), "none")).collect()]
    assert got == ["a", "b", "none"]
