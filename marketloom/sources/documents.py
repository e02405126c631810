"""JSON documents: definition maps, price maps, image links, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFINITION = "map<string,struct<name:string,foil:int,rarity:string,cardset:string>>"
PRICES = "map<string,double>"
FORECAST = "struct<predictions:array<struct<quantiles:map<string,array<double>>,samples:array<array<double>>>>>"


def card_definitions(docs: DataFrame, text: str = "value") -> DataFrame:
    """``{id: {name, foil, rarity, cardset}}`` documents to one row per id."""
    entries = docs.select(F.explode(F.from_json(text, DEFINITION)).alias("key", "d"))
    return entries.select(
        F.col("key").cast("bigint").alias("card_id"),
        F.col("d.name").alias("cardname"),
        (F.col("d.foil") == 1).alias("foil"),
        F.col("d.rarity").alias("rarity"),
        F.col("d.cardset").alias("cardset"),
    )


def price_day(file_name: Column) -> Column:
    """The day a price file is named after."""
    return F.regexp_extract(file_name, r"price-history-(\d{4}-\d{2}-\d{2})\.txt", 1).try_cast("date")


def card_price_rows(docs: DataFrame, text: str = "value", file_name: str = "file_name") -> DataFrame:
    """``{id: price}`` documents, dated by their file name, to ``card_id, date, price``."""
    entries = docs.select(price_day(F.col(file_name)).alias("date"), F.explode(F.from_json(text, PRICES)).alias("key", "price"))
    return entries.select(F.col("key").cast("bigint").alias("card_id"), "date", "price")


# Fixed value: the picture shown for a card without one.
NO_IMAGE = (
    "https://c1.scryfall.com/file/scryfall-cards/normal/front/a/2/a219a031-2466-4850-b646-79a09e30cf18.jpg?1562257506"
)
# End of fixed values.


def image_url(doc: Column, otherwise: str = NO_IMAGE) -> Column:
    """Large image of the first hit, of its first face, or the stand-in."""
    return F.coalesce(
        F.get_json_object(doc, "$.data[0].image_uris.large"),
        F.get_json_object(doc, "$.data[0].card_faces[0].image_uris.large"),
        F.lit(otherwise),
    )


def forecast_rows(responses: DataFrame, quantiles: list[str], keys: list[str], last: str = "last_day", text: str = "response") -> DataFrame:
    """A forecast document to one row per day after ``last``.

    Quantiles become columns ``q<level>`` and samples an array ``samples`` with
    the day's value of each. The arrays are zipped inside the row: no shuffle.
    """
    first = F.get(F.from_json(text, FORECAST)["predictions"], F.lit(0))
    body = responses.select(*keys, last, first.alias("p"))
    levels = F.arrays_zip(*[F.col("p.quantiles")[q].alias(_column(q)) for q in quantiles])
    rows = body.select(*keys, last, "p", F.posexplode(levels).alias("step", "q"))
    samples = F.transform("p.samples", lambda s: F.get(s, F.col("step")))
    return rows.select(
        *keys,
        F.date_add(last, F.col("step") + 1).alias("date"),
        *[F.col("q")[_column(q)].alias(_column(q)) for q in quantiles],
        samples.alias("samples"),
    )


def _column(quantile: str) -> str:
    return "q" + quantile.replace("0.", "", 1).replace(".", "_")


def forecast_request(
    start: Column, target: Column, cat: Column, dynamic_feat: Column, quantiles: list[str], num_samples: int = 100
) -> Column:
    """The request document of one series; NaN targets are written as ``"NaN"``."""
    instance = F.struct(
        start.alias("start"), target.alias("target"), cat.alias("cat"), dynamic_feat.alias("dynamic_feat")
    )
    configuration = F.struct(
        F.lit(num_samples).alias("num_samples"),
        F.array(F.lit("quantiles")).alias("output_types"),
        F.array(*[F.lit(q) for q in quantiles]).alias("quantiles"),
    )
    return F.to_json(F.struct(F.array(instance).alias("instances"), configuration.alias("configuration")))
