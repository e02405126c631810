"""Feature frame and training set for forecasting, for all cards at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import series as S
from marketloom.operators.names import only_names
from marketloom.operators.ranks import global_rank

HORIZON = 7
# One order of features everywhere.
FEATURES = ("price0", "modratio", "pioratio", "standratio")


@dataclass(frozen=True)
class Window:
    """Days of a model run: targets run from ``start`` to ``end``."""

    start: str
    end: str
    calendar_start: str

    @property
    def end_training(self):
        return F.date_sub(F.lit(self.end).cast("date"), HORIZON)


@dataclass(frozen=True)
class Inputs:
    """The five daily inputs: sale price, digital price and three play shares."""

    sale: DataFrame
    digital: DataFrame
    pioneer: DataFrame
    modern: DataFrame
    standard: DataFrame
    names: DataFrame


def _share(df: DataFrame, name: str) -> DataFrame:
    return df.select("cardname", F.col("entrydate").alias("date"), F.col("ratio").cast("double").alias(name))


def aligned(inputs: Inputs) -> DataFrame:
    """Outer alignment of the five series of the wanted cards."""
    target = scalars.robust_price(F.col("avge"), F.col("med"))
    frames = {
        "target": inputs.sale.select("cardname", F.col("carddate").alias("date"), target.alias("target")),
        "price0": inputs.digital.select("cardname", "date", "price0"),
        "modratio": _share(inputs.modern, "modratio"),
        "pioratio": _share(inputs.pioneer, "pioratio"),
        "standratio": _share(inputs.standard, "standratio"),
    }
    return only_names(S.align(frames), inputs.names)


def feature_frame(inputs: Inputs, window: Window, backward: bool = True) -> DataFrame:
    """``cardname, date, target, price0, modratio, pioratio, standratio`` on a dense calendar.

    Shares without an entry are 0; the digital price is filled forward and, with
    ``backward``, its head from the first known price; the target keeps its gaps.
    A card without any entry on some series needs no stand-in rows.
    """
    known = aligned(inputs)
    days = S.calendar(
        inputs.names.select("cardname").distinct(), F.lit(window.calendar_start), F.lit(window.end)
    )
    full = S.reindex(known, days)
    price = S.fill(F.col("price0")) if backward else S.forward_fill(F.col("price0"))
    return full.select(
        "cardname",
        "date",
        "target",
        price.alias("price0"),
        *[S.zero_fill(F.col(c)).alias(c) for c in FEATURES[1:]],
    )


def categories(names: DataFrame) -> DataFrame:
    """``category, cardname``: 0-based position by name."""
    ranked = global_rank(names.select("cardname").distinct(), [F.asc("cardname")], "_rank")
    return ranked.select((F.col("_rank") - 1).cast("int").alias("category"), "cardname")


def lagged(frame: DataFrame, days: int = HORIZON) -> DataFrame:
    """Features as they were ``days`` before the target's day."""
    return frame.select("cardname", "date", "target", *[S.lag_days(F.col(c), days).alias(c) for c in FEATURES])


def _instances(frame: DataFrame, cats: DataFrame, start: str, end) -> DataFrame:
    """One training document per card over the days ``start`` to ``end``."""
    rows = lagged(frame).filter(F.col("date").between(F.lit(start).cast("date"), end))
    target = scalars.nan_for_missing(F.col("target"))
    arrays = (
        rows.withColumn("target", target)
        .groupBy("cardname")
        .agg(S.ordered_values("target").alias("target"), *[S.ordered_values(c).alias(c) for c in FEATURES])
    )
    return arrays.join(cats, "cardname").select(
        "cardname",
        "category",
        F.lit(f"{start} 00:00:00").alias("start"),
        "target",
        F.array("category").alias("cat"),
        F.array(*FEATURES).alias("dynamic_feat"),
    )


def training_set(frame: DataFrame, cats: DataFrame, window: Window) -> DataFrame:
    return _instances(frame, cats, window.start, window.end_training)


def test_set(frame: DataFrame, cats: DataFrame, window: Window) -> DataFrame:
    """The training days and the last horizon."""
    return _instances(frame, cats, window.start, F.lit(window.end).cast("date"))


def documents(instances: DataFrame) -> DataFrame:
    """The exported fields of an instance."""
    return instances.select("start", "target", "cat", "dynamic_feat")


def length_check(instances: DataFrame) -> DataFrame:
    """Per card the lengths of target and features, and whether they all agree."""
    lengths = F.transform("dynamic_feat", lambda f: F.size(f))
    return instances.select(
        "cardname",
        F.size("target").alias("n_target"),
        F.array_min(lengths).alias("shortest"),
        F.array_max(lengths).alias("longest"),
        F.forall(lengths, lambda n: n == F.size("target")).alias("ok"),
    )


def serving_series(frame: DataFrame, cats: DataFrame, window: Window) -> DataFrame:
    """Per card the target and features that reach one horizon further back.

    The features cover ``start - HORIZON`` to ``end``, so they are longer than
    the target by the horizon.
    """
    start = F.lit(window.start).cast("date")
    rows = frame.filter(F.col("date").between(F.date_sub(start, HORIZON), F.lit(window.end).cast("date")))
    target = F.when(F.col("date") >= start, scalars.nan_for_missing(F.col("target")))
    arrays = rows.withColumn("target", target).groupBy("cardname").agg(
        F.filter(S.ordered_values("target"), lambda v: v.isNotNull()).alias("target"),
        *[S.ordered_values(c).alias(c) for c in FEATURES],
    )
    return arrays.join(cats, "cardname").select(
        "cardname", "category", F.array(*FEATURES).alias("dynamic_feat"), "target"
    )
